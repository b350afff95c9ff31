"""Statistics of a document's whole text, for the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np

from logweave.llm.minhash import window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8

#: Names of the features, in the order of :func:`features`.
NAMES = (
    "log_words", "word_length", "word_length_spread", "longest_word", "distinct_share", "symbol_share", "digit_share",
    "upper_share", "stop_share", "comma_share", "shout_share", "quote_share", "wide_share", "entropy", "lines",
    "words_per_line", "dup_line_share", "repeat_share", "commonest_share", "letterless_share",
)


class Counts:
    """What the base rules and the features count in a text; a null text counts as empty."""

    def __init__(self, text: str | None):
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        self.bytes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        self.words = raw.split()
        self.n_words = len(self.words)
        self.word_chars = len(text) - int(self.of(SPACES))
        self.n_symbols = int(self.of(SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.hashes = word_hashes(self.words)
        self.n_repeat_words = self._repeated()

    def of(self, characters: bytes) -> int:
        return self.bytes[list(characters)].sum()

    def _repeated(self) -> int:
        """Words in windows that are found twice or more, the first time included."""
        if self.n_words <= WINDOW:
            return 0
        windows = window_hashes(self.hashes, WINDOW)
        order = np.argsort(windows, kind="stable")
        same = np.diff(windows[order]) == 0
        if not same.any():
            return 0
        again = np.zeros(len(windows) + 1, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edges = np.zeros(self.n_words + 1, np.int64)
        starts = np.flatnonzero(again)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        return int((np.cumsum(edges) > 0).sum())

    def features(self) -> list[float]:
        n, size = max(1, self.n_words), max(1, int(self.bytes.sum()))
        lengths = np.fromiter(map(len, self.words), np.int64, self.n_words) if self.words else np.zeros(1)
        share = self.bytes[self.bytes > 0] / size
        letters = max(1, int(self.bytes[65:91].sum() + self.bytes[97:123].sum() + self.bytes[192:].sum()))
        _, often = np.unique(self.hashes, return_counts=True)
        short = sum(1 for word in self.words if len(word) == 1 and not word.isalnum())
        return [
            float(np.log1p(self.n_words)), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
            len(often) / n, self.n_symbols / size, float(self.bytes[48:58].sum() / size),
            float(self.bytes[65:91].sum() / letters), self.of(b".") / n, self.of(b",") / n, self.of(b"!?") / n,
            self.of(b"\"'`") / n, float(self.bytes[128:].sum() / size), float(-(share * np.log2(share)).sum()),
            float(np.log1p(self.n_lines)), self.n_words / max(1, self.n_lines), self.n_dup_lines / max(1, self.n_lines),
            self.n_repeat_words / n, float(often.max(initial=0) / n), short / n,
        ]
