"""Numbers of tokens of documents, without their ids.

A word's bytes are a linked list of symbols, and a heap holds the rank and place of every adjacent pair that
the vocabulary merges. The pair of the lowest rank, of equal ones the leftmost, is popped and merged, its new
neighbours are pushed, and so on until the heap is empty: the count is the number of first symbols less the
number of merges. A stale entry, whose pair has changed since, is passed over. Words repeat, so counts are
memoised within a task; nothing is shuffled.

Strings of special tokens in a text are a token each. Texts of Latin letters are normalised and cut into
words by Python's own functions where the tokenizer's rules are those that this module knows; all others by the
library's normalizer and pre-tokenizer. Long texts are cut at spaces, which no word crosses, so memory does
not follow their length.

Defined cases: a null or empty text has no tokens; a word of any length is merged whole; repeated rows are
counted each, so are rows with equal or null ids; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_columns

#: Words whose counts are kept, and the longest of them.
MEMO, MEMO_LENGTH = 400_000, 64
#: Characters of a text that are cut into words at once, about.
PIECE = 1 << 20
#: Characters of the Latin script, which normal form C leaves alone.
FOREIGN = re.compile("[^\\0-ɏ]")
#: The rules that Python's functions follow exactly on these characters.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SHIFT = 40


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end at a space."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size) + 1
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Memo(dict):
    """Counts of words; when it is full it begins anew."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    """Counts the tokens of texts by a BPE vocabulary in the file format of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies are known here")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: A pair of symbols to its rank, and a rank to the symbol that the merge makes.
        self.rank_of = {vocab[a] << SHIFT | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.first = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c.removesuffix(suffix): i for c, i in vocab.items() if c.endswith(suffix) and len(c.removesuffix(suffix)) == 1} if suffix else self.first
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = {bytes([b]): level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for b in range(128, 2048):  # the first byte of two tells the second apart
            data = chr(b).encode()
            spelled |= {data[i : i + 1]: c for i, c in enumerate(level.pre_tokenize_str(chr(b))[0][0])}
        self.first_byte = [self.first.get(spelled.get(bytes([b]), ""), -1) for b in range(256)]
        self.last_byte = [self.last.get(spelled.get(bytes([b]), ""), -1) for b in range(256)]
        self.tokenizer = Tokenizer.from_file(path)
        added = [t["content"] for t in rules.get("added_tokens", []) if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        if len(added) != len(rules.get("added_tokens", [])):
            raise ValueError("added tokens with rules of their own are not known here")
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = rules.get("normalizer") == KNOWN_NORMALIZER and len(steps) == 2 and steps[1] == KNOWN_LEVEL
        plain = plain and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        self.words_of = self._words(steps[0]["pattern"]["Regex"]) if plain else None
        self.known, self.known_spelled = _Memo(self.of_word), _Memo(self.of_spelled)

    @staticmethod
    def _words(pattern: str):
        import regex

        return regex.compile(pattern).findall

    def merged(self, symbols: list[int]) -> int:
        """The number of symbols that are left when no adjacent pair can be merged."""
        n = len(symbols)
        rank_of, made = self.rank_of, self.made
        heap = []
        for i in range(n - 1):
            rank = rank_of.get(symbols[i] << SHIFT | symbols[i + 1])
            if rank is not None:
                heap.append(rank << SHIFT | i)
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left, place = n, (1 << SHIFT) - 1
        while heap:
            top = heappop(heap)
            i, rank = top & place, top >> SHIFT
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of.get(symbols[i] << SHIFT | symbols[j]) != rank:
                continue
            symbols[i] = made[rank]
            symbols[j] = -1  # no longer in the list
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of.get(symbols[i] << SHIFT | symbols[k])
                if rank is not None:
                    heappush(heap, rank << SHIFT | i)
            h = before[i]
            if h >= 0:
                rank = rank_of.get(symbols[h] << SHIFT | symbols[i])
                if rank is not None:
                    heappush(heap, rank << SHIFT | h)
        return left

    def of_word(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        symbols = [self.first_byte[b] for b in data]
        symbols[-1] = self.last_byte[data[-1]]
        return self.merged(symbols)

    def of_spelled(self, word: str) -> int:
        """Of a word in the byte-level alphabet."""
        return self.merged([*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]])

    def _segment(self, text: str) -> int:
        if self.words_of and not FOREIGN.search(text):
            return sum(map(self.known.__getitem__, self.words_of(text.lower())))
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        words = [word for word, _ in cutter.pre_tokenize_str(text)] if cutter else [text] * bool(text)
        return sum(map(self.known_spelled.__getitem__, words))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self._segment(piece) for part in parts if part for piece in pieces(part))


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every document."""

    def run(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        found = [counter(path).count(text) for text in texts.to_pylist()]
        sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        return [ids, sizes, pa.array(found, pa.int64())]

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = map_columns(own, ["id", "text"], f"id {kind}, n_bytes long, n_tokens long", run)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
