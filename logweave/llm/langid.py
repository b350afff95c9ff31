"""Language identification of mixed text.

Letters of a text form words. The script of a word (by ranges of code points) narrows the languages
that may claim it; each of these scores it by the character trigrams learned for the language. Viterbi
search over the words, with a penalty for switching, labels spans; a text's language is the one whose
spans have most letters. Texts of a batch advance in lockstep, so a step is a few array operations.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language
that sorts first; long texts are labelled whole; repeated rows get equal results; a table without
labels gives ``und`` throughout; only text and label columns are read, and labels only to learn.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import discard, held, map_columns, written

UNKNOWN = "und"
#: Labelled documents of each language to learn from, about, and trigrams kept for each, at most.
SAMPLE, GRAMS = 1500, 20_000
#: Natural log of the odds against a switch between two words.
SWITCH = 12.0
#: Fixed ranges of code points, by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
_STARTS, _ENDS, _NAMES = zip(*sorted((a, b, name) for name, ranges in SCRIPTS.items() for a, b in ranges), strict=True)
MEMO = 300_000
#: Cells (words times texts) that are labelled in lockstep; a longer text goes by itself.
CELLS = 1_000_000
#: Texts of a batch.
ROWS = 2048


def script_of(word: str) -> str:
    from bisect import bisect_right

    at = bisect_right(_STARTS, ord(word[0])) - 1
    return _NAMES[at] if at >= 0 and ord(word[0]) <= _ENDS[at] else "other"


def words_of(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower()) if text else []


def grams_of(word: str) -> list[str]:
    word = f" {word} "
    return [word[i : i + 3] for i in range(len(word) - 2)]


@dataclass
class LanguageModel:
    """Trigram log-probabilities (a row for each trigram, the last for unseen ones) and scripts by language."""

    languages: list[str]
    grams: dict[str, int]
    scores: np.ndarray
    scripts: dict[str, np.ndarray]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, sample: int = SAMPLE) -> LanguageModel:
    """Learn from rows with a text and a label (and ``where``).

    About ``sample`` documents of each language are used, chosen by a hash of the text; this bound is
    what keeps the counts that reach the driver from growing with the corpus.
    """
    known = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), (F.lit(True) if where is None else where).alias("use"))
    known = known.where("use AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {row.lang: row["count"] for row in known.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((1, 0)), {})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    picked = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, scripts = Counter(), Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    scripts[(lang, script_of(word))] += n
                    for gram in grams_of(word):
                        grams[(lang, gram)] += n
            rows = [(*k, n, False) for k, n in grams.items()] + [(*k, n, True) for k, n in scripts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "key", "n", "script"])

    counts = picked.select("text", "lang").mapInArrow(count, "lang string, key string, n long, script boolean")
    counts = written(counts.groupBy("lang", "key", "script").agg(F.sum("n").alias("n")), "grams")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counts.where("NOT script").withColumn("rank", rank).where(F.col("rank") <= GRAMS).orderBy(F.desc("n"), "lang", "key")
    languages = sorted(sizes)
    grams: dict[str, int] = {}
    table = np.zeros((GRAMS * len(sizes) + 1, len(languages)))
    for row in top.collect():
        table[grams.setdefault(row.key, len(grams)), languages.index(row.lang)] = row.n
    table = table[: len(grams) + 1]
    scores = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    seen = np.zeros((len(languages), 1 + len(SCRIPTS)))
    names = [*SCRIPTS, "other"]
    for row in counts.where("script").collect():
        seen[languages.index(row.lang), names.index(row.key)] = row.n
    discard(counts)
    common = seen > 0.01 * np.maximum(seen.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, grams, scores, {name: common[:, i] for i, name in enumerate(names)})


class Labeller:
    """Scores words (memoised) and labels the spans of texts."""

    def __init__(self, model: LanguageModel, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def _learn(self, words: list[str]) -> None:
        if len(self.rows) + len(words) > MEMO:
            self._forget()
        start = len(self.rows)
        while len(self.table) < start + len(words):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        grams, last = self.model.grams, len(self.model.scores) - 1
        codes, at = [], []
        for word in words:
            at.append(len(codes))
            codes += [grams.get(gram, last) for gram in grams_of(word)]
        sums = np.add.reduceat(self.model.scores[codes], at, axis=0)
        able = np.stack([self.model.scripts[script_of(word)] for word in words])
        sums = np.where(able, sums, sums.min(axis=1, keepdims=True) - 1e3)
        sums[~able.any(axis=1)] = 0.0
        self.rows.update(zip(words, range(start, start + len(words)), strict=True))
        self.table[start : start + len(words)] = sums

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The rows of the words of every text in the table of scores."""
        new = set().union(*texts).difference(self.rows)
        if new:
            if len(self.rows) + len(new) > MEMO:
                self._forget()
                new = set().union(*texts)
            self._learn(sorted(new))
        row = self.rows.__getitem__
        return [np.fromiter(map(row, words), np.int32, len(words)) for words in texts]

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of every word of every text."""
        return self._labels(self.codes(texts))

    def _labels(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The same for rows of the table; texts of like length go together, so cells are few."""
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        found: list[np.ndarray] = [np.empty(0, np.int16)] * len(codes)
        at = 0
        while at < len(order):
            longest = max(1, len(codes[order[at]]))
            part = order[at : at + max(1, CELLS // longest)]
            at += len(part)
            for i, labels in zip(part, self._viterbi([codes[i] for i in part]), strict=True):
                found[i] = labels
        return found

    def _viterbi(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Labels of texts, the longest first."""
        sizes = np.array([len(x) for x in texts])
        steps, languages = int(sizes[0]), len(self.model.languages)
        codes = np.zeros((steps, len(texts)), np.int32)
        for column, x in enumerate(texts):
            codes[: len(x), column] = x
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        score = np.zeros((len(texts), languages))
        stays = np.zeros((steps, len(texts), languages), bool)
        bests = np.zeros((steps, len(texts)), np.int16)
        rows = np.arange(len(texts))
        for t, n in enumerate(active):
            now = score[:n]
            best = now.argmax(axis=1)
            top = now[rows[:n], best][:, None] - self.switch
            np.greater_equal(now, top, out=stays[t, :n])
            bests[t, :n] = best
            score[:n] = np.maximum(now, top) + self.table[codes[t, :n]]
        labels = np.zeros(codes.shape, np.int16)
        current = score.argmax(axis=1).astype(np.int16)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            own = current[:n]
            labels[t, :n] = own
            current[:n] = np.where(stays[t, rows[:n], own], own, bests[t, :n])
        return [labels[:n, column] for column, n in enumerate(sizes)]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, one past the last, language) of the spans of one text."""
        words = words_of(text)
        if not words or not self.model.languages:
            return []
        labels = self.label([words])[0]
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
        return [(a, b, self.model.languages[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the share of its letters times the odds of its label."""
        found = [(UNKNOWN, 0.0)] * len(texts)
        split = [words_of(text) for text in texts]
        having = [i for i, words in enumerate(split) if words]
        if not having or not self.model.languages:
            return found
        codes = self.codes([split[i] for i in having])
        for i, own_codes, labels in zip(having, codes, self._labels(codes), strict=True):
            letters = np.fromiter(map(len, split[i]), np.int64, len(split[i]))
            by = np.bincount(labels, weights=letters, minlength=len(self.model.languages))
            best = int(by.argmax())
            own = self.table[own_codes[labels == best]].sum(axis=0)
            others = np.delete(own, best)
            margin = min(50.0, own[best] - others.max()) if len(others) else 50.0
            found[i] = (self.model.languages[best], float(by[best] / by.sum() / (1 + math.exp(-max(-50.0, margin)))))
        return found


def labeller(model: LanguageModel, switch: float = SWITCH) -> Labeller:
    """The labeller of a model, whose memo of words outlives a task in its Python worker."""
    return held(("langid", model.name, switch), lambda: Labeller(model, switch))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every document."""

    def predict(keys: pa.Array, texts: pa.Array) -> list[pa.Array]:
        names, scores = zip(*labeller(model, switch).predict(texts.to_pylist()), strict=True)
        return [keys, pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"`{id_col}` {kind}, lang_pred string, score double", predict, rows=ROWS)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.0, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` that have a language, with at least the score ``least``."""
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = labeller(model, switch).predict(part.column(place).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a document is left out of learning, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
