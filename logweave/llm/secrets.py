"""Secret scans: fixed patterns, and automata inferred from the credentials that those patterns label.

The base rules find assignments, access keys and long hexadecimal runs. What they match in the corpus
are labelled credentials; a bounded sample of them is turned into one prefix tree for each kind, whose
statistically compatible states are merged (state merging with Hoeffding's bound) into a probabilistic
automaton. Every candidate of the corpus is then scored by how much likelier these formats make it than a
uniform choice of characters; candidates above a threshold become spans of kind ``format``. Candidates are
runs of LEAST characters of the alphabet or more that have a letter and a digit: shorter runs and plain
words never reach the threshold, runs of digits only would, but number something and open nothing.

No table and no result holds credentials: the sample goes to the driver, and a second pass over the texts scores. On its
way the sample (at most ``sample`` of each kind from a task) is in Spark's shuffle files and may be spilled; where the executors'
disks are not to be trusted, ``spark.io.encryption.enabled`` covers both.

Defined cases: a null text counts as empty; a text without secrets has no spans; whole texts are
scanned, however long; repeated rows give repeated results; without any labelled credential there are
no automata and only base spans are given; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_columns

KINDS = ("assign", "access", "hex", "format")
#: Labelled credentials of each kind from which an automaton is inferred, at most.
SAMPLE = 300
#: Bits a character by which an automaton has to beat a uniform choice of characters.
THRESHOLD = 1.25
#: Significance of the test that keeps two states apart.
ALPHA = 0.05

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of a candidate, at least.
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def base_spans(text: str, runs: list[re.Match]) -> list[tuple[str, int, int, str]]:
    """Leftmost non-overlapping matches of each base kind, ordered by start, then kind.

    ``runs`` are the matches of RUN, which hold every hexadecimal run that is long enough.
    """
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in runs:
        if run.end() - run.start() >= 24:
            found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(base: list[tuple[str, int, int, str]], runs: list[re.Match]) -> list[tuple[str, int, int, str]]:
    """Runs that mix letters and digits and touch no base span."""
    mixed = [run for run in runs if DIGIT.search(run[0]) and LETTER.search(run[0])]
    return [("format", *run.span(), run[0]) for run in mixed if not any(a < run.end() and run.start() < b for _, a, b, _ in base)]


class Automaton:
    """A probabilistic automaton, inferred from ``words`` by merging states of their prefix tree.

    States are numbered; ``next[s][c]`` is the state after character c, ``hits[s][c]`` how many words
    went that way, ``ends[s]`` how many words ended there.
    """

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.hits: list[dict[str, int]] = [{}]
        self.ends = [0]
        for word in words:
            state = 0
            for c in word:
                self.hits[state][c] = self.hits[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.hits.append({})
                    self.ends.append(0)
                state = self.next[state][c]
            self.ends[state] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _seen(self, state: int) -> int:
        return self.ends[state] + sum(self.hits[state].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, one: int, other: int) -> bool:
        """Whether ends and ways out agree, here and in the states that both reach."""
        todo = [(one, other)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in {*self.hits[a], *self.hits[b]}:
                if self._differ(self.hits[a].get(c, 0), n, self.hits[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, kept: int, gone: int) -> None:
        """Add the tree below ``gone`` to ``kept``."""
        todo = [(kept, gone)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.hits[b].items():
                self.hits[a][c] = self.hits[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        """Take the states next to the settled ones in order of arrival; merge each into the first compatible
        settled state, or settle it."""
        settled = [0]
        while True:
            inside = set(settled)
            edge = [(s, c) for s in settled for c in sorted(self.next[s]) if self.next[s][c] not in inside]
            if not edge:
                return
            s, c = max(edge, key=lambda x: self.hits[x[0]][x[1]])
            state = self.next[s][c]
            into = next((x for x in settled if self._compatible(x, state)), None)
            if into is None:
                settled.append(state)
            else:
                self.next[s][c] = into
                self._fold(into, state)

    def bits(self, word: str) -> float:
        """log2 of the probability of ``word``; what was never seen has a small share of each state."""
        total, state = 0.0, 0
        for c in word:
            n = self._seen(state) + 1
            total += math.log2((self.hits[state].get(c, 0) + 1 / len(ALPHABET)) / n)
            if c not in self.next[state]:
                return total - 8.0 * (len(word) + 1)
            state = self.next[state][c]
        return total + math.log2((self.ends[state] + 1 / len(ALPHABET)) / (self._seen(state) + 1))


def gain(automata: list[Automaton], word: str) -> float:
    """Bits a character by which the best automaton beats a uniform choice of characters."""
    uniform = len(word) * math.log2(len(ALPHABET))
    return max(((a.bits(word) + uniform) / len(word) for a in automata), default=-math.inf)


def _spans(rows: list[list[tuple]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    return pa.array([[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in row] for row in rows], pa.list_(kind))


def infer_formats(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, alpha: float = ALPHA) -> list[Automaton]:
    """An automaton for each base kind, from at most ``sample`` of its credentials in the corpus.

    The sample are the distinct values with the smallest hashes. Tasks keep so many of each kind at
    most, and only the sample, whose size does not grow with the corpus, reaches the driver.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kept: dict[str, dict[str, int]] = {kind: {} for kind in KINDS[:3]}
        least = lambda values: dict(heapq.nsmallest(sample, values.items(), key=lambda x: (x[1], x[0])))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, _, _, value in base_spans(text or "", list(RUN.finditer(text or ""))):
                    own = kept[kind]
                    own[value] = xxhash.xxh3_64_intdigest(value.encode()) >> 1
                    if len(own) > 8 * sample:
                        kept[kind] = least(own)
        rows = [(kind, value, hash_) for kind, own in kept.items() for value, hash_ in least(own).items()]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "value", "hash"])

    values = docs.select(F.col(f"`{text_col}`")).mapInArrow(find, "kind string, value string, hash long").distinct().persist()
    found = []
    for kind in KINDS[:3]:
        rows = values.where(F.col("kind") == kind).orderBy("hash", "value").limit(sample).collect()
        if rows:
            found.append(Automaton(sorted(row.value for row in rows), alpha))
    values.unpersist()
    return found


def all_spans(text: str, automata: list[Automaton], threshold: float) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and all spans in order."""
    runs = list(RUN.finditer(text))
    base = base_spans(text, runs)
    more = [x for x in candidates(base, runs) if gain(automata, x[3]) >= threshold]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``base`` and ``spans`` (arrays of spans) of every document; ``spans`` adds those of kind format."""
    automata = infer_formats(docs, text_col, sample)

    def find(keys: pa.Array, texts: pa.Array) -> list[pa.Array]:
        base, spans = zip(*[all_spans(text or "", automata, threshold) for text in texts.to_pylist()], strict=True)
        return [keys, _spans(base), _spans(spans)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"`{id_col}` {kind}, base array<{SPAN}>, spans array<{SPAN}>", find)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "<SECRET>", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``; a null text stays null.

    Overlapping spans become one mask. Documents and the other columns stay as they are.
    """
    automata = infer_formats(docs, text_col, sample)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, start, end, _ in all_spans(text, automata, threshold)[1]:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    place = docs.columns.index(text_col)

    def rewrite(*columns: pa.Array) -> list[pa.Array]:
        texts = pa.array([clean(text) for text in columns[place].to_pylist()], pa.string())
        return [*columns[:place], texts, *columns[place + 1 :]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_columns(docs, docs.columns, schema, rewrite)
