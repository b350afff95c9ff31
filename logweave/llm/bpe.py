"""Byte-level BPE encoding and decoding.

The encoder never runs merges over a text. Byte strings are mapped to Latin-1 so that an
Aho-Corasick automaton (pyahocorasick) finds, in one pass, the longest token that begins at every
position. A left-to-right search then takes longest matches and backtracks over the prefixes of a
match whenever two neighbours could not stand side by side in the output of the merge procedure.
Whether two tokens are compatible depends on them alone and is memoised; a bit per position marks
dead ends, so every position is given up at most once and the search is linear in the text.

Defined cases: a null text counts as the empty text, which has no ids; very long texts and very long
pieces are encoded whole; repeated rows are encoded each; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm.common import held, map_columns

#: Entries that the memo of pieces and the memo of token pairs may hold in one Python worker.
MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file: base64 token, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairCodec:
    """Encodes and decodes with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: token -> the two tokens that its last merge joins; a single byte stands for itself
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merged(token, rank, 2)
            if len(parts) == 1:
                self.halves[rank] = (rank, rank)
            elif len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
            else:  # no sequence of merges makes it inside a longer piece
                continue
            reachable.add(token)
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        if reachable:
            self.automaton.make_automaton()
        #: token -> the longest token that is a proper prefix of it, or -1
        self.shorter = [-1] * len(self.bytes_of)
        for token in reachable:
            for end in range(len(token) - 1, 0, -1):
                if token[:end] in reachable:
                    self.shorter[ranks[token]] = ranks[token[:end]]
                    break
        self.lengths = [len(token) for token in self.bytes_of]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def _merged(self, token: bytes, bound: int, least: int) -> list[int]:
        """What the merges of a rank below ``bound`` make of ``token``, down to ``least`` parts."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > least:
            best, at = bound, -1
            for i in range(len(parts) - 1):
                found = ranks.get(parts[i] + parts[i + 1], bound)
                if found < best:
                    best, at = found, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks.get(part, -1) for part in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge procedure leaves ``left right`` as it is.

        Undo the merges of both tokens from the latest to the earliest. If at some point the two
        tokens next to the seam form a merge of a lower rank than the last one undone, the procedure
        would have joined them across the seam before it finished the tokens.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.pairs) >= 4 * MEMO:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        bound = len(self.bytes_of) + 1
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < bound:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            can_left, can_right = inner_left != left, inner_right != right
            if can_left and (left > right or not can_right):
                bound, left = left, inner_left  # of equal ranks the merge on the left comes first
            elif can_right:
                bound, right = right + 1, inner_right
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return self._search(raw)

    def _search(self, raw: bytes) -> list[int]:
        n = len(raw)
        longest = [-1] * n
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - length + 1] = token  # ends ascend, so the last one written is the longest
        alive = bytearray(b"\x01") * (n + 1)
        lengths, shorter, compatible, known = self.lengths, self.shorter, self.compatible, self.pairs
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if alive[end] and (not out or known.get((out[-1], token)) or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            if token < 0:  # nothing fits here: give the position up and shorten what stands before it
                alive[at] = 0
                if not out:  # a vocabulary that no sequence of merges explains: run the merges themselves
                    return self._merged(raw, len(self.bytes_of) + 1, 1)
                token = out.pop()
                at -= lengths[token]

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``, every match of the pattern by itself, without special tokens."""
        out: list[int] = []
        memo, add = self.memo, out.extend
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(piece) <= 64:
                    memo[piece] = ids
            add(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file; held by a Python worker."""
    return held(("bpe", path, pattern), lambda: BytePairCodec(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (binary) of every document."""

    def encode(keys: pa.Array, texts: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        ids = [own.encode(text or "") for text in texts.to_pylist()]
        return [keys, pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary())]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>, decoded binary", encode)


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document, and ``ids`` if asked for.

    The same encoding and decoding as :func:`encode_documents`, digested where it is made, so that
    bytes never leave the Python worker.
    """

    def digest(keys: pa.Array, texts: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        names = decimals(len(own.bytes_of))
        counts, of_ids, of_bytes, all_ids = [], [], [], []
        for text in texts.to_pylist():
            ids = own.encode(text or "")
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            if with_ids:
                all_ids.append(ids)
        columns = [keys, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        return [*columns, pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else columns

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_columns(docs, [id_col, text_col], schema, digest)


@lru_cache(maxsize=2)
def decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]
