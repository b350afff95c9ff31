"""Token-ID output: files of ids in a byte-aligned variable-length coding.

Ids are replaced by their rank in the order of falling frequency over the whole corpus, so that the
common ones need one byte. A rank takes one to four bytes; how many is kept apart from the bytes
themselves, two bits a rank, four ranks in a control byte. A decoder looks a control byte up in a table
and knows where four ranks lie, so numpy decodes a whole file without a loop over ids.

Documents are range-partitioned by id, so files hold them in ascending order: file names sort like the
ids of their documents, and end with their number of ids. Each file begins with a header, the lengths and
ids of its documents and the control bytes, then the data bytes; ``ranks.ids`` holds the ids in order of
rank. Files are coded in windows of WINDOW ids, so memory follows the coded bytes of a file, not its ids.

Defined cases: a null text has only the end id; documents with a null id come first; equal ids are
ordered by a hash of the text; a document longer than a file has a file of its own; strings of added
tokens in a text become these tokens, as the library has it; an empty table gives no files and an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import discard, own_dir, written

MAGIC = b"LWIDS1\x00\x00"
HEADER = struct.Struct("<8sqqqqq")  # magic, shard, first block, documents, ids, data bytes
#: Ids of a file and of a block of the table before it, about; ids that are coded at once (a multiple of four).
FILE_IDS, BLOCK_IDS = 8_000_000, 250_000
WINDOW = 1 << 19
#: Parts that a generation of the memo holds, about; bytes of the longest of them; bytes of texts that are cut together, about.
MEMO, LONG, TEXT_BYTES = 400_000, 100, 1 << 22
#: Texts with this (and with added tokens) are not cut: a control or what may be white space beyond ASCII, before white space.
ODD = r"[\x{0}-\x{8}\x{e}-\x{1f}\x{7f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][\x{9}-\x{d} ]"
#: What is one piece for the pre-tokenizer, whatever stands beside it in a text that is cut there.
ONE_PIECE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɿЀ-ѿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|[\t-\r]").fullmatch
#: Letters of two bytes, and two signs among them.
LETTERS = [*range(0xC0, 0x280), *range(0x400, 0x480)]
#: Kinds of bytes. Letters are ASCII's and the first bytes of LETTERS.
OTHER, LETTER, DIGIT, MARK, SPACE, BLANK = range(6)
KINDS = np.zeros(256, np.uint8)
KINDS[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = MARK
KINDS[[*b"0123456789"]] = DIGIT
KINDS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA), 0xD0, 0xD1]] = LETTER
KINDS[32], KINDS[9:14] = SPACE, BLANK
NULL_ID = -(2**63)


# --- the coding


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks`` (unsigned, below 2**32)."""
    controls, data = [], []
    for at in range(0, len(ranks), WINDOW):
        part = ranks[at : at + WINDOW].astype("<u4")
        width = 1 + (part >= 1 << 8).astype(np.uint8) + (part >= 1 << 16) + (part >= 1 << 24)
        padded = np.zeros(-(-len(part) // 4) * 4, np.uint8)
        padded[: len(part)] = width - 1
        controls.append((padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)).astype(np.uint8).tobytes())
        data.append(part.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]].tobytes())
    return b"".join(controls), b"".join(data)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every control byte: the widths of its four ranks and the sum of them."""
    widths = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
    return widths.astype(np.int32), widths.sum(axis=1)


def decoded_windows(control: np.ndarray, data: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The ``n`` ranks of control and data bytes, WINDOW at a time."""
    widths_of, sums = _tables()
    begin = 0
    for at in range(0, n, WINDOW):
        bytes_ = control[at // 4 : (at + WINDOW) // 4]
        widths = widths_of[bytes_].ravel()[: n - at]
        ends = np.cumsum(widths, dtype=np.int32)
        starts = ends - widths
        own = np.zeros(int(ends[-1]) + 4, np.uint8)
        own[: ends[-1]] = data[begin : begin + int(ends[-1])]
        begin += int(ends[-1])
        ranks = own[starts].astype(np.uint32)
        for k in range(1, 4):
            wide = np.flatnonzero(widths > k)
            ranks[wide] |= own[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
        yield ranks


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    return np.concatenate([np.empty(0, np.uint32), *decoded_windows(control, data, n)])


def pack_file(shard: int, block: int, doc_ids: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = HEADER.pack(MAGIC, shard, block, len(doc_ids), len(ranks), len(data))
    return b"".join([head, lengths.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes(), control, data])


def unpack_file(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(shard, block, ids of documents, lengths, windows of ranks) of a file."""
    magic, shard, block, documents, n, size = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = HEADER.size
    lengths = np.frombuffer(raw, "<i8", documents, at)
    doc_ids = np.frombuffer(raw, "<i8", documents, at + 8 * documents)
    at += 16 * documents
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.frombuffer(raw, np.uint8, size, at + len(control))
    return shard, block, doc_ids, lengths, decoded_windows(control, data, n)


def checksums(lengths: np.ndarray, windows: Iterator[np.ndarray], id_of: np.ndarray) -> np.ndarray:
    """The crc32 of the ids of each document, whose ids may lie in several windows."""
    ends = np.cumsum(lengths).tolist()
    sums, doc, at, first, crc = [], 0, 0, 0, 0
    for ranks in windows:
        octets = memoryview(id_of[ranks].astype("<u4").tobytes())
        last = first + len(ranks)
        while at < last:
            to = min(ends[doc], last)
            crc = zlib.crc32(octets[4 * (at - first) : 4 * (to - first)], crc)
            at = to
            if at == ends[doc]:
                sums.append(crc)
                doc, crc = doc + 1, 0
        first = last
    return np.array(sums, np.int64)


# --- the tokenizer


class _Memo:
    """Ids by part in two generations: when the young one is full it becomes the old one."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, parts: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of distinct parts; ``learn`` gives those that neither generation has."""
        found = list(map(self.young.get, parts))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in gaps:
            known = found[i] = self.old.get(parts[i])
            if known is None:
                unknown.append(i)
        for i, ids in zip(unknown, learn([parts[i] for i in unknown]), strict=True):
            found[i] = ids
        if len(self.young) + len(gaps) > MEMO:
            self.old, self.young = self.young, {}
        self.young.update((parts[i], found[i]) for i in gaps if len(parts[i]) <= LONG)
        return found


class ChunkTokenizer:
    """A tokenizer of the tokenizers library with a memo.

    The UTF-8 bytes of many texts are cut together, with numpy, at places where the library's byte-level
    pre-tokenizer always cuts: before white space, after a single blank that is no space, and where
    letters, digits and marks meet. So the ids of the parts are the ids of the text. Letters are Latin
    and Cyrillic ones here; other characters, and the apostrophe, stay with what they touch. Arrow finds
    the distinct parts and puts their ids in the places of the parts. A part that is one piece for the
    pre-tokenizer goes straight to the library's merges, others go to the library as they are, and so do
    whole texts with added tokens or rare white space (ODD).
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = ["\ufffe"] * 256  # how the byte-level alphabet spells bytes; this one is no byte
        for c in map(chr, [*range(128), *LETTERS]):
            for byte, sign in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                spelled[byte] = sign
        self.alphabet = "".join(spelled)
        self.octets = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=-1))]
        self.memo = _Memo()
        self.uncut = "|".join([ODD, *map(re.escape, added)])  # these texts go to the library whole

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, from the library."""
        merge, octets, alphabet = self.merge, self.octets, self.alphabet
        found, others = [], []
        for part in parts:
            text = part.decode()
            if ONE_PIECE(text):
                found.append(b"".join([octets[t.id] for t in merge(charmap_decode(part, "strict", alphabet)[0])]))
            else:
                others.append((len(found), text))
                found.append(b"")
        for (i, _), ids in zip(others, self._plain([text for _, text in others]), strict=True):
            found[i] = ids
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text (null: empty), as little-endian 32-bit numbers."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        apart = pc.match_substring_regex(column, self.uncut)
        whole = np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()
        raw, bounds = _octets(pc.if_else(apart, "", column) if whole else column)
        starts = part_starts(raw, bounds)
        ends = np.append(starts, len(raw)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self.memo.ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn), pa.large_binary())
        octets, at = _octets(ids.take(parts.indices))
        cuts = at[np.searchsorted(starts, bounds)].tolist()
        found = [octets[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
        for i, own in zip(whole, self._plain([column[i].as_py() for i in whole]), strict=True):
            found[i] = own
        return found


def _octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column of strings or bytes without nulls, and where each begins, and the end."""
    kind = np.int64 if column.type == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, kind)
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def part_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts of UTF-8 texts begin; texts begin at ``bounds``, the last of which is the end of all."""
    if not len(raw):
        return np.empty(0, np.int64)
    kind = KINDS[raw]
    leads = np.flatnonzero((raw >= 0xC3) & (kind == LETTER))
    second = raw[leads + 1]
    kind[leads + 1] = LETTER
    signs = leads[(raw[leads] == 0xC3) & ((second == 0x97) | (second == 0xB7))]  # the signs of multiplication and division
    kind[signs] = kind[signs + 1] = OTHER
    white = kind >= SPACE
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(raw), bool)
    cut[1:] = ~white[:-1] & (white[1:] | (before != after) & (before != OTHER) & (after != OTHER))
    cut[2:] |= ~white[:-2] & (kind[1:-1] == BLANK) & ~white[2:] & (kind[2:] != OTHER)
    cut[bounds[bounds < len(raw)]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


# --- the output


BLOCKS = "shard long, block long, documents long, ids long, doc_ids binary, lengths binary, tokens binary, counts binary"


def token_blocks(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents in ascending order of id: a shard is a range of ids, its blocks follow each other.
    ``counts`` has the distinct ids of a block and then how often each stands in it."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("mark"))
    ordered = own.repartitionByRange(parts, "id", "mark").sortWithinPartitions("id", "mark").drop("mark")  # equal ids are many ranges

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 + 1 for x in ids], "<i8")
            tokens = end.join(ids) + end
            found = np.bincount(np.frombuffer(tokens, "<u4"))
            seen = np.flatnonzero(found)
            counts = np.concatenate([seen, found[seen]]).astype("<u4").tobytes()
            row = [shard, block, len(doc_ids), held, np.array(doc_ids, "<i8").tobytes(), lengths.tobytes(), tokens, counts]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
                part, at = batch.slice(at, to - at), to
                for key, found in zip(part.column(0).to_pylist(), tokenizer(path).encode(part.column(1)), strict=True):
                    n = len(found) // 4 + 1
                    if held and held + n > BLOCK_IDS:
                        yield flush()
                        block, doc_ids, ids, held = block + 1, [], [], 0
                    doc_ids.append(key)
                    ids.append(found)
                    held += n
        if doc_ids:
            yield flush()

    return ordered.mapInArrow(tokenize, BLOCKS)


def ranked_ids(blocks: DataFrame) -> np.ndarray:
    """The ids of the corpus by falling frequency, ties to the smaller id.

    Blocks come with their counts, tasks add them up and Spark sums what tasks have; what reaches the driver
    is a row for each id of the vocabulary at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                ids, found = np.frombuffer(raw.as_buffer(), "<u4").reshape(2, -1)
                total = np.pad(total, (0, max(0, int(ids[-1]) + 1 - len(total))))  # ids ascend
                total[ids] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = blocks.select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "id").toPandas()
    return found["id"].to_numpy(np.uint32)


def _put(folder: str, name: str, raw: bytes) -> None:
    """Write a file whole or not at all: tasks may be run again or twice."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(raw)
    store.move(draft, f"{path}/{name}")


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Encode all documents into files below ``folder``; gives the number of files."""
    blocks = written(token_blocks(docs, path, end_id, id_col, text_col), "tokens")
    ids = ranked_ids(blocks)
    _put(folder, "ranks.ids", ids.astype("<u4").tobytes())
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(rank_of)  # a number for each id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            first, n = held[0], sum(row["ids"] for row in held)
            join = lambda name: np.frombuffer(b"".join(row[name] for row in held), "<i8")
            doc_ids, lengths = join("doc_ids"), join("lengths")
            ranks = np.concatenate([row["ranks"] for row in held])
            _put(folder, f"ids-{first['shard']:08d}-{first['block']:08d}-{n}.bin", pack_file(first["shard"], first["block"], doc_ids, lengths, ranks))
            return pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["files"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                row["ranks"] = shared.value[np.frombuffer(row.pop("tokens"), "<u4")]
                full = sum(x["ids"] for x in held) + row["ids"] > FILE_IDS
                if held and (full or row["shard"] != held[-1]["shard"] or row["block"] != held[-1]["block"] + 1):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    files = blocks.drop("counts").mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    discard(blocks)
    return files


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)


def _ids_by_rank(spark: SparkSession, folder: str):
    """The ids in order of rank, a number for each id of the vocabulary at most, on all executors."""
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks.ids").select("content").first()
    return spark.sparkContext.broadcast(np.frombuffer(bytes(ranks.content) if ranks else b"", "<u4"))  # an empty file is no row


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, block, place, doc_id, start, ids) of every document in the files of ``folder``; ``start`` counts
    the ids before the document in its file."""
    id_of = _ids_by_rank(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                shard, block, doc_ids, lengths, windows = unpack_file(raw.as_py())
                ids = np.concatenate([np.empty(0, "<u4"), *(id_of.value[ranks] for ranks in windows)])
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                for at in range(0, len(doc_ids), 256):
                    to = min(at + 256, len(doc_ids))
                    n = to - at
                    lists = pa.ListArray.from_arrays(pa.array(starts[at : to + 1] - starts[at], pa.int32()), pa.array(ids[starts[at] : starts[to]].astype(np.int64), pa.int64()))
                    columns = [np.full(n, shard), np.full(n, block), np.arange(at, to), doc_ids[at:to], starts[at:to]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], lists], names=["shard", "block", "place", "doc_id", "start", "ids"])

    return _files(spark, folder).select("content").mapInArrow(read, "shard long, block long, place long, doc_id long, start long, ids array<long>")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files below ``folder``.

    Sums over the numbers of ids that end the names of the files turn a place in a file into the place in
    the corpus; no content is read for them.
    """
    id_of = _ids_by_rank(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                shard, block, doc_ids, lengths, windows = unpack_file(raw.as_py())
                sums = checksums(lengths, windows, id_of.value)
                n = len(doc_ids)
                columns = [np.full(n, shard), np.full(n, block), doc_ids, np.cumsum(lengths) - lengths, lengths, sums]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["shard", "block", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = _files(spark, folder).select("content").mapInArrow(read, "shard long, block long, doc_id long, start long, n_tokens long, ids_crc32 long")
    part = lambda i: F.regexp_extract("path", r"ids-(\d+)-(\d+)-(\d+)\.bin", i).cast("long")
    files = _files(spark, folder).select(part(1).alias("shard"), part(2).alias("block"), part(3).alias("ids"))
    shards = files.groupBy("shard").agg(F.sum("ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    blocks = files.withColumn("inside", F.sum("ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("ids"))
    places = blocks.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))
    found = found.join(places, ["shard", "block"])
    return found.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/ids-{uuid.uuid4().hex}"
