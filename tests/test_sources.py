"""The byte-range source, the stream over it, encodings and ordered operators."""

import os
import random

import pytest
import regex
from pyspark.sql import functions as F

from logweave.functions.text import check_pattern, compile_pattern
from logweave.operators.file_search import file_matches, file_pattern, first_matches, matches_in_range
from logweave.operators.ordered import as_of, dense_index, last_before, sum_before
from logweave.sources import bytelog, encoding, index, rewrite
from logweave.streaming import tail


def test_ranges_never_lose_or_repeat_a_line(tmp_path):
    rng = random.Random(1)
    data = b"\n".join(bytes(rng.choice(b"ab\xc3\xa9\r") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(200)) + b"\nlast"
    path = tmp_path / "log"
    path.write_bytes(data)
    whole = list(bytelog.read_range(str(path), 0, len(data)))
    assert [line for _, line in whole] == data.split(b"\n")
    for size in (1, 7, 64, 1000):
        parts = [x for at in range(0, len(data), size) for x in bytelog.read_range(str(path), at, min(len(data), at + size))]
        assert parts == whole


def test_line_table_of_a_file(spark, tmp_path):
    text = "\n".join(f"line {i} é" for i in range(500)) + "\n"
    (tmp_path / "log.txt").write_text(text)
    rows = bytelog.read_lines(spark, str(tmp_path / "log.txt"), 700).orderBy("line_number").collect()
    assert [r.line_number for r in rows] == list(range(1, 501))
    assert all(text.encode()[r.file_offset : r.file_offset + r.line_len].decode() == r.raw for r in rows)


def test_tail_reads_only_whole_lines(spark, tmp_path):
    path = tmp_path / "grow.log"
    path.write_bytes(b"one test\ntwo\nhalf")
    found = tail.tail_matches(spark, str(path), compile_pattern("test"))
    query = found.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        with path.open("ab") as f:
            f.write(b" test\nthree test\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.byte_offset for r in spark.sql("SELECT byte_offset FROM grown").collect()) == [4, 18, 29]


@pytest.mark.parametrize("name", encoding.ENCODINGS)
def test_files_in_every_encoding(spark, tmp_path, name):
    rows = ["häß 1", "", "two\r", "x" * 300, "ਊ" if name.startswith("UTF") else "€ä", "last"]
    codec = "cp1252" if name in ("windows-1252", "ISO-8859-1") else name
    feed, mark = "\n".encode(codec), bytelog.BOMS.get(name, b"")
    cut = [row.encode(codec) for row in rows]
    path = tmp_path / "log"
    path.write_bytes(mark + feed.join(cut))
    starts = [len(mark) * bool(i) + sum(len(c) + len(feed) for c in cut[:i]) for i in range(len(cut))]
    want = [(i + 1, at, row.removesuffix("\r")) for i, (at, row) in enumerate(zip(starts, rows, strict=True))]
    for chosen in (name, None):
        got = bytelog.load(spark, str(path), chosen, range_bytes=64).orderBy("line_number").collect()
        assert [(r.line_number, r.file_offset, r.raw) for r in got] == want or (chosen is None and name == "ISO-8859-1")
    info = bytelog.source_info(spark, str(path)).first()
    assert (info.bytes, info.total_lines, info.encoding) == (path.stat().st_size, 6, "windows-1252" if name == "ISO-8859-1" else name)


def test_bounds_of_offsets_reach_the_source(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"line {i}\n" for i in range(1000)))
    rows = bytelog.scan(spark, str(tmp_path / "log"), 512)
    few = bytelog.scan(spark, str(tmp_path / "log"), 512, max_offset=700)
    assert few.count() == rows.where("file_offset <= 700").count() > 0
    assert few.rdd.getNumPartitions() == 2 and rows.rdd.getNumPartitions() > 10


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
def test_replacement_in_a_file_keeps_all_other_bytes(spark, tmp_path, size):
    """Line ends, a missing last one, a byte-order mark, invalid bytes and blank lines stay as they are."""
    data = b"\xef\xbb\xbfone two\r\ntwo\n\n\xff\xfe two \xc3\r\r\n" + "é two ü\n".encode() * 20 + b"the last two"
    path, out = tmp_path / "log", tmp_path / "out"
    path.write_bytes(data)
    rewrite.replace_all(spark, str(path), str(out), compile_pattern("two"), "2$1", range_bytes=size)
    parts = sorted(x for x in out.iterdir() if x.name.startswith("part-"))
    assert b"".join(x.read_bytes() for x in parts) == data.replace(b"two", b"2$1")
    again = bytelog.read_lines(spark, str(out), size)
    assert again.count() == data.count(b"\n") + 1 and again.select("source_id").distinct().count() == 1
    edits = spark.createDataFrame([(9, 3, b"ONE"), (18, 0, b"+"), (len(data) - 3, 3, b"")], "offset long, old_len long, new_bytes binary")
    rewrite.apply_edits(spark, str(path), str(path), edits, range_bytes=size)  # in place
    want = data[:9] + b"ONE" + data[12:18] + b"+" + data[18:-3]
    assert b"".join(x.read_bytes() for x in sorted(path.iterdir()) if x.name.startswith("part-")) == want


def test_encodings(spark):
    rows = [(b"\xef\xbb\xbfa", "UTF-8"), (b"\xff\xfea\0", "UTF-16LE"), (b"\xfe\xff\0a", "UTF-16BE"), (b"abc", "UTF-8"), (b"\xff\xff\xff", "windows-1252")]
    found = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "data binary, want string").withColumn("got", encoding.detect(F.col("data")))
    assert all(r.got == r.want for r in found.collect())
    cut = spark.createDataFrame([(bytearray("aaé".encode()),)], "data binary").select(encoding.detect(F.col("data"), 3).alias("x")).first().x
    assert cut == "UTF-8"


def test_last_before_and_dense_index(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, i])) for k in (1, 2, None) for i in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {(r.k, r.i): r.p for r in last_before(df, ["k"], "i", "v", "p", width=16).collect()}
    for k, i, _ in rows:
        assert got[k, i] == max((v for a, b, v in rows if a == k and b < i and v is not None), default=None)
    ranks = {(r.k, r.i): r.n for r in dense_index(df, ["k"], "i", "n", width=16).collect()}
    assert all(ranks[k, i] == sum(1 for a, b, _ in rows if a == k and b < i) for k, i, _ in rows)


def test_tail_counts_in_small_batches(spark, tmp_path):
    path = tmp_path / "grow.log"
    path.write_bytes(b"".join(b"test %d\n" % i for i in range(300)) + b"x" * 500 + b" test\nhalf test")
    rows = tail.tail_lines(spark, str(path), max_bytes=100)
    query = rows.writeStream.format("memory").queryName("small").option("checkpointLocation", str(tmp_path / "a")).start()
    query.processAllAvailable(), query.stop()
    seen = sorted((r.file_offset, r.line_len) for r in spark.sql("SELECT * FROM small").collect())
    lines = path.read_bytes().split(b"\n")[:-1]
    assert seen == [(sum(len(x) + 1 for x in lines[:i]), len(x)) for i, x in enumerate(lines)]
    counts = tail.tail_counts(spark, str(path), compile_pattern("test"))
    query = counts.writeStream.format("memory").outputMode("complete").queryName("counted").option("checkpointLocation", str(tmp_path / "b")).start()
    query.processAllAvailable(), query.stop()
    assert [(r.n_lines, r.n_matches) for r in spark.sql("SELECT * FROM counted").collect()] == [(301, 301)]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    path = tmp_path / "grow.log"
    for part in (b"one\ntwo\n", b"three\nfour\n", b""):
        with path.open("ab") as f:
            f.write(part)
        query = tail.tail_lines(spark, str(path)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable(), query.stop()
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["four", "one", "three", "two"]


def test_patterns_are_refused_early(spark):
    check_pattern(spark, compile_pattern("a(b", use_regex=False))
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        check_pattern(spark, compile_pattern("a(b", use_regex=True))


def whole(path):
    """The bytes of a file, or of a folder of parts."""
    parts = sorted(x for x in path.iterdir() if x.name.startswith("part-")) if path.is_dir() else [path]
    return b"".join(x.read_bytes() for x in parts)


def plain_edits(data, edits):
    out, at = [], 0
    for offset, old, new in sorted(edits, key=lambda e: (e[0], e[1] > 0)):
        out += [data[at:offset], new]
        at = offset + old
    return b"".join([*out, data[at:]])


@pytest.mark.parametrize("size", [4, 64, 1 << 20])
def test_edits_anywhere_in_a_file(spark, tmp_path, size):
    """Over lines and ranges, side by side, appends, insertions at one place, everything; in place and again on parts."""
    rng, path = random.Random(size), tmp_path / "log"
    data = b"\n".join(bytes(rng.choice(b"abc\xc3\xa9\r") for _ in range(rng.choice([0, 3, 30]))) for _ in range(12))
    path.write_bytes(data)
    schema = "offset long, old_len long, new_bytes binary, seq long"
    for _ in range(3):
        data = whole(path)
        edits, at = [], rng.randrange(5)
        while at < len(data):
            old = min(rng.choice([0, 1, 4, 25]), len(data) - at)
            edits.append((at, old, rng.choice([b"", b"+", b"new\nline\n", b"x" * 90])))
            at += old + rng.choice([0, 1, 9]) + (old == 0)
        edits.append((len(data), 0, b"end"))
        edits.append((len(data), 0, b" and more\n"))
        rewrite.apply_edits(spark, str(path), str(path), spark.createDataFrame([(*e, i) for i, e in enumerate(edits)], schema), range_bytes=size)
        assert whole(path) == plain_edits(data, edits)
    lines = bytelog.read_lines(spark, str(path), size).orderBy("line_number").collect()  # lines go over the borders of parts
    cut = whole(path).removesuffix(b"\n").split(b"\n")
    assert [r.raw for r in lines] == [x.removesuffix(b"\r").decode("utf-8", "replace") for x in cut] and [r.line_number for r in lines] == list(range(1, len(cut) + 1))
    rewrite.apply_edits(spark, str(path), str(tmp_path / "gone"), spark.createDataFrame([(0, len(whole(path)), b"", 0)], schema), range_bytes=size)
    assert whole(tmp_path / "gone") == b""


def test_edits_that_cannot_hold_are_refused(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"one\ntwo\nthree\n")
    schema = "offset long, old_len long, new_bytes binary"
    for wrong in ([(15, 0, b"x")], [(-1, 1, b"x")], [(12, 9, b"")], [(0, 3, b"x"), (2, 1, b"y")], [(0, 9, b"x"), (4, 0, b"y")], [(1, 2, b"x"), (1, 2, b"x")]):
        with pytest.raises(ValueError, match="edits"):
            rewrite.apply_edits(spark, str(path), str(path), spark.createDataFrame(wrong, schema), range_bytes=8)
    assert path.read_bytes() == b"one\ntwo\nthree\n"
    rewrite.apply_edits(spark, str(path), str(path), spark.createDataFrame([], schema))
    assert whole(path) == b"one\ntwo\nthree\n"
    (tmp_path / "empty").write_bytes(b"")
    rewrite.apply_edits(spark, str(tmp_path / "empty"), str(tmp_path / "empty"), spark.createDataFrame([(0, 0, b"first")], schema))
    assert whole(tmp_path / "empty") == b"first"


def test_edits_meet_their_ranges_without_a_cartesian_product(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"x\n" * 100)
    edits = spark.createDataFrame([(i, 1, b"y") for i in range(0, 200, 2)], "offset long, old_len long, new_bytes binary")
    plan = rewrite._pieces(edits.withColumn("place", F.lit(1)), bytelog.file_ranges(spark, str(path), 16), 200, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# --- the sparse index


@pytest.mark.parametrize("name", ["UTF-8", "UTF-16LE", "UTF-16BE"])
def test_index_equals_the_whole_table(spark, tmp_path, name):
    rng = random.Random(4)
    text = "\n".join("é" * rng.choice([0, 1, 7, 400]) + str(i) for i in range(300)) + rng.choice(["", "\n"])
    path = tmp_path / "log"
    path.write_bytes(text.encode(name))
    found = index.open_index(spark, str(path), interval=512, encoding=name)
    rows = {r.line_number: tuple(r)[1:] for r in bytelog.read_lines(spark, str(path), 256, name).collect()}
    assert index.count_lines(str(path), 0, len(text.encode(name)), bytelog.LINE_FEEDS.get(name, b"\n")) == (len(rows), 0)
    for first, n in ((1, 1), (77, 3), (299, 9), (400, 1)):
        got = {r.line_number: tuple(r)[1:] for r in found.lines(first, n).collect()}
        assert got == {k: rows[k] for k in range(first, first + n) if k in rows}
    size = path.stat().st_size
    holds = lambda at: max((k for k in rows if rows[k][1] <= at), key=lambda k: rows[k][1])
    for at in (0, 600, size // 2, size - 1):
        assert [r.line_number for r in found.at_offset(at).collect()] == [holds(at)]
    assert found.at_offset(size).count() == 0 and found.bytes(5, 5).count() == 0
    assert sorted(r.line_number for r in found.bytes(700, 1900).collect()) == list(range(holds(700), holds(1899) + 1))
    asked = [(str(path), x) for x in (1, 5, 5, 150, 300, 301, 0)]
    got = found.look_up(spark.createDataFrame(asked, "source_id string, asked long")).collect()
    assert sorted((r.asked, *tuple(r)[2:]) for r in got) == sorted((x, *rows[x]) for _, x in asked if x in rows)
    places = [(str(path), x) for x in (0, 3, 600, size // 2, size - 1, size, -1)]
    got = found.look_up(spark.createDataFrame(places, "source_id string, asked long"), by="offset").collect()
    assert sorted((r.asked, r.line_number) for r in got) == [(x, holds(x)) for _, x in places if 0 <= x < size]
    with pytest.raises(ValueError, match="begin at 1"):
        found.lines(0)


def test_point_lookups_read_one_range_of_a_large_file(spark, tmp_path):
    path = tmp_path / "log"
    with path.open("w") as f:
        f.writelines(f"line {i} {'x' * (i % 17)}\n" for i in range(1, 1_000_101))
    found = index.open_index(spark, str(path), interval=1_000_000)
    one = found.lines(1_000_000)
    assert one.rdd.getNumPartitions() == 1 and one.first().raw == f"line 1000000 {'x' * (1_000_000 % 17)}"
    near = found.at_offset(one.first().file_offset + 3)
    assert near.first().line_number == 1_000_000 and found.table.count() > 15
    assert found.counted > 15 and index.open_index(spark, str(path), interval=1_000_000).counted == 0  # it is there already


def test_an_index_follows_its_file(spark, tmp_path):
    """A longer file keeps the intervals that are full, a changed one loses those from the change on, folders are many sources."""
    path = tmp_path / "log"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(1000)))
    last = lambda: (lambda x: (x.lines(x.table.agg(F.max(F.col("first_line") + F.col("lines") - 1)).first()[0]).first().raw, x.counted))(index.open_index(spark, str(path), interval=500))
    assert last() == ("line 999", 18)
    with path.open("ab") as f:
        f.write(b"more\n" * 150 + b"the last")
    assert last() == ("the last", 3) and len([x for x in (tmp_path / "log.lines").iterdir() if x.is_dir()]) == 1
    data = path.read_bytes()
    path.write_bytes(data[:4400] + b"\nchanged\n" + data[4409:])
    assert last()[1] == 12 and index.open_index(spark, str(path), interval=500).table.agg(F.sum("lines")).first()[0] == path.read_bytes().count(b"\n") + 1
    os.mkdir(tmp_path / "many")
    for k in range(3):
        (tmp_path / "many" / f"{k}.log").write_bytes(b"".join(b"%d of %d\n" % (i, k) for i in range(50 * k)))
    several = index.open_index(spark, str(tmp_path / "many"), interval=64)
    assert sorted(r.raw for r in several.lines(50).collect()) == ["49 of 1", "49 of 2"]
    assert [r.raw for r in several.lines(70, 1, str(tmp_path / "many" / "2.log")).collect()] == ["69 of 2"]


def test_sums_and_as_of(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.randint(0, 9)) for k in ("a", "b", None) for i in rng.sample(range(300), 50)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r.k, r.i): r.s for r in sum_before(df, ["k"], "i", "v", "s", width=16).collect()}
    assert all(got[k, i] == sum(v for a, b, v in rows if a == k and b < i) for k, i, _ in rows)
    asked = spark.createDataFrame([(k, at, at) for k in ("a", "b") for at in (-1, 0, 50, 77, 400)], "k string, at long, tag long")
    for r in as_of(asked, df, ["k"], "at", "i", ["i", "v"], width=16).collect():
        assert (r.i, r.v) == max(((i, v) for k, i, v in rows if k == r.k and i <= r.at), default=(None, None)) and r.tag == r.at


# --- matches over line ends

PATTERNS = [("b\na", False), ("é\r\n", False), (r"a[^x]*?b", True), (r"\s+", True), (r"(?:a.*\n)+", True), (r"^b?$", True), (r"(?<=\n)é|a(?!b)", True), (r"ab|abab\n|(a[\s\S]{5}b)", True), (r"\bbé\b", True)]


def plain_matches(data, pattern):
    text, at, out, offset = data.decode("utf-8", "surrogateescape"), 0, [], 0
    for m in pattern.finditer(text):
        offset += len(text[at : m.start()].encode("utf-8", "surrogateescape"))
        at = m.start()
        if m.end() > m.start():
            out.append((offset, len(m[0].encode("utf-8", "surrogateescape"))))
    return out


def in_ranges(path, size, pattern, total, look):
    """The rounds of the operator, range by range in order."""
    out, entry = [], 0
    for at in range(0, total, size):
        found = list(matches_in_range(path, at, min(total, at + size), max(entry, at), pattern, look))
        entry = max([entry, *(a + n for a, n in found)])
        out += found
    return out


@pytest.mark.parametrize("query", PATTERNS, ids=range(len(PATTERNS)))
def test_matches_over_line_ends_in_ranges_of_any_size(tmp_path, query):
    rng, path = random.Random(9), tmp_path / "log"
    pattern = file_pattern(*query)
    for k in range(12):
        data = b"".join(rng.choice([b"a", b"b", b"ab", b"\n", b"\r\n", "é".encode(), " ".encode(), "中".encode(), *[b"\xc3", b"\xa9"] * (k % 2)]) for _ in range(300))
        path.write_bytes(data)
        for size, look in ((1, 64), (7, 64), (50, 80), (1000, 64)):
            assert in_ranges(str(path), size, pattern, len(data), look) == plain_matches(data, pattern)


def test_matches_of_a_file_and_of_parts(spark, tmp_path):
    rng, path = random.Random(10), tmp_path / "log"
    data = b"".join(rng.choice([b"one", b"two", b"\n", b" ", b"xyz" * 30]) for _ in range(600)) + b"one\n" + b"long " * 200 + b"\ntwo"
    path.write_bytes(data)
    for query in (("one\ntwo", False, True), (r"one[\s\S]*?two", True), (r"(?:xyz)+\s", True)):
        pattern = file_pattern(*query)
        got = file_matches(spark, str(path), pattern, range_bytes=61, look=16)
        assert sorted((r.byte_offset, r.match_len) for r in got.collect()) == plain_matches(data, pattern)
    rewrite.apply_edits(spark, str(path), str(tmp_path / "parts"), spark.createDataFrame([(0, 0, b"one\n")], "offset long, old_len long, new_bytes binary"), range_bytes=100)
    got = file_matches(spark, str(tmp_path / "parts"), file_pattern("one\nt"), range_bytes=90, look=16)
    assert sorted((r.byte_offset, r.match_len) for r in got.collect()) == plain_matches(b"one\n" + data, file_pattern("one\nt"))
    assert regex.compile("x").pattern == "x"


def test_first_matches_stop_early(spark, tmp_path):
    os.mkdir(tmp_path / "logs")
    texts = [b"none here\n" * 40, b"x one\ntwo " + b"y" * 900 + b" one\ntwo", b"one" + b"\ntwo" * 50 + b" one\ntwo\n" + b"z" * 5000]
    for k, data in enumerate(texts):
        (tmp_path / "logs" / f"{k}.log").write_bytes(data)
    for query in (("one\ntwo", False), (r"one[\s\S]*?two", True), (r"(?:\ntwo)+", True), ("nowhere", False)):
        pattern = file_pattern(*query)
        every = [(k, *m) for k, data in enumerate(texts) for m in plain_matches(data, pattern)]
        for limit in (1, 2, 50):
            got, searched = first_matches(spark, str(tmp_path / "logs"), pattern, limit, range_bytes=50, look=16, wave=2)
            assert [(int(r.source_id[-5]), r.byte_offset, r.match_len) for r in got.collect()] == every[:limit]
            assert searched <= 14 or limit > 1 or not every
            assert searched > 100 or len(every) >= limit


# --- generations of a log


def appended(spark, path, tmp_path, steps):
    """What a stream over a log sees while ``steps`` change it, restarted before each of them."""
    for step in steps:
        step()
        query = tail.tail_lines(spark, str(path)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable(), query.stop()
    return sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect())


@pytest.mark.parametrize("way", ["truncate", "rotate", "copy", "rewrite"])
def test_a_stream_follows_a_log_through_its_generations(spark, tmp_path, way):
    path = tmp_path / "app.log"
    old = [f"old {i}" for i in range(30)]
    new = [f"new {i}" for i in range(60)]  # longer than the old one before the next look

    def begin():
        path.write_text("".join(f"{x}\n" for x in old[:20]))

    def change():
        if way in ("rotate", "copy"):  # written after the last look, and gone from the path
            with path.open("a") as f:
                f.writelines(f"{x}\n" for x in old[20:])
            (path.rename if way == "rotate" else lambda to: to.write_bytes(path.read_bytes()))(tmp_path / "app.log.1")
        path.write_text("".join(f"{x}\n" for x in (new if way == "rewrite" else new[:5])))

    def grow():
        with path.open("a") as f:
            f.writelines(f"{x}\n" for x in ([] if way == "rewrite" else new[5:]))

    got = appended(spark, path, tmp_path, [begin, change, grow, lambda: None])
    assert got == sorted((old if way in ("rotate", "copy") else old[:20]) + new)


def test_a_running_stream_follows_a_truncated_log(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("one\ntwo\nthree\n")
    query = tail.tail_lines(spark, str(path), max_bytes=64).writeStream.format("memory").queryName("generations").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        path.write_text("four\n")
        query.processAllAvailable()
        path.unlink()
        query.processAllAvailable()
        path.write_text("five\nsix\nseven\neight\n")
        query.processAllAvailable()
        with path.open("a") as f:
            f.write("nine\nhalf")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.raw for r in spark.sql("SELECT raw FROM generations").collect()) == sorted("one two three four five six seven eight nine".split())
