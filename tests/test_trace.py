"""Parsing of trace lines and data flow, on random programs against a plain interpreter."""

import random

import pytest
import trace_model as model
from pyspark.sql import functions as F

from logweave.functions.text import compile_pattern
from logweave.operators import dataflow, hits, job, lines, replace, search, trace
from logweave.storage import checkpoint

PROGRAMS = [model.program(seed, n) for seed, n in ((1, 40), (2, 70), (3, 70), (4, 25))]
STEPS = [steps for _, steps in PROGRAMS]


@pytest.fixture(scope="module")
def text_lines(spark):
    texts = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(PROGRAMS)], "id long, text string")
    return checkpoint(lines.lines_of_texts(texts, "id", "text"))


@pytest.fixture(scope="module")
def insns(text_lines):
    return checkpoint(dataflow.with_rules(trace.parse_trace(text_lines)))


def test_instructions_and_their_accesses(insns):
    rows = {(r.source_id, r.idx): r for r in insns.collect()}
    assert len(rows) == sum(map(len, STEPS))
    for (source, idx), r in rows.items():
        step = STEPS[source][idx]
        assert (r.mnemonic, r.category, r.dst, r.src, r.sets_flags) == (step.mnemonic, step.category, step.dst, step.src, step.sets_flags)
        assert r.has_writeback_base == (step.base is not None)
        for got, want in ((r.reads, step.reads), (r.writes, step.writes)):
            assert [(a.addr, a.val, a.inferred) for a in got] == [(addr, value, value is None) for addr, value in want]
        assert {(f.in_loc, f.out_loc) for f in r.flow} == set(step.flows())


def test_lines_that_are_no_instructions(spark):
    text = '\nlibq.so!10 0x10: "\tadd\tx1, x2, #1"\nnoise\nMEM W 0x20 [8 bytes]: 05 00 00 00 00 00 00 00\nlibq.so!14 0x14: garbled\nMEM R 0x30 [8 bytes]: 01 00 00 00 00 00 00 00\n'
    text += '\t-> libq.so!f(1)\nMEM R 0x30 [8 bytes]: 01 00 00 00 00 00 00 00\nlibq.so!18 0x18: "\t"\n[libq.so] !20 plain\nlibq.so!1c 0x1c: "STNP W3, W4, [X5]"\nMEM W 0xfffffffffffffffc [4 bytes]: 01 00 00 00\n'
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    rows = trace.parse_trace(lines.lines_of_texts(texts, "id", "text")).orderBy("idx").collect()
    assert [(r.line_number, r.category, [a.addr for a in r.writes], len(r.reads)) for r in rows] == [(2, "Arithmetic", [0x20], 0), (7, "ExternalCall", [], 0), (11, "Store", [-4, 0], 0)]
    assert rows[2].pair_reg_size == 4 and rows[2].src == [3, 4, 5] and rows[2].writes[1].inferred and rows[2].rel_addr == 0x1C


def ask(spark, asked):
    """Questions (source, location, start, skip) as a table."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "query_id long, source_id long, loc string, start_idx long, skip_start boolean")


def questions(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        source = rng.randrange(len(STEPS))
        start = rng.randrange(len(STEPS[source]))
        step = STEPS[source][start]
        near = [f"r{x}" for x in step.dst + step.src if x != 32] + [f"m{a:x}" for a, _ in step.reads + step.writes]
        out.append((source, rng.choice(near or ["r0", "m4f8"]), start, rng.random() < 0.3))
    return out


@pytest.mark.parametrize(("max_idle", "width"), [(3, 7), (3, 20_000), (10**6, 5), (None, 16), (1, 1)])
def test_forward(spark, insns, max_idle, width):
    asked = questions(5, 40)
    found = {}
    for r in dataflow.forward(insns, ask(spark, asked).drop("skip_start"), max_idle=max_idle, width=width).collect():
        found.setdefault(r.query_id, []).append(r)
    for i, (source, loc, start, _) in enumerate(asked):
        rows, stop, wrong = model.forward(STEPS[source], loc, start, max_idle or 10**6)
        got = found[i]
        assert sorted((r.idx, r.locs) for r in got if r.kind == "hit") == rows
        assert [r.locs for r in got if r.kind == "stop"] == [[stop]]
        assert sorted((r.idx, r.addr, r.expected, r.actual) for r in got if r.kind == "mismatch") == wrong


@pytest.mark.parametrize("width", [6, 20_000])
def test_forward_stops_at_the_end_of_a_window(spark, insns, width):
    asked = ask(spark, [(1, "r31", 0, False)]).drop("skip_start")
    at = {r.idx: r.file_offset for r in insns.where("source_id = 1").select("idx", "file_offset").collect()}
    got = dataflow.forward(insns, asked, window_bytes=at[30], width=width).collect()
    last = next(r for r in got if r.kind == "stop")
    assert (last.idx, last.locs) == (30, ["WindowEnd"]) and max(r.idx for r in got) == 30


def test_forward_along_a_chain_of_100000_rows(spark):
    """A value handed on from each row to the next one, in rounds by the logarithm of the number of ranges."""
    n = 100_000
    access = "array<struct<addr:bigint,val:bigint,inferred:boolean>>"
    i = F.col("id")
    name = lambda k: F.concat(F.lit("r"), (k % 29).cast("string"))
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("source_id"), i.alias("idx"), (10 * i).alias("file_offset"), F.array(name(i)).alias("touched"), F.array(name(i + 1)).alias("clears"),
        F.array(F.struct(name(i).alias("in_loc"), name(i + 1).alias("out_loc"))).alias("flow"), F.lit("DataMove").alias("category"), F.array().cast(access).alias("reads"), F.array().cast(access).alias("writes"),
    )
    asked = spark.createDataFrame([(1, 1, "r1", 0), (2, 1, "r5", 0), (3, 1, "r7", n + 5)], "query_id long, source_id long, loc string, start_idx long")
    rounds = []
    found = dataflow.forward(rows, asked, width=1000, window_bytes=None, checkpoint=lambda df: rounds.append(1) or checkpoint(df))
    counts = {(r.query_id, r.kind): (r.n, r.last) for r in found.groupBy("query_id", "kind").agg(F.count("*").alias("n"), F.max("idx").alias("last")).collect()}
    # r1 is handed on by every row; r5 is defined anew in row 4, before it is used; the third start is behind the end
    assert counts == {(1, "hit"): (n, n - 1), (1, "stop"): (1, n - 1), (2, "hit"): (1, 0), (2, "stop"): (1, 4)} and len(rounds) <= 20


def test_backward(spark, insns):
    asked = questions(6, 40)
    trail, left = dataflow.backward(insns, ask(spark, asked), checkpoint)
    rows, open_ = {}, {}
    for r in trail.collect():
        rows.setdefault(r.query_id, {})[r.idx] = set(r.locs)
    for r in left.collect():
        open_.setdefault(r.query_id, set()).add(r["loc"])
    for i, (source, loc, start, skip) in enumerate(asked):
        want, boundary = model.backward(STEPS[source], loc, start, skip)
        assert rows[i] == want and open_.get(i, set()) == boundary


def test_reaching_definitions(insns):
    defs = lambda step: {*step.clears(), *[o for _, o in step.flows()]}
    got = {(r.source_id, r.use_idx, r["loc"]): r.def_idx for r in dataflow.reaching_definitions(insns, width=16).collect()}
    for (source, use, loc), found in got.items():
        assert found == next((i for i in range(use - 1, -1, -1) if loc in defs(STEPS[source][i])), None)
    assert all((s, i, f"r{x}") in got for s, steps in enumerate(STEPS) for i, step in enumerate(steps) for x in step.src if x != 32)


def test_calls_are_shown_at_their_caller(insns):
    rows = {(r.source_id, r.idx): r for r in trace.call_display(insns).collect()}
    for (source, idx), r in rows.items():
        call = STEPS[source][idx].category == "ExternalCall"
        assert r.shown_line == (rows[source, idx - 1].line_number if call else r.line_number)


@pytest.mark.parametrize("mode", ["forward", "backward"])
def test_job(spark, text_lines, insns, mode):
    """The whole way from a line and a name to hits, summary and report."""
    source, start = 2, next(i for i, s in enumerate(STEPS[2]) if i > 20 and s.category == "Load")
    at = insns.where(f"source_id = {source} AND idx = {start}").first()
    loc = f"m{STEPS[source][start].reads[0][0]:x}" if mode == "forward" else f"r{STEPS[source][start].dst[0]}"
    name = f"mem:0x{loc[1:]}" if mode == "forward" else f"x{loc[1:]}"
    found = job.run(text_lines, source, name, mode, checkpoint, line_number=at.line_number)
    same = job.run(text_lines, source, name, mode, checkpoint, offset=at.file_offset)
    if mode == "forward":
        rows, stop, wrong = model.forward(STEPS[source], loc, start)
        want, open_ = {i: sorted(x) for i, x in rows}, set()
    else:
        rows, open_ = model.backward(STEPS[source], loc, start)
        want, stop, wrong = {i: sorted(x) for i, x in rows.items()}, "EndOfTrace", []
    got = {r.idx: (sorted(r.locs), r.line_number, r.raw_line, r.tainted_text) for r in found.hits.collect()}
    assert {i: x[0] for i, x in got.items()} == want and {r.idx for r in same.hits.collect()} == set(want)
    shown = {r.idx: r for r in trace.call_display(insns).where(f"source_id = {source}").collect()}
    assert all(x[1:3] == (shown[i].shown_line, shown[i].raw) for i, x in got.items())
    summary = found.summary.first()
    assert (summary.stop_reason, summary.n_hits, summary.start_line, summary.start_offset) == (stop, len(want), at.line_number, at.file_offset)
    assert {r["loc"] for r in found.boundary.collect()} == open_ and sorted((r.idx, r.addr) for r in found.mismatches.collect()) == [(i, a) for i, a, *_ in wrong]
    text = [r.line for r in found.report().collect()]
    assert text[1] == f"Source: {name}" and sum(line.startswith("      tainted: {") for line in text) == len(want)
    assert sum(line.startswith("Value mismatch: ") for line in text) == len(wrong)
    with pytest.raises(ValueError):
        job.run(text_lines, source, "x99", mode, checkpoint, line_number=1)
    with pytest.raises(ValueError):
        job.run(text_lines, source, name, mode, checkpoint, line_number=10**9)


def test_a_report_is_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i} é") for i in range(500)], "at long, line string").repartition(5).orderBy("at").select("line")
    for _ in range(2):  # the second one takes the place of the first
        hits.write_report(rows, str(tmp_path / "report"))
    parts = sorted(x for x in (tmp_path / "report").iterdir() if x.name.startswith("part-"))
    assert b"".join(x.read_bytes() for x in parts).decode() == "".join(f"line {i} é\n" for i in range(500))


def test_tables_go_when_the_session_stops(tmp_path):
    """In a process of its own, as the session of these tests goes on."""
    import subprocess
    import sys

    program = f"""
from pyspark.sql import SparkSession
from logweave.storage import checkpoint
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert checkpoint(spark.range(5)).count() == 5
spark.stop()
"""
    subprocess.run([sys.executable, "-c", program], check=True, timeout=300)
    assert not [x for x in tmp_path.iterdir() if x.name.startswith("logweave-")]


def test_addresses_sort_as_unsigned_numbers(spark):
    rows = [["m200", "r30", "m1000", "mffffffffffffff00", "r4", "m10"]]
    df = spark.createDataFrame([(x,) for x in rows], "locs array<string>")
    assert df.select(hits.in_order(F.col("locs")).alias("x")).first().x == ["r4", "r30", "m10", "m200", "m1000", "mffffffffffffff00"]


@pytest.mark.parametrize(("text", "loc"), [("x11", "r11"), ("W28", "r28"), ("fp", "r29"), (" mem:0xAb ", "mab"), ("mem:c0", "mc0"), ("q31", "r65"), ("nzcv", "r33")])
def test_sources_by_name(text, loc):
    assert hits.parse_source(text) == loc


@pytest.mark.parametrize("text", ["x31", "w-1", "mem:", "mem:0x11112222333344445", "y4", ""])
def test_sources_by_wrong_name(text):
    with pytest.raises(ValueError):
        hits.parse_source(text)


def plain_lines(text):
    """(number, offset, line, line end) by hand."""
    at = 0
    pieces = text.split("\n")
    for n, piece in enumerate(pieces, 1):
        if n == len(pieces) and not piece:
            return
        body = piece.removesuffix("\r")
        yield n, at, body, piece[len(body) :] + ("\n" if n < len(pieces) else "")
        at += len(piece.encode()) + 1


def test_lines_and_matches(spark):
    rng = random.Random(9)
    texts = ["", None, "\n", "\r\n\n", "ß"] + ["".join(rng.choice(["ab", "é", "\n", "\r\n", " x", "AB"]) for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = lines.lines_of_texts(df, "id", "text", line_ends=True).cache()
    want = {(i, *x) for i, t in enumerate(texts) if t for x in plain_lines(t)}
    assert {(r.source_id, r.line_number, r.file_offset, r.raw, r.line_end) for r in rows.collect()} == want and rows.count() == len(want)
    assert all(r.line_len == len(r.raw.encode()) for r in rows.collect())
    found = {(r.source_id, r.byte_offset, r.match_len) for r in search.matches(rows, compile_pattern("ab")).collect()}
    by_hand = set()
    for i, _, at, raw, _ in want:
        k = raw.lower().find("ab")
        while k >= 0:
            by_hand.add((i, at + len(raw[:k].encode()), 2))
            k = raw.lower().find("ab", k + 2)
    assert found == by_hand
    none = compile_pattern("z*", use_regex=True)
    assert none.may_be_empty and search.matches(rows, none).count() == sum(len(raw) + 1 for _, _, _, raw, _ in want)
    assert search.matches(rows, compile_pattern("")).count() == 0
    back = {r.source_id: r.text for r in replace.rewritten(rows).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t}


def test_a_million_lines_in_one_text(spark):
    df = spark.createDataFrame([(1, "ab c\n" * 1_000_000)], "id long, text string")
    last = lines.lines_of_texts(df, "id", "text").agg(F.max("line_number").alias("n"), F.max("file_offset").alias("at")).first()
    assert (last.n, last.at) == (1_000_000, 4_999_995)
    line = spark.createDataFrame([(1, 1, 0, 400_000, "ab c" * 100_000)], "source_id long, line_number long, file_offset long, line_len int, raw string")
    assert search.matches(line, compile_pattern("c")).agg(F.max("byte_offset")).first()[0] == 399_999


def test_replacement(spark):
    rows = spark.createDataFrame([(1, "Cat catalog CAT"), (2, "k1=v1;k22=v22")], "id long, raw string")
    of = lambda i, pattern, template, **how: replace.replace_all(rows, pattern, template, **how).where(f"id = {i}").first().raw
    assert of(1, compile_pattern("cat"), "$0\\dog") == "$0\\dog $0\\dogalog $0\\dog" and of(1, compile_pattern("cat", case_sensitive=True), "x") == "Cat xalog CAT"
    assert of(1, compile_pattern("cat", whole_word=True), "x") == "x catalog x"
    pair = compile_pattern(r"(\w+)=(\w+)", use_regex=True)
    assert of(2, pair, "${2}<$1$$", use_regex=True) == "v1<k1$;v22<k22$"


def test_backward_tells_where_a_depth_cuts_it(spark):
    n = 19  # rounds enough for what is kept apart to be put together
    rows = [(1, i, i * 100, 50, f'lib.so!{i * 4:x} 0x{i * 4:x}: "\tmov\tx{i % 2}, x{(i + 1) % 2}" X0=0x1 => X1=0x1') for i in range(1, n + 1)]
    text = spark.createDataFrame(rows, "source_id long, line_number long, file_offset long, line_len int, raw string").coalesce(1)
    insns = checkpoint(dataflow.with_rules(trace.parse_trace(text, dense=False)))
    query = spark.createDataFrame([(1, 1, f"r{n % 2}", n, False)], "query_id long, source_id long, loc string, start_idx long, skip_start boolean")
    trail, _ = dataflow.backward(insns, query, checkpoint, max_depth=2)
    assert {(r.idx, r.truncated) for r in trail.collect()} == {(n, True), (n - 1, True)}
    trail, _ = dataflow.backward(insns, query, checkpoint)
    assert sorted(r.idx for r in trail.collect()) == list(range(1, n + 1))
