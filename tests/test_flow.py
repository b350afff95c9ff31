"""Forward questions over a log that grows, against the batch and a plain interpreter."""

import random

import pytest
import trace_model as model
from pyspark.sql import functions as F

from logweave.operators import dataflow, job, trace
from logweave.sources import bytelog
from logweave.storage import checkpoint
from logweave.streaming import flow, tail

TEXT, STEPS = model.program(11, 120)
#: The last instruction of a log waits for the next one.
END = 'libq.so!f000 0xf000: "\tnop"\n'
LOST = 'libq.so!e000 0xe000: lost\nMEM W 0x4f0 [8 bytes]: 01 00 00 00 00 00 00 00\nnoise\n'


def asked(spark, path):
    rng = random.Random(3)
    rows = []
    for i in range(25):
        start = rng.randrange(len(STEPS) - 1)
        step = STEPS[start]
        near = [f"r{x}" for x in step.dst + step.src if x != 32] + [f"m{a:x}" for a, _ in step.reads + step.writes]
        rows.append((i, path, rng.choice(near or ["r0", "m4f8"]), start))
    rows.append((99, path, "r0", 10**6))  # not there yet
    return spark.createDataFrame(rows, "query_id long, source_id string, loc string, start_idx long")


def run(spark, rows, folder):
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{folder}/out")


def events(df, *kinds):
    return sorted((r.query_id, r.idx, r.kind, tuple(r.locs), r.addr or "", r.expected or 0, r.actual or 0) for r in df.collect() if r.kind in kinds)


@pytest.mark.parametrize(("max_idle", "window_bytes", "max_bytes", "restarts"), [(3, None, 1 << 20, 1), (None, 2500, 4000, 0), (10**6, None, 3000, 0)])
def test_micro_batches_of_any_cut_equal_the_batch(spark, tmp_path, max_idle, window_bytes, max_bytes, restarts):
    path, rng = tmp_path / "grow.log", random.Random(1)
    whole = (TEXT + LOST + END).encode()
    cuts = sorted(rng.randrange(len(whole)) for _ in range(restarts)) + [len(whole)]
    queries, at = asked(spark, str(path)), 0
    for to in cuts:  # each part is appended, also in the middle of a line, and the query started anew
        with path.open("ab") as f:
            f.write(whole[at:to])
        at = to
        got = run(spark, tail.tail_lines(spark, str(path), max_bytes).transform(flow.instructions).transform(flow.forward_stream, queries, max_idle, window_bytes), tmp_path)
    got = events(got, "hit", "mismatch", "stop")
    insns = checkpoint(dataflow.with_rules(trace.parse_trace(bytelog.read_lines(spark, str(path)))))
    batch = dataflow.forward(insns.where(F.col("idx") < len(STEPS)), queries, max_idle=max_idle, window_bytes=window_bytes, width=50)
    want = [e for e in events(batch, "hit", "mismatch", "stop") if e[3] != ("EndOfTrace",)]
    assert got == want and {e[0] for e in got} == set(range(25)) and any(e[2] == "stop" for e in got)
    if window_bytes is None:
        for r in queries.where("query_id < 25").collect():
            rows, stop, wrong = model.forward(STEPS, r["loc"], r.start_idx, max_idle or 10**9)
            assert [(e[1], list(e[3])) for e in got if e[0] == r.query_id and e[2] == "hit"] == rows
            assert [e[3][0] for e in got if e[0] == r.query_id and e[2] == "stop"] == ([stop] if stop != "EndOfTrace" else [])
            assert [(e[1], *e[4:]) for e in got if e[0] == r.query_id and e[2] == "mismatch"] == wrong


def test_instructions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    path = tmp_path / "grow.log"
    path.write_text("noise\nMEM R 0x1 [8 bytes]: 00\n" + TEXT + LOST + END)
    got = run(spark, flow.instructions(tail.tail_lines(spark, str(path), 6000)), tmp_path)
    want = dataflow.with_rules(trace.parse_trace(bytelog.read_lines(spark, str(path)))).where(F.col("idx") < len(STEPS))
    columns = sorted(want.columns)
    text = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert text(got) == text(want) and got.count() == len(STEPS)


def test_large_values_are_kept(spark, tmp_path):
    """Values of 64 bits, which floats would round, and accesses without one."""
    path, big = tmp_path / "grow.log", "ff ee dd cc bb aa 99 f8"
    lines = ['libq.so!0 0x0: "\tmov\tx1, x2"', 'libq.so!4 0x4: "\tstr\tx1, [x3]"', f"MEM W 0xfffffffffffffff8 [8 bytes]: {big}", 'libq.so!8 0x8: "\tldr\tx4, [x3]"', "MEM R 0xfffffffffffffff8 [8 bytes]: fe" + big[2:], 'libq.so!c 0xc: "\tldr\tx4, [x3]"', "MEM R 0xfffffffffffffff8 [8 bytes]:", END]
    path.write_text("\n".join(lines))
    queries = spark.createDataFrame([(1, str(path), "r1", 0)], "query_id long, source_id string, loc string, start_idx long")
    got = events(run(spark, flow.tail_forward(spark, str(path), queries), tmp_path), "hit", "mismatch")
    value = int.from_bytes(bytes.fromhex(big), "little", signed=True)
    trail, addr = ("mfffffffffffffff8", "r1"), "mfffffffffffffff8"
    assert got == [
        (1, 0, "hit", ("r1",), "", 0, 0), (1, 1, "hit", trail, "", 0, 0), (1, 2, "hit", (*trail, "r4"), "", 0, 0),
        (1, 2, "mismatch", (), addr, value, value - 1), (1, 3, "hit", (*trail, "r4"), "", 0, 0),
    ]  # the last read shows no value, so it differs from none


def test_a_rewritten_log_ends_the_query(spark, tmp_path):
    path = tmp_path / "grow.log"
    path.write_text(TEXT)
    queries = asked(spark, str(path))
    run(spark, flow.tail_forward(spark, str(path), queries), tmp_path)
    path.write_text(END * 3)
    with pytest.raises(Exception, match="rewritten"):
        run(spark, flow.tail_forward(spark, str(path), queries), tmp_path)


@pytest.mark.parametrize("mode", ["forward", "backward"])
def test_job_over_a_file(spark, tmp_path, mode):
    """Sources are named by their files there, which the schemas of the spans have to follow."""
    path = tmp_path / "trace.log"
    path.write_text(TEXT)
    rows = checkpoint(bytelog.read_lines(spark, str(path)))
    start = next(i for i, s in enumerate(STEPS) if i > 20 and s.category == "Load")
    loc = f"m{STEPS[start].reads[0][0]:x}" if mode == "forward" else f"r{STEPS[start].dst[0]}"
    at = trace.parse_trace(rows).where(F.col("idx") == start).first()
    found = job.run(rows, rows.first().source_id, f"mem:0x{loc[1:]}" if mode == "forward" else f"x{loc[1:]}", mode, checkpoint, line_number=at.line_number)
    want = [i for i, _ in model.forward(STEPS, loc, start)[0]] if mode == "forward" else list(model.backward(STEPS, loc, start)[0])
    first = start if mode == "forward" else 0  # forward parses what follows the start
    got = sorted(r.idx for r in found.hits.collect())
    assert got == sorted(want) or [i - got[0] + first for i in got] == sorted(want)


def test_rows_reach_state_packed_and_in_order(spark):
    """A row for each key and Arrow batch, whatever the types; unpacked, all rows of a key in order."""
    rows = [(k, 1000 - i, f"é{i}" if i % 3 else None, [i, None] if i % 2 else []) for i in range(500) for k in ("a", "b", None)]
    df = spark.createDataFrame(rows, "k string, at long, raw string, vals array<long>").repartition(3)
    packs = flow._packed(df, ["k"]).collect()
    assert len(packs) <= 9 and {p.k for p in packs} == {"a", "b", None}
    for key in ("a", "b", None):
        got = [tuple(r.values()) for r in flow._ordered(iter([p for p in packs if p.k == key]), "at")]
        assert got == sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
