"""A deterministic instruction trace derived from the events table, as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = 8


def events_trace(events: DataFrame) -> DataFrame:
    """Trace lines (source_id, line_number, file_offset, line_len, raw): each event is an instruction, and views,
    purchases and some signups have a line after it (a read, a write, a call)."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.select("event_id", (F.col("user_id") % SOURCES).alias("source_id"), (F.col("user_id") % 29).cast("string").alias("d"), (k % 29).cast("string").alias("s"), ((F.col("user_id") + 1) % 29).cast("string").alias("t"), k.alias("k"), F.lower(F.hex(4096 + 8 * (k % 64))).alias("addr"), F.col("event_type").alias("type"))
    asm = (
        F.when(F.col("type") == "signup", F.format_string("\tmovz\tx%s, #0x%x", "d", "k"))
        .when(F.col("type") == "view", F.format_string("\tldr\tx%s, [x%s, #0x8]", "d", "s"))
        .when(F.col("type") == "click", F.format_string("\tadd\tx%s, x%s, x%s", "d", "s", "t"))
        .when(F.col("type") == "purchase", F.format_string("\tstr\tx%s, [x%s]", "s", "d"))
        .otherwise(F.format_string("\tcmp\tx%s, x%s", "s", "d"))
    )
    first = F.concat(F.format_string('lib.so!%x 0x%x: "', F.col("event_id") * 4, F.col("event_id") * 4 + 65536), asm, F.format_string('" X%s=0x%x => X%s=0x%x', "s", "k", "d", F.col("k") + 1))
    value = F.format_string("%02x 00 00 00 00 00 00 00  ........", F.col("event_id") % 256)
    second = (
        F.when(F.col("type") == "view", F.concat(F.format_string("MEM R 0x%s [8 bytes]: ", "addr"), value))
        .when(F.col("type") == "purchase", F.concat(F.format_string("MEM W 0x%s [8 bytes]: ", "addr"), value))
        .when((F.col("type") == "signup") & (F.col("k") % 7 == 0), F.format_string(" -> libc.so!malloc(%d) ret: 0x0", "k"))
    )
    at = F.col("event_id") * 2 + 1
    lines = e.select("source_id", F.explode(F.filter(F.array(F.struct(at.alias("n"), first.alias("raw")), F.struct((at + 1).alias("n"), second.alias("raw"))), lambda x: x["raw"].isNotNull())).alias("l"))
    return lines.select("source_id", F.col("l.n").alias("line_number"), (F.col("l.n") * 128).alias("file_offset"), F.octet_length("l.raw").alias("line_len"), F.col("l.raw").alias("raw"))


#: The typed trace straight from the events, for DuckDB: ``lines`` (every line) and ``insn`` (instructions and calls).
TRACE_SQL = """
e AS (
  SELECT event_id, user_id % 8 AS source_id, user_id % 29 AS d, k % 29 AS s, (user_id + 1) % 29 AS t, k, 4096 + 8 * (k % 64) AS addr, event_type AS type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), insn AS (
  SELECT source_id, event_id * 2 + 1 AS line_number, event_id * 4 AS rel_addr, event_id, k, addr,
    CASE type WHEN 'signup' THEN 'ImmLoad' WHEN 'view' THEN 'Load' WHEN 'click' THEN 'Arithmetic' WHEN 'purchase' THEN 'Store' ELSE 'Compare' END AS category,
    CASE type WHEN 'signup' THEN 'movz' WHEN 'view' THEN 'ldr' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'str' ELSE 'cmp' END AS mnemonic,
    CASE WHEN type IN ('signup', 'view', 'click') THEN [d] ELSE [] END AS dst,
    CASE type WHEN 'signup' THEN [] WHEN 'view' THEN [s] WHEN 'click' THEN [s, t] ELSE [s, d] END AS src,
    CASE WHEN type = 'view' THEN [addr] ELSE [] END AS reads, CASE WHEN type = 'purchase' THEN [addr] ELSE [] END AS writes
  FROM e
  UNION ALL
  SELECT source_id, event_id * 2 + 2, NULL, event_id, k, addr, 'ExternalCall', '', [0], [], [], [] FROM e WHERE type = 'signup' AND k % 7 = 0
), locs AS (
  SELECT *,
    list_transform(src, lambda r: 'r' || r) || list_transform(reads, lambda a: 'm' || printf('%x', a)) AS uses,
    CASE WHEN category = 'ExternalCall' THEN list_transform(range(0, 19), lambda r: 'r' || r) || ['r30'] || list_transform(range(34, 42), lambda r: 'r' || r) || ['r33']
      WHEN category = 'Compare' THEN ['r33'] ELSE list_transform(dst, lambda r: 'r' || r) || list_transform(writes, lambda a: 'm' || printf('%x', a)) END AS defs
  FROM insn
)"""
