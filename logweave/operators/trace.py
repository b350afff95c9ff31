"""Lines of a trace to typed instructions, with their memory accesses attached."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import dims
from logweave.functions import trace as T
from logweave.operators.ordered import dense_index, last_before

ACCESS = "array<struct<addr:bigint,val:bigint,inferred:boolean>>"
#: What a line is known by.
HEAD = ("line_number", "file_offset", "line_len", "raw")


def parse_trace(lines: DataFrame, dense: bool = True) -> DataFrame:
    """Typed instructions of ``lines`` (source_id, line_number, file_offset, line_len, raw).

    Calls become rows of category ExternalCall that write x0. ``idx`` counts the instructions of a source
    from 0; without ``dense`` it is the line number, which orders them alike at no cost.
    """
    typed = lines.select("source_id", "line_number", "file_offset", "line_len", "raw", T.kind(F.col("raw")).alias("kind")).where("kind IS NOT NULL")
    rows = typed_instructions(attach_accesses(typed))
    return dense_index(rows, ["source_id"], "line_number", "idx") if dense else rows.withColumn("idx", F.col("line_number"))


def typed_instructions(attached: DataFrame, *others: str) -> DataFrame:
    """Instructions and calls with their accesses, typed; ``others`` are columns to keep."""
    rows = attached.withColumn("asm_text", T.asm_of(F.col("raw")))
    rows = rows.withColumn("mnemonic", F.when(F.col("kind") == "EXT", "").otherwise(T.mnemonic(F.col("asm_text"))))
    rows = rows.withColumn("category", F.when(F.col("kind") == "EXT", "ExternalCall").otherwise(dims.category(F.col("mnemonic"))))
    rows = rows.withColumn("operands", T.operands_text(F.col("asm_text"))).withColumn("ops", T.operands(F.col("operands")))
    call = F.col("kind") == "EXT"
    none = F.array().cast("array<smallint>")
    ops, name, of = F.col("ops"), F.col("mnemonic"), F.col("category")
    rows = rows.select(
        "source_id", *others, "line_number", "file_offset", "line_len", "raw",
        T.module_offset(F.col("raw")).alias("module_offset"), T.absolute_address(F.col("raw")).alias("abs_addr"),
        F.when(~call, T.hex_value(F.regexp_extract("raw", T.INSN, 1))).alias("rel_addr"),
        "mnemonic", T.clean_asm(F.col("asm_text")).alias("asm"), "operands", "category",
        F.when(call, False).otherwise(dims.sets_flags(name, of)).alias("sets_flags"),
        F.when(call, F.array(F.lit(0).cast("smallint"))).otherwise(T.destinations(ops, name, of)).alias("dst"),
        F.when(call, none).otherwise(T.sources(ops, name, of)).alias("src"),
        F.when(call, 0).otherwise(T.pair_size(ops, name)).alias("pair_reg_size"),
        T.writeback_base(ops, of).isNotNull().alias("has_writeback_base"), "reads", "writes",
    )
    return infer_pairs(rows)


def attach_accesses(typed: DataFrame) -> DataFrame:
    """Instructions and calls with ``reads`` and ``writes``: the first two accesses of each kind that follow.

    The owner of a memory line is the last instruction, call or broken instruction before it; what follows
    the latter two is dropped. Each line is read once: an instruction and its memory lines meet in one grouping.
    """
    own = F.col("kind").isin("INSN", "EXT")
    owner = F.when(F.col("kind") != "MEM", F.when(F.col("kind") == "INSN", F.col("line_number")).otherwise(-1))
    found = last_before(typed.withColumn("owns", owner), ["source_id"], "line_number", "owns", "owner", strict=False)
    found = found.select("source_id", F.when(own, F.col("line_number")).otherwise(F.col("owner")).alias("at"), "kind", *[F.when(own, F.col(c)).alias(c) for c in HEAD], F.when(F.col("kind") == "MEM", F.struct("line_number", T.access(F.col("raw")).alias("a"))).alias("m"))
    heads_ = [F.max(c).alias(c) for c in HEAD]  # one row of a group has them
    each = [F.slice(F.sort_array(F.collect_list(F.when(F.col("m.a.rw") == rw, F.col("m")))), 1, 2).alias(name) for rw, name in (("R", "reads"), ("W", "writes"))]
    both = found.where("at >= 0").groupBy("source_id", "at").agg(F.max(F.when(own, F.col("kind"))).alias("kind"), *heads_, *each)
    plain = [F.transform(name, lambda x: F.struct(x["a"]["addr"].alias("addr"), x["a"]["val"].alias("val"), F.lit(False).alias("inferred"))).cast(ACCESS).alias(name) for name in ("reads", "writes")]
    return both.select("source_id", *HEAD, "kind", *plain)


def infer_pairs(insns: DataFrame) -> DataFrame:
    """The second access of a pair of which only one was logged; its value is unknown."""

    def filled(name: str, of: str):
        one = (F.col("pair_reg_size") > 0) & (F.col("category") == of) & (F.size(name) == 1)
        first = F.col(name)[0]
        # 64-bit wrap-around, which a sum of longs would refuse
        wide = first["addr"].cast("decimal(20,0)") + F.col("pair_reg_size")
        wrapped = F.when(wide > 2**63 - 1, wide - F.lit(Decimal(2**64))).otherwise(wide).cast("long")
        return F.when(one, F.array(first, F.struct(wrapped.alias("addr"), F.lit(None).cast("long").alias("val"), F.lit(True).alias("inferred")))).otherwise(F.col(name))

    return insns.withColumns({"reads": filled("reads", "Load"), "writes": filled("writes", "Store")})


def within_limits(lines: DataFrame, max_line: int | None = None, max_offset: int | None = None) -> DataFrame:
    """Lines up to a line number and a byte offset, before anything is parsed."""
    if max_line is not None:
        lines = lines.where(F.col("line_number") <= max_line)
    return lines if max_offset is None else lines.where(F.col("file_offset") <= max_offset)


def heads(lines: DataFrame) -> DataFrame:
    """The lines that are instructions or calls, told by their look alone."""
    return lines.where(T.kind(F.col("raw")).isin("INSN", "EXT"))


def parse_lines(lines: DataFrame, asked: DataFrame, ahead: int = 8) -> DataFrame:
    """The instructions at the ``asked`` places (source_id, line_number), with the accesses of the next few lines."""
    near = asked.select("source_id", F.explode(F.sequence(F.col("line_number"), F.col("line_number") + ahead)).alias("line_number")).distinct()
    few = lines.join(near, ["source_id", "line_number"], "left_semi")
    return parse_trace(few, dense=False).join(asked, ["source_id", "line_number"], "left_semi")


def call_display(insns: DataFrame) -> DataFrame:
    """``insns`` with (shown_line, shown_offset): calls are shown where the instruction before them stands."""
    place = F.struct("line_number", "file_offset")
    found = last_before(insns.withColumn("_place", place), ["source_id"], "idx", "_place", "_previous")
    call = F.col("category") == "ExternalCall"
    shown = {f"shown_{a}": F.when(call, F.coalesce(F.col(f"_previous.{b}"), F.col(b))).otherwise(F.col(b)) for a, b in (("line", "line_number"), ("offset", "file_offset"))}
    return found.withColumns(shown).drop("_place", "_previous")
