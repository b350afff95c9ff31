"""Expressions that read lines of an instruction trace.

Three kinds of line count: instructions (``<module>.so!<hex> 0x<hex>: "<asm>" inputs => outputs``), memory
accesses (``MEM R|W 0x<hex> [n bytes]: <dump>``) and calls (``-> <name>(...)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.dims import PAIRS, SECOND_DESTINATION, STATUS, register_id

INSN = r'^[^!]*!([0-9a-fA-F]+) *(?:0x[^: ]*:?)? *"([^"]*)"'
OUTSIDE_BRACKETS = r",(?![^\[]*\])"


def is_external(raw: Column) -> Column:
    return raw.rlike(r"^[ \t]*-> ")


def is_instruction(raw: Column) -> Column:
    return F.instr(F.substring(raw, 1, 64), ".so!") > 0


def kind(raw: Column) -> Column:
    """EXT, INSN, BAD (looks like an instruction but has none), MEM or null."""
    parsed = raw.rlike(INSN) & (mnemonic(asm_of(raw)) != "")
    return F.when(is_external(raw), "EXT").when(is_instruction(raw), F.when(parsed, "INSN").otherwise("BAD")).when(raw.rlike(r"^MEM [RW] +0x[0-9a-fA-F]"), "MEM")


def hex_value(digits: Column) -> Column:
    """The low 64 bits of hexadecimal digits, as a signed number of the same bits."""
    return F.conv(F.right(digits, F.lit(16)), 16, -10).cast("long")


def hex_text(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def asm_of(raw: Column) -> Column:
    return F.regexp_extract(raw, INSN, 2)


def clean_asm(asm: Column) -> Column:
    return F.trim(F.regexp_replace(asm, r"[\t ]+", " "))


def mnemonic(asm: Column) -> Column:
    return F.lower(F.regexp_extract(asm, r"^[ \t]*([^ \t]+)", 1))


def operands_text(asm: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(asm, r"^[ \t]*[^ \t]+[ \t]*(.*)$", 1), r"\t", " "))


def operands(text: Column) -> Column:
    """Operands, cut at commas outside brackets, eight at most."""
    parts = F.transform(F.split(text, OUTSIDE_BRACKETS, -1), lambda x: F.trim(x))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(parts, 1, 8))


def token(operand: Column) -> Column:
    return F.regexp_extract(operand, r"^([A-Za-z0-9]{0,7})", 1)


def _is_memory(operand: Column) -> Column:
    return operand.startswith("[")


def _registers(operand: Column) -> Column:
    """Register ids of an operand: the base and index of a memory operand, or the operand itself."""
    inside = F.transform(F.regexp_extract_all(operand, F.lit(r"[\[,][ \t]*([A-Za-z0-9]+)"), F.lit(1)), register_id)
    return F.filter(F.when(_is_memory(operand), inside).otherwise(F.array(register_id(token(operand)))), lambda r: r.isNotNull())


def registers_of(ops: Column) -> Column:
    return F.flatten(F.transform(ops, _registers))


def writeback_base(ops: Column, category: Column) -> Column:
    """The base register that an access also changes (pre- or post-index), or null."""
    changed = F.filter(ops, lambda o, i: _is_memory(o) & (o.endswith("!") | (category.isin("Load", "Store") & (i < F.size(ops) - 1))))
    return F.when(F.size(changed) > 0, F.try_element_at(_registers(F.try_element_at(changed, F.lit(1))), F.lit(1)))


def destinations(ops: Column, mnemonic: Column, category: Column) -> Column:
    """Registers that an instruction writes, four at most; a changed base comes last."""
    none = F.array().cast("array<smallint>")
    base = writeback_base(ops, category)
    own = F.when(mnemonic.isin(*STATUS), registers_of(F.slice(ops, 1, 1))).when(category.isin("Branch", "Compare", "Store"), none).when(mnemonic.isin(*SECOND_DESTINATION), registers_of(F.slice(ops, 1, 2))).otherwise(registers_of(F.slice(ops, 1, 1)))
    return F.slice(F.concat(own, F.when(base.isNotNull(), F.array(base)).otherwise(none)), 1, 4)


def sources(ops: Column, mnemonic: Column, category: Column) -> Column:
    """Registers that an instruction reads, eight at most; a store's data comes first."""
    skipped = F.when(mnemonic.isin(*STATUS), 1).when(category.isin("Branch", "Compare", "Store"), 0).when(mnemonic.isin(*SECOND_DESTINATION), 2).otherwise(1)
    return F.slice(registers_of(F.slice(ops, skipped + 1, 8)), 1, 8)


def pair_size(ops: Column, mnemonic: Column) -> Column:
    """Bytes of a register of a paired access, 0 if it is none."""
    first = F.when(mnemonic.isin(*STATUS), 2).otherwise(1)
    letter = F.lower(F.substring(F.try_element_at(ops, first), 1, 1))
    return F.when(mnemonic.isin(*PAIRS), F.when(letter.isin("w", "s"), 4).when(letter == "q", 16).otherwise(8)).otherwise(0)


def access(raw: Column) -> Column:
    """(rw, addr, val) of a memory line; the value is the little-endian dump of eight bytes at most."""
    dump = F.regexp_extract(raw, r"\]: ((?:[0-9a-fA-F]{2} ?)+)", 1)
    octets = F.slice(F.split(F.trim(dump), " "), 1, 8)
    value = F.when(F.trim(dump) != "", hex_value(F.array_join(F.reverse(octets), "")))
    return F.struct(F.substring(raw, 5, 1).alias("rw"), hex_value(F.regexp_extract(raw, r"^MEM [RW] +0x([0-9a-fA-F]+)", 1)).alias("addr"), value.alias("val"))


def register_values(side: Column) -> Column:
    """``NAME=0xHEX`` pairs of one side of a line, as a map from register id to value; the first counts."""
    names = F.regexp_extract_all(side, F.lit(r"([A-Za-z0-9]+)=0x([0-9a-fA-F]+)"), F.lit(1))
    values = F.regexp_extract_all(side, F.lit(r"([A-Za-z0-9]+)=0x([0-9a-fA-F]+)"), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(register_id(n).alias("key"), hex_value(v).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isNotNull())
    start = F.array().cast("array<struct<key:smallint,value:bigint>>")
    first = F.aggregate(known, start, lambda seen, p: F.when(F.exists(seen, lambda s: s["key"] == p["key"]), seen).otherwise(F.array_append(seen, p)))
    return F.map_from_entries(first)


def input_values(raw: Column) -> Column:
    return register_values(F.substring_index(F.regexp_replace(raw, r'^[^"]*"[^"]*"', ""), "=>", 1))


def output_values(raw: Column) -> Column:
    return register_values(F.when(F.instr(raw, "=>") > 0, F.regexp_replace(raw, r"^.*?=>", "")).otherwise(""))


def call_name(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[ \t]*(?:-> )?(.*?)(?: ret:.*)?[ \t]*$", 1)


def module_offset(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^(\S+)", 1)


def absolute_address(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^\S+ (0x[0-9a-fA-F]+)", 1)
