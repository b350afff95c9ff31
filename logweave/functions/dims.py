"""Registers and mnemonics of the traced instruction set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of mnemonics: fixed values.
CATEGORIES = {
    "DataMove": "cls clz fmov mov mvn neg negs ngc ngcs rbit rev rev16 rev32 rev64 scvtf ucvtf",
    "ImmLoad": "adr adrp movn movz",
    "PartialModify": "movk",
    "Arithmetic": "adc adcs add adds fabs fadd fdiv fmadd fmax fmin fmsub fmul fneg fnmadd fnmsub fnmul fsqrt fsub madd mneg msub mul sbc sbcs sdiv smaddl smsubl smulh smull sub subs udiv umaddl umsubl umulh umull",
    "Logic": "and ands bic bics eon eor orn orr",
    "ShiftExt": "asr lsl lsr ror sxtb sxth sxtw uxtb uxth",
    "Bitfield": "bfi bfm bfxil extr sbfm sbfx ubfm ubfx",
    "Load": "ldar ldarb ldarh ldaxp ldaxr ldaxrb ldaxrh ldnp ldp ldpsw ldr ldrb ldrh ldrsb ldrsh ldrsw ldtr ldtrb ldtrh ldtrsb ldtrsh ldtrsw ldur ldurb ldurh ldursb ldursh ldursw ldxp ldxr ldxrb ldxrh",
    "Store": "stlr stlrb stlrh stlxp stlxr stlxrb stlxrh stp str strb strh stur sturb sturh stxp stxr stxrb stxrh",
    "Compare": "ccmn ccmp cmn cmp fccmp fccmpe fcmp fcmpe tst",
    "CondSelect": "cinc cinv cneg csel cset csetm csinc csinv csneg fcsel",
    "Branch": "b bl blr br bti cbnz cbz dc dmb dsb ic isb nop pacda pacdb pacia paciasp pacib pacibsp prfm prfum ret retaa retab svc tbnz tbz",
}
#: Mnemonics that set the flags besides comparisons: fixed values.
FLAG_SETTERS = ("adds", "subs", "ands", "bics", "adcs", "sbcs", "negs", "ngcs")
#: Stores whose first operand is a status register that they write: fixed values.
STATUS = ("stlxp", "stlxr", "stlxrb", "stlxrh", "stxp", "stxr", "stxrb", "stxrh")
#: Loads whose second operand is a destination too, and pairs of accesses: fixed values.
SECOND_DESTINATION = ("ldp", "ldpsw", "ldnp", "ldxp", "ldaxp")
PAIRS = ("ldp", "ldpsw", "ldnp", "ldxp", "ldaxp", "stp", "stnp", "stxp", "stlxp")

FP, LR, SP, XZR, NZCV, Q0 = 29, 30, 31, 32, 33, 34
#: Locations that a call may change: x0-x18, lr, q0-q7 and the flags.
CALLER_SAVED = (*range(19), LR, *range(Q0, Q0 + 8), NZCV)


def category(mnemonic: Column) -> Column:
    """The category of a lower-case mnemonic; prefixes count where no name matches."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, members in CATEGORIES.items():
        found = found.when(mnemonic.isin(members.split()), F.lit(name))
    found = found.when(mnemonic.startswith("b."), F.lit("Branch")).when(mnemonic.startswith("aut") & (F.length(mnemonic) >= 5), F.lit("Branch"))
    found = found.when(mnemonic == "stnp", F.lit("Store"))  # a pair that is stored like any other
    return found.when(mnemonic.startswith("fcvt") | mnemonic.startswith("frint"), F.lit("DataMove")).otherwise(F.lit("Other"))


def sets_flags(mnemonic: Column, of: Column) -> Column:
    return (of == "Compare") | mnemonic.isin(*FLAG_SETTERS)


def register_id(name: Column) -> Column:
    """The id of a register's spelling, views of one register sharing an id; null if it is none."""
    low = F.lower(name)
    number = F.substring(low, 2, 2).try_cast("int")
    core = low.rlike(r"^[xw](\d|[12]\d|30)$")
    vector = low.rlike(r"^[qdshbv](\d|[12]\d|3[01])$")
    found = F.when(core, number).when(vector, number + Q0).when(low.isin("sp", "wsp"), F.lit(SP)).when(low.isin("xzr", "wzr"), F.lit(XZR))
    return found.when(low == "fp", F.lit(FP)).when(low == "lr", F.lit(LR)).when(low == "nzcv", F.lit(NZCV)).cast("short")


def register_name(register: Column) -> Column:
    """The display name of a register id."""
    special = F.when(register == FP, "fp").when(register == LR, "lr").when(register == SP, "sp").when(register == XZR, "xzr").when(register == NZCV, "nzcv")
    return special.when(register.between(0, 28), F.concat(F.lit("x"), register.cast("string"))).when(register.between(Q0, Q0 + 31), F.concat(F.lit("q"), (register - Q0).cast("string"))).otherwise("?")
