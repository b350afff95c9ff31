"""Random programs as trace text, and what a plain interpreter makes of them."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

SAVED = [f"r{i}" for i in (*range(19), 30, *range(34, 42), 33)]
FLAGS = "r33"
PLAIN = ("DataMove", "Arithmetic", "Logic", "ShiftExt", "Bitfield")


@dataclass
class Step:
    """One instruction or call: registers by number, memory by address."""

    mnemonic: str
    category: str
    dst: list[int] = field(default_factory=list)
    src: list[int] = field(default_factory=list)
    reads: list[tuple[int, int | None]] = field(default_factory=list)
    writes: list[tuple[int, int | None]] = field(default_factory=list)
    sets_flags: bool = False
    base: int | None = None

    def flows(self) -> list[tuple[str, str]]:
        """(from, to) of every value that moves."""
        regs = lambda xs: [f"r{x}" for x in xs if x != 32]
        mems = lambda xs: [f"m{a:x}" for a, _ in xs]
        every = regs(self.src) + mems(self.reads)
        if self.category in PLAIN:
            return [(i, o) for o in regs(self.dst) + [FLAGS] * self.sets_flags for i in every]
        if self.category == "CondSelect":
            return [(i, o) for o in regs(self.dst) for i in [*every, FLAGS]]
        if self.category == "Compare":
            return [(i, FLAGS) for i in every]
        if self.category == "PartialModify":
            return [(x, x) for x in regs(self.dst)]
        own = regs([x for x in self.dst if x != self.base])
        keeps = [(f"r{self.base}",) * 2] * (self.base is not None)
        if self.category == "Load":
            return (list(zip(mems(self.reads), own, strict=False)) if len(own) > 1 else [(m, o) for o in own for m in mems(self.reads)]) + keeps
        if self.category == "Store":
            data = [f"r{x}" for x in self.src[:2]]
            return [(d, m) for d, m in zip(data, mems(self.writes), strict=False) if d != "r32"] + keeps
        return []

    def clears(self) -> list[str]:
        if self.category == "ExternalCall":
            return SAVED
        if self.category in ("Branch", "PartialModify"):
            return []
        if self.category == "Compare":
            return [FLAGS]
        return [f"r{x}" for x in self.dst if x != 32] + [f"m{a:x}" for a, _ in self.writes] + [FLAGS] * self.sets_flags

    def touches(self) -> list[str]:
        own = [f"r{x}" for x in self.src if x != 32] + [f"m{a:x}" for a, _ in self.reads + self.writes]
        return own + SAVED * (self.category == "ExternalCall") + [FLAGS] * (self.category == "CondSelect")


def program(seed: int, n: int) -> tuple[str, list[Step]]:
    """Trace text of ``n`` random instructions and calls, and the steps it stands for."""
    rng = random.Random(seed)
    pool, slots = (0, 1, 2, 7, 20, 21), [0x4F0, 0x4F8, 0x500, 0x7F10]
    value = lambda: rng.randrange(1, 1 << 40)
    lines: list[str] = []
    steps: list[Step] = []

    def put(asm: str, step: Step, logged: int | None = None) -> None:
        pc = 0x9A0 + 4 * len(steps)
        shown = ", ".join(f"X{x}=0x{value():x}" for x in step.src[:1])
        lines.append(f'libq.so!{pc:x} 0x{0x61000000 + pc:x}: "\t{asm}" {shown} => ')
        rows = [("R", a, v) for a, v in step.reads] + [("W", a, v) for a, v in step.writes]
        for rw, a, v in rows[:logged]:
            lines.append(f"MEM {rw} 0x{a:x} [8 bytes]: {v.to_bytes(8, 'little').hex(' ')}  ........")
        steps.append(step)

    for _ in range(n):
        d, s, t, b = (rng.choice(pool) for _ in range(4))
        e = rng.choice([x for x in pool if x != d])
        base = rng.choice([x for x in (3, 9, 31) if x not in (d, e)])
        at, off = rng.choice(slots), rng.choice((8, 16, 24))
        name = "sp" if base == 31 else f"x{base}"
        kind = rng.randrange(17)
        if kind == 0:
            put(f"movz\tx{d}, #0x{off:x}", Step("movz", "ImmLoad", [d]))
        elif kind == 1:
            put(f"mvn\tw{d}, w{s}", Step("mvn", "DataMove", [d], [s]))
        elif kind == 2:
            put(f"eor\tx{d}, x{s}, x{t}", Step("eor", "Logic", [d], [s, t]))
        elif kind == 3:
            put(f"subs\tx{d}, x{s}, x{t}", Step("subs", "Arithmetic", [d], [s, t], sets_flags=True))
        elif kind == 4:
            put(f"cmp\tx{s}, x{t}", Step("cmp", "Compare", [], [s, t], sets_flags=True))
        elif kind == 5:
            put(f"csel\tx{d}, x{s}, x{t}, ge", Step("csel", "CondSelect", [d], [s, t]))
        elif kind == 6:
            put(f"movk\tx{d}, #0x{off:x}, lsl #16", Step("movk", "PartialModify", [d]))
        elif kind in (7, 8):
            put(f"ldr\tx{d}, [{name}, #0x{off:x}]", Step("ldr", "Load", [d], [base], [(at, value())]))
        elif kind == 9:
            put(f"ldr\tx{d}, [{name}], #{off}", Step("ldr", "Load", [d, base], [base], [(at, value())], base=base))
        elif kind == 10:
            put(f"ldp\tx{d}, x{e}, [{name}]", Step("ldp", "Load", [d, e], [base], [(at, value()), (at + 8, value())]))
        elif kind in (11, 12):
            put(f"str\tx{s}, [{name}, x{b}]", Step("str", "Store", [], [s, base, b], [], [(at, value())]))
        elif kind == 13:
            put(f"stp\tx{s}, x{t}, [{name}, #-{off}]!", Step("stp", "Store", [base], [s, t, base], [], [(at, value()), (at + 8, value())], base=base))
        elif kind == 14:  # only the first half was logged
            put(f"stp\tx{s}, xzr, [{name}]", Step("stp", "Store", [], [s, 32, base], [], [(at, value()), (at + 8, None)]), 1)
        elif kind == 15:
            put(f"cbz\tx{s}, #0x{off:x}", Step("cbz", "Branch", [], [s]))
        else:
            put("bl\t#0x40", Step("bl", "Branch"))
            lines.append(f" -> libm.so!pow({off}) ret: 0x{value():x}")
            steps.append(Step("", "ExternalCall", [0]))
    return "\n".join(lines) + "\n", steps


def forward(steps: list[Step], loc: str, start: int, max_idle: int = 10**9) -> tuple[list[tuple[int, list[str]]], str, list[tuple]]:
    """(rows with the live locations after each, why it stopped, (row, address, stored, read) of wrong values)."""
    live, rows, wrong, idle = {loc: None}, [(start, [loc])], [], 0
    for i in range(start + 1, len(steps)):
        step = steps[i]
        touched = any(x in live for x in step.touches())
        for a, v in step.reads if step.category == "Load" else []:
            if live.get(f"m{a:x}") not in (None, v):
                wrong.append((i, f"m{a:x}", live[f"m{a:x}"], v))
        fresh = {o for x, o in step.flows() if x in live}
        stored = {f"m{a:x}": v for a, v in step.writes}
        live = {x: v for x, v in live.items() if x not in step.clears()} | {x: stored.get(x) for x in fresh}
        idle = 0 if touched else idle + 1
        if touched:
            rows.append((i, sorted(live)))
        if not live:
            return rows, "AllTaintCleared", wrong
        if idle >= max_idle:
            return rows, "ScanLimitReached", wrong
    return rows, "EndOfTrace", wrong


def definition(steps: list[Step], loc: str, before: int) -> int | None:
    """The last step before that leaves a new value at a location."""
    return next((i for i in range(before - 1, -1, -1) if loc in steps[i].clears() or loc in [o for _, o in steps[i].flows()]), None)


def backward(steps: list[Step], loc: str, start: int, skip: bool = False) -> tuple[dict[int, set[str]], set[str]]:
    """({row: locations that are followed there}, locations that come from before the trace)."""
    rows, open_ = {start: {loc}}, set()
    at = start if loc in steps[start].clears() and not skip else definition(steps, loc, start)
    todo = [(at, loc)] if at is not None else []
    if at is None:
        open_.add(loc)
    seen = set(todo)
    while todo:
        i, out = todo.pop()
        if i != start:
            rows.setdefault(i, set())
        for x, o in steps[i].flows():
            if o != out:
                continue
            if i != start:
                rows[i].add(x)
            before = definition(steps, x, i)
            if before is None:
                open_.add(x)
            elif (before, x) not in seen:
                seen.add((before, x))
                todo.append((before, x))
    return rows, open_
