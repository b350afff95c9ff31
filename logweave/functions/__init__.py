"""Column expressions: text matching, traces, registers and mnemonics."""
