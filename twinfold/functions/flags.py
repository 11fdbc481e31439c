"""The decision and state bits of a file as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decisions, states, and what is stored.
NONE, DUP, JUNK, KEEP, GONE, SAME, STORED = 0, 1, 2, 3, 4, 16, 15
_LETTERS = ("", "D", "J", "K")


def _bits(flag: Column | str, mask: int) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(mask))


def decision(flag: Column | str = "flag") -> Column:
    return _bits(flag, KEEP)


def is_dup(flag: Column | str = "flag") -> Column:
    return decision(flag) == DUP


def is_junk(flag: Column | str = "flag") -> Column:
    return decision(flag) == JUNK


def is_keep(flag: Column | str = "flag") -> Column:
    return decision(flag) == KEEP


def is_gone(flag: Column | str = "flag") -> Column:
    return _bits(flag, GONE) != 0


def may_remove(flag: Column | str = "flag") -> Column:
    return decision(flag).isin(DUP, JUNK)


def is_safe(flag: Column | str = "flag") -> Column:
    """Exists and isn't marked for removal."""
    return _bits(flag, STORED).isin(NONE, KEEP)


def is_stored(flag: Column | str = "flag") -> Column:
    """Whether an index keeps the row: it exists, or a decision is recorded."""
    return ~is_gone(flag) | (decision(flag) != NONE)


def flag_text(flag: Column | str = "flag") -> Column:
    letter = F.element_at(F.array(*map(F.lit, _LETTERS)), decision(flag) + 1)
    known = _bits(flag, STORED & ~(KEEP | GONE)) == 0
    return F.when(~known | (letter == ""), "").otherwise(F.concat(letter, F.when(is_gone(flag), "X").otherwise("")))


def parse_flag(text: Column | str) -> Column:
    """The bits of a flag's text; null if it isn't one."""
    text = F.col(text) if isinstance(text, str) else text
    value = F.array_position(F.array(*map(F.lit, _LETTERS)), F.rtrim(text, F.lit("X"))).cast("int") - 1
    return F.when(text.rlike("^([DJK]X?)?$"), value + F.when(text.endswith("X"), GONE).otherwise(0))
