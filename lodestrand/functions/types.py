"""Field typing as column expressions: class counts, type inference, digit parsing and stop-bit widths.

The same rules exist as SQL text for the oracle, built from the same pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT, SINT, ULONG, SLONG, ASCII, BYTES, DECIMAL, NULL = range(8)
NAMES = ("UINT", "SINT", "ULONG", "SLONG", "ASCII", "BYTES", "DECIMAL", "NULL")
SUPER = {UINT: ULONG, ULONG: DECIMAL, SINT: SLONG, SLONG: DECIMAL, DECIMAL: ASCII, ASCII: BYTES}


def count_of(v: Column, char: str) -> Column:
    """How often a one-byte character occurs."""
    return F.length(v) - F.length(F.replace(v, F.lit(char), F.lit("")))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def infer_type(v: Column, force_ascii: bool = True) -> Column:
    """The type code of a field's text; leading spaces do not count, null and empty are NULL.

    Text: a byte that is no digit, sign, dot or comma, or more than one sign of a kind, dot, or 18 digits. Numbers: a
    dot makes a decimal, more than nine digits a long, one minus anywhere a signed value.
    """
    t = F.ltrim(v)
    n, minus, plus, dots = F.length(digits_of(t)), count_of(t, "-"), count_of(t, "+"), count_of(t, ".")
    code = F.when(v.isNull() | (F.length(v) == 0), NULL)
    code = code.when(t.rlike(r"[^\x00-\x7E]"), ASCII if force_ascii else BYTES)
    code = code.when(t.rlike(r"[^0-9+\-.,]") | (minus > 1) | (plus > 1) | (dots > 1) | (n > 18), ASCII)
    code = code.when(dots == 1, DECIMAL).when((n > 9) & (minus == 1), SLONG).when(n > 9, ULONG).when(minus == 1, SINT)
    return code.otherwise(UINT)


def infer_type_sql(v: str) -> str:
    t = f"ltrim({v}, ' ')"
    n, c = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))", lambda x: f"(length({t}) - length(replace({t}, '{x}', '')))"
    return f"""CASE WHEN {v} IS NULL OR length({v}) = 0 THEN 7 WHEN regexp_matches({t}, '[^\\x00-\\x7E]') THEN 4
      WHEN regexp_matches({t}, '[^0-9+\\-.,]') OR {c('-')} > 1 OR {c('+')} > 1 OR {c('.')} > 1 OR {n} > 18 THEN 4
      WHEN {c('.')} = 1 THEN 6 WHEN {n} > 9 AND {c('-')} = 1 THEN 3 WHEN {n} > 9 THEN 2 WHEN {c('-')} = 1 THEN 1 ELSE 0 END"""


def type_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in NAMES]), code + 1)


def signed_digits(v: Column) -> Column:
    """The value of a field's digits alone, negative if it has exactly one minus (anywhere); 0 without digits, null beyond a long."""
    value = F.when(F.length(digits_of(v)) == 0, F.lit(0).cast("long")).otherwise(digits_of(v).try_cast("long"))
    return F.when(count_of(v, "-") == 1, -value).otherwise(value)


def decimal_places(v: Column) -> Column:
    """Digits after the first dot; 0 without one."""
    return F.when(F.instr(v, ".") > 0, F.length(v) - F.instr(v, ".")).otherwise(0).cast("long")


def stop_bit_width(v: Column) -> Column:
    """Bytes of seven bits that a long needs."""
    v = v.cast("long")
    m = F.when(v > 0, v - 1).otherwise(-v)
    return F.when(v.isin(0, 1), 1).otherwise(F.floor((F.length(F.bin(m)) + 6) / 7)).cast("long")


def stop_bit_width_sql(v: str) -> str:
    return f"CAST(CASE WHEN {v} IN (0, 1) THEN 1 ELSE (length(bin(CASE WHEN {v} > 0 THEN {v} - 1 ELSE -({v}) END)) + 6) // 7 END AS BIGINT)"
