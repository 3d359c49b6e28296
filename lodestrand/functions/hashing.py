"""The 32-bit Murmur2 hash as a column expression, and its SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M, MASK, SEED = 0x5BD1E995, 0xFFFFFFFF, 31


def _times(x: Column) -> Column:
    return (x * F.lit(M).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))  # below 2^63, so ANSI mode is content


def _right(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, n))


def _byte(raw: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, at, F.lit(1))), 16, 10).cast("long")


def murmur2(v: Column, seed: int = SEED) -> Column:
    """Murmur2 of a string's UTF-8 bytes (or a binary), as a non-negative long. Null gives null."""
    raw = v.cast("binary")
    n = F.octet_length(raw)
    whole = F.floor(n / 4).cast("int")

    def step(h: Column, i: Column) -> Column:
        at = (i * 4 + 1).cast("int")
        k = sum((F.shiftleft(_byte(raw, at + j), 8 * j) for j in range(1, 4)), _byte(raw, at))
        return _times(h).bitwiseXOR(_times(_right(_times(k), 24)))

    start = F.lit(seed).cast("long").bitwiseXOR(n.cast("long"))
    h = F.aggregate(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), start, step)
    rest, at = n % 4, whole * 4
    tail = [F.when(rest > j, F.shiftleft(_byte(raw, at + 1 + j), 8 * j)).otherwise(F.lit(0).cast("long")) for j in range(3)]
    mixed = h.bitwiseXOR(tail[0]).bitwiseXOR(tail[1]).bitwiseXOR(tail[2])
    h = F.when(rest > 0, _times(mixed)).otherwise(h)
    return _right(_times(_right(h, 13)), 15)


def murmur2_sql(v: str, seed: int = SEED) -> str:
    """The same for a string of ASCII characters."""
    byte = lambda at: f"CAST(ascii(substring({v}, CAST({at} AS BIGINT), 1)) AS BIGINT)"
    times = lambda x: f"(({x} * {M}) & {MASK})"
    right = lambda x, n: f"xor({x}, {x} >> {n})"
    k = " + ".join(f"{byte(f'4 * i + {j + 1}')} * {256**j}" for j in range(4))
    blocks = f"list_transform(range(0, length({v}) // 4), lambda i: {k})"
    h = f"list_reduce(list_concat([xor(CAST({seed} AS BIGINT), length({v}))], {blocks}), lambda h, k: xor({times('h')}, {times(right(times('k'), 24))}))"
    rest = f"length({v}) % 4"
    tail = lambda j: f"(CASE WHEN {rest} > {j} THEN {byte(f'length({v}) // 4 * 4 + {j + 1}')} * {256**j} ELSE 0 END)"
    return f"(SELECT {right('b', 15)} FROM (SELECT {times(right('a', 13))} AS b FROM (SELECT CASE WHEN {rest} > 0 THEN {times(f'xor(xor(xor(h0, {tail(0)}), {tail(1)}), {tail(2)})')} ELSE h0 END AS a FROM (SELECT {h} AS h0))))"
