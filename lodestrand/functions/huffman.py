"""Prefix codes from a frequency table; the table is small, so this is driver work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SYMBOLS = 1 << 16


def codes(frequencies: list[tuple]) -> dict:
    """value -> code with a leading 1 before the path (left 0, right 1). A value given again is ignored.

    The two rarest trees join, the rarer on the left; ties keep their order. One value alone has the code 1.
    """
    import heapq

    seen: dict = {}
    for v, n in frequencies:
        seen.setdefault(v, n)
    if not seen:
        raise ValueError("no symbols")
    heap = [(n, i, v, None) for i, (v, n) in enumerate(seen.items())]
    heapq.heapify(heap)
    i = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], i, None, (a, b)))
        i += 1
    out, todo = {}, [(heap[0], 1)]
    while todo:
        (_, _, v, kids), code = todo.pop()
        if kids is None:
            out[v] = code
        else:
            todo += [(kids[0], code << 1), (kids[1], code << 1 | 1)]
    return out


def decode(bits: str, table: dict) -> list:
    """Values of a string of path bits."""
    back, out, code = {c: v for v, c in table.items()}, [], 1
    for b in bits:
        code = code << 1 | (b == "1")
        if code in back:
            out.append(back[code])
            code = 1
    return out


def code_table(df: DataFrame, column: str, most: int = MAX_SYMBOLS) -> DataFrame:
    """value, freq, code, bits for the values of a column. More than `most` different values are an error, as codes are made on the driver."""
    found = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("freq")).orderBy("freq", "value").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} symbols in {column}")
    table = codes([(r.value, r.freq) for r in found]) if found else {}
    kind = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame([(r.value, r.freq, table[r.value], table[r.value].bit_length() - 1) for r in found], f"value {kind}, freq long, code long, bits int")
