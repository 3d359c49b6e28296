import pytest
from pyspark.sql import functions as F

from lodestrand.functions.hashing import murmur2
from lodestrand.functions.huffman import codes, decode
from lodestrand.functions.types import NAMES, infer_type, signed_digits, stop_bit_width, type_name

EDGES = {
    "": "NULL", "   ": "UINT", "007": "UINT", "+5": "UINT", "-5": "SINT", "-": "SINT", "+": "UINT", ".": "DECIMAL", "5-3": "SINT", "2015-01-02": "ASCII", "01-2015": "SINT", "1.2.3": "ASCII",
    "10.0.0.1": "ASCII", "1.2.3.4.5": "ASCII", "----": "ASCII", "9" * 128: "ASCII", "9" * 9: "UINT", "9" * 10: "ULONG", "9" * 18: "ULONG", "9" * 19: "ASCII", "-" + "9" * 10: "SLONG", "12 34": "ASCII", "é": "ASCII", "30.62": "DECIMAL", " 42": "UINT",
}


def test_types_of_edge_cases(spark):
    df = spark.createDataFrame([(k,) for k in EDGES] + [(None,)], "v string")
    got = {r.v: r.t for r in df.select("v", type_name(infer_type(F.col("v"))).alias("t")).collect()}
    assert got == EDGES | {None: "NULL"}


def test_bytes_where_ascii_is_not_forced(spark):
    assert NAMES[spark.createDataFrame([("é",)], "v string").select(infer_type(F.col("v"), False).alias("t")).first().t] == "BYTES"


def test_signed_digits(spark):
    rows = {"5-3": -53, "1,234": 1234, "-": 0, "": 0, "--1": 1, "9" * 30: None}
    got = {r.v: r.x for r in spark.createDataFrame([(k,) for k in rows], "v string").select("v", signed_digits(F.col("v")).alias("x")).collect()}
    assert got == rows


def test_stop_bit_width(spark):
    def width(v):
        m = v - 1 if v > 0 else -v
        return 1 if v in (0, 1) else (6 + m.bit_length()) // 7 if m else 1

    values = [0, 1, 2, 127, 128, 129, -1, -127, -128, 1 << 40, -(1 << 40)]
    got = {r.v: r.w for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", stop_bit_width(F.col("v")).alias("w")).collect()}
    assert got == {v: width(v) for v in values}


def _murmur(data: bytes, seed: int = 31) -> int:
    m, mask, h, i = 0x5BD1E995, 0xFFFFFFFF, seed ^ len(data), 0
    while len(data) - i >= 4:
        k = int.from_bytes(data[i : i + 4], "little") * m & mask
        h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
        i += 4
    if i < len(data):
        h = (h ^ int.from_bytes(data[i:], "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def test_murmur2_against_a_loop(spark):
    words = ["", "a", "ab", "abc", "abcd", "hello world", "ümlaut €", "x" * 101]
    got = {r.v: r.h for r in spark.createDataFrame([(w,) for w in words], "v string").select("v", murmur2(F.col("v")).alias("h")).collect()}
    assert got == {w: _murmur(w.encode()) for w in words}


@pytest.mark.parametrize("freqs", [[(i, i) for i in range(11)], [(i, 10 - i) for i in range(1, 10)], [("a", 5)]])
def test_prefix_codes(freqs):
    table = codes(freqs)
    bits = {v: bin(c)[3:] for v, c in table.items()}
    assert all(a == b or not bits[b].startswith(bits[a]) for a in bits for b in bits)
    if len(bits) > 1:
        assert sum(2.0 ** -len(x) for x in bits.values()) == 1
        word = [v for v, _ in freqs] * 2
        assert decode("".join(bits[v] for v in word), table) == word


def test_no_symbols():
    with pytest.raises(ValueError):
        codes([])
