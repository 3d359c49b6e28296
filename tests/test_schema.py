import random

from lodestrand.functions.types import ASCII, DECIMAL, NULL, SLONG, UINT, ULONG
from lodestrand.operators.conform import conform, typed
from lodestrand.operators.schema import discover, merge_shapes

LINES = ["0,1970,1,2"] + [f"A,Some name,,-30.62,82.25,1.00,2.50,{x}" for x in ("934400", "-420888", "10500000000", "-64600000000", "552000", "2825600")]


def shapes(templates):
    return [(t.types, t.count) for t in templates]


def test_templates_of_mixed_lines(spark):
    found = discover(spark.createDataFrame([(x,) for x in LINES], "line string"))
    b = (ASCII, ASCII, NULL, DECIMAL, DECIMAL, DECIMAL, DECIMAL)
    assert shapes(found) == [((*b, ULONG), 4), ((*b, SLONG), 2), ((UINT,) * 4, 1)]


def test_partitions_and_order_do_not_matter(spark):
    lines = LINES * 9 + ["1,,x", "1,2.5,x", "7,8,x", ",3,x"] * 3
    want = None
    for n in (1, 2, 7, 64):
        random.Random(n).shuffle(lines)
        got = discover(spark.createDataFrame([(x,) for x in lines], "line string").repartition(n))
        want = want or got
        assert got == want


def test_integers_widen_to_a_decimal_that_contains_them():
    found = merge_shapes([("0", 3), ("2", 2), ("6", 1)])
    assert shapes(found) == [((DECIMAL,), 6)]


def test_null_joins_an_only_sibling_but_not_one_of_several():
    assert [(t.types, t.optional) for t in merge_shapes([("7", 1), ("0", 2)])] == [((UINT,), (True,))]
    assert len(merge_shapes([("7", 1), ("0", 2), ("4", 2)])) == 3


def test_typed_and_long_form(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "line string")
    found = discover(lines)
    rows = typed(lines, found[0], found).collect()
    assert sorted(r.c7 for r in rows) == [552000, 934400, 2825600, 10500000000]
    assert all(r.c2 is None and str(r.c3) == "-30.620000000" for r in rows)
    assert conform(lines, found).count() == 4 + 6 * 8


def test_empty_input(spark):
    assert discover(spark.createDataFrame([], "line string")) == []
