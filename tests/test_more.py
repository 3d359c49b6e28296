"""Catalogs, quoted fields, membership and template files on small tables."""

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import conform, membership, schema
from lodestrand.sources import catalog, text


def test_a_catalog_in_a_namespace_loads():
    raw = b"""<?xml version="1.0"?><templates xmlns="http://example.org/t"><template id="7"><uInt32 name="a"><copy/></uInt32><decimal name="b" presence="optional"/><string name="c"><constant value="1.0"/></string></template></templates>"""
    (t,) = catalog.from_xml(raw)
    assert t.template_id == 7 and t.optional == (False, True, False) and len(t.types) == 3
    with pytest.raises(ValueError):
        catalog.from_xml(b"<templates/>")


def test_quoted_fields(spark):
    lines = {'a,"b,c"': ["a", "b,c"], "": [""], ",": ["", ""], ',a,"",': ["", "a", "", ""], '"x ""y"" z",1': ['x "y" z', "1"], '"open,1': ['"open', "1"], 'a"b"c,"d" e': ['a"b"c', '"d" e'], '"two\nlines",3': ["two\nlines", "3"]}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.f for r in df.select("line", text.split_quoted(F.col("line")).alias("f")).collect()} == lines


def test_the_bitmap_finds_every_member_and_few_others(spark):
    members, rows = spark.range(0, 3000).select((F.col("id") * 7).alias("k")), spark.range(0, 12000).withColumnRenamed("id", "k")
    got = {r.k for r in membership.found(rows, "k", membership.bitmap(members, "k")).collect()}
    exact = {r.k for r in rows.join(members, "k", "left_semi").collect()}
    assert exact <= got and len(got - exact) <= 2
    small = {r.k for r in membership.found(rows, "k", membership.bitmap(members, "k", 2, 1 << 13), 2, 1 << 13).collect()}
    assert exact <= small and len(small - exact) < 12000


def test_templates_are_written_apart(spark, tmp_path):
    lines = spark.createDataFrame([("1,a,2.50",), ("2,b,",), ("x,7",), ("y,8",)], "line string")
    found = schema.discover(lines)
    conform.write_templates(lines, found, str(tmp_path))
    tables = {t.template_id: spark.read.parquet(f"{tmp_path}/template={t.template_id}") for t in found}
    assert sorted(x.count() for x in tables.values()) == [2, 2] and sorted(len(x.columns) for x in tables.values()) == [2, 3]
    wide = conform.conform_columns(lines, found, 3, keep=("line",)).orderBy("line").collect()
    assert [(r.integer_0, r.text_1, r.decimal_2) for r in wide[:2]] == [(1, "a", 2.5), (2, "b", None)] and wide[2].integer_1 == 7
