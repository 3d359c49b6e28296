"""Tasks: ingest (text to catalog), encode (text and catalog to typed tables), pipe (both)."""

from __future__ import annotations

import argparse
import gzip

from pyspark.sql import SparkSession

from ..operators.conform import write_templates
from ..operators.schema import discover
from ..sources.catalog import from_xml, load, save, to_xml
from ..sources.text import read_lines


def ingest(spark: SparkSession, csv: str, catalog: str) -> int:
    """Discover the templates of a text and save them; the number of templates."""
    templates = discover(read_lines(spark, csv))
    raw = to_xml(templates)
    save(spark, gzip.compress(raw) if catalog.endswith(".gz") else raw, catalog)
    return len(from_xml(load(spark, catalog)))


def encode(spark: SparkSession, csv: str, catalog: str, out: str) -> None:
    """Write a text's records by template as Parquet."""
    write_templates(read_lines(spark, csv).select("line"), from_xml(load(spark, catalog)), out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestrand")
    p.add_argument("task", type=str.lower, choices=("ingest", "encode", "pipe"))
    p.add_argument("--csv", required=True)
    p.add_argument("--catalog", required=True)
    p.add_argument("--out")
    a = p.parse_args(args)
    if a.task != "ingest" and not a.out:
        p.error("--out is needed")
    spark = SparkSession.builder.appName("lodestrand").getOrCreate()
    if a.task != "encode":
        print(ingest(spark, a.csv, a.catalog), "templates")
    if a.task != "ingest":
        encode(spark, a.csv, a.catalog, a.out)


if __name__ == "__main__":
    main()
