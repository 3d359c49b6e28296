"""Second pass: every record to its template, every field to the template's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import ASCII, BYTES, DECIMAL, NULL, SINT, SLONG, UINT, ULONG, count_of, infer_type, signed_digits
from ..sources.text import split_fields
from .schema import SPARK_TYPES, Template, mapping, signature


def _number(v: Column, t: Column) -> Column:
    """A numeric field as a decimal; long text in the whole part is widened, never cut."""
    dot = v.try_cast("decimal(38,9)")
    return F.when(t.isin(UINT, SINT, ULONG, SLONG), signed_digits(v).cast("decimal(38,9)")).otherwise(F.coalesce(dot, F.when(count_of(v, ".") == 1, F.lit(0).cast("decimal(38,9)"))))


def to_long(number: Column) -> Column:
    """A decimal to a long, half to even; null where it does not fit."""
    return F.bround(number, 0).try_cast("long")


def conform(lines: DataFrame, templates: list[Template], line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form: `keep`, template_id, pos, type, and the value as integer, number or text (null: absent).

    The mapping has a row for each shape that discovery found and is broadcast; a line of another shape has no
    template (null) and its fields stay text.
    """
    spark = lines.sparkSession
    rows = lines.withColumn("sig", signature(F.col(line))).join(F.broadcast(mapping(spark, templates)), "sig", "left")
    rows = rows.select(*keep, "template_id", "types", F.posexplode(split_fields(F.col(line))).alias("pos", "raw"))
    code = F.coalesce(F.get("types", F.col("pos")), F.lit(ASCII))
    rows = rows.select(*keep, "template_id", "pos", code.alias("type"), infer_type(F.col("raw")).alias("seen"), "raw")
    number = F.when((F.col("seen") != NULL) & F.col("seen").isin(UINT, SINT, ULONG, SLONG, DECIMAL), _number(F.ltrim("raw"), F.col("seen")))
    return rows.select(*keep, "template_id", "pos", "type", F.when(F.col("type").isin(UINT, SINT, ULONG, SLONG), to_long(number)).alias("integer_value"), F.when(F.col("type") == DECIMAL, number).alias("decimal_value"), F.when(F.col("type").isin(ASCII, BYTES, NULL) & (F.col("seen") != NULL), F.col("raw")).alias("text_value"))


def conform_columns(lines: DataFrame, templates: list[Template], width: int, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide form of conform(): `keep`, template_id, and for each of `width` places integer_i, decimal_i and text_i.

    A field's own type is read off the record's shape, so each is inferred once, and nothing is shuffled.
    """
    rows = lines.withColumn("sig", signature(F.col(line))).join(F.broadcast(mapping(lines.sparkSession, templates)), "sig", "left")
    rows = rows.withColumn("parts", split_fields(F.col(line)))
    out = []
    for i in range(width):
        raw = F.get("parts", F.lit(i))
        seen, kind = F.substring("sig", i + 1, 1).try_cast("int"), F.coalesce(F.get("types", F.lit(i)), F.lit(ASCII))
        number = F.when(seen.isin(UINT, SINT, ULONG, SLONG, DECIMAL), _number(F.ltrim(raw), seen))
        out += [F.when(kind.isin(UINT, SINT, ULONG, SLONG), to_long(number)).alias(f"integer_{i}"), F.when(kind == DECIMAL, number).alias(f"decimal_{i}"), F.when(kind.isin(ASCII, BYTES, NULL) & (seen != NULL), raw).alias(f"text_{i}")]
    return rows.select(*keep, "template_id", *out)


def typed(lines: DataFrame, template: Template, templates: list[Template], line: str = "line", names: list[str] | None = None) -> DataFrame:
    """The records of one template as a table with typed columns c0..cN."""
    spark = lines.sparkSession
    rows = lines.withColumn("sig", signature(F.col(line))).join(F.broadcast(mapping(spark, templates)), "sig").where(F.col("template_id") == template.template_id)
    parts = split_fields(F.col(line))
    out = []
    for i, t in enumerate(template.types):
        v = F.when(F.length(F.get(parts, F.lit(i))) > 0, F.get(parts, F.lit(i)))
        x = _number(F.ltrim(v), infer_type(v))
        x = v if t in (ASCII, BYTES, NULL) else x if t == DECIMAL else to_long(x)
        out.append(x.cast(SPARK_TYPES[t]).alias(names[i] if names else f"c{i}"))
    return rows.select(*out)


def write_templates(lines: DataFrame, templates: list[Template], path: str, line: str = "line") -> None:
    """One Parquet folder for each template: path/template=<id>.

    The input is read once, into a folder of lines for each template, from which that template's table is made.
    """
    spark = lines.sparkSession
    apart = f"{path}/_lines"
    rows = lines.withColumn("sig", signature(F.col(line))).join(F.broadcast(mapping(spark, templates)), "sig")
    rows.select(F.col(line).alias("line"), "template_id").write.mode("overwrite").partitionBy("template_id").parquet(apart)
    for t in templates:
        own = spark.read.schema("line string, template_id int").parquet(apart).where(F.col("template_id") == t.template_id).select("line")
        typed(own, t, templates).write.mode("overwrite").parquet(f"{path}/template={t.template_id}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(apart)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dispatch(df: DataFrame, table: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Give rows the value listed for their key, else the default. The planner chooses the join by the table's size."""
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))
