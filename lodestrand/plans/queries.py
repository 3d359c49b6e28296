"""One query for each operator over the test tables, and DuckDB SQL with the same rows.

Order-dependent operators use the tables' keys, never the order in a file. Sums behind windows are of decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import huffman
from ..functions.hashing import murmur2, murmur2_sql
from ..functions.types import decimal_places, infer_type, infer_type_sql, signed_digits, stop_bit_width_sql, type_name
from ..operators import conform as C
from ..operators import encode as E
from ..operators import membership as M
from ..operators import rolling as R
from ..operators import schema as S
from ..operators import stats as A
from ..sources import text as X
from ..streaming import stream as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_lines(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    fields = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")]
    return o.select(F.col("o_orderkey").alias("rec"), F.concat_ws(",", *[F.coalesce(x, F.lit("")) for x in fields]).alias("line"))


ORDERS = """o AS (SELECT o_orderkey AS rec, [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority] AS f FROM orders)"""
ORDER_FIELDS = f"WITH {ORDERS}, x AS (SELECT rec, unnest(range(0, 6)) AS pos, unnest(f) AS raw FROM o)"


def event_lines(spark, d) -> DataFrame:
    """Lines of one family with absent and wide values: id, type, amount or nothing, a user number of varying width and sign."""
    e = table(spark, d, "events")
    amount = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    user = F.when(F.col("event_id") % 5 == 0, -F.col("user_id") - 1).when(F.col("event_id") % 11 == 0, (F.col("user_id") + 1) * F.lit(10_000_000_000)).otherwise(F.col("user_id"))
    return e.select(F.col("event_id").alias("rec"), F.concat_ws(",", F.col("event_id").cast("string"), "event_type", amount, user.cast("string")).alias("line"))


EVENTS = """e AS (SELECT event_id AS rec, event_id, CAST(event_id AS VARCHAR) AS f0, event_type AS f1, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS f2,
  CAST(CASE WHEN event_id % 5 = 0 THEN -user_id - 1 WHEN event_id % 11 = 0 THEN (user_id + 1) * 10000000000 ELSE user_id END AS VARCHAR) AS f3 FROM events)"""
EVENT_TYPES = f"{EVENTS}, t AS (SELECT *, {infer_type_sql('f0')} AS t0, {infer_type_sql('f1')} AS t1, {infer_type_sql('f2')} AS t2, {infer_type_sql('f3')} AS t3 FROM e)"


@query(f"{ORDER_FIELDS} SELECT rec, CAST(pos AS INT) AS pos, raw FROM x")
def split_fields(spark, d):
    return X.explode_fields(order_lines(spark, d)).select("rec", "pos", "raw")


@query(f"WITH {ORDERS} SELECT rec, array_to_string(f, ',') AS line FROM o")
def assemble_records(spark, d):
    return X.assemble(X.explode_fields(order_lines(spark, d)).select("rec", "pos", "raw"), "rec")


@query(f"{ORDER_FIELDS}, y AS (SELECT pos, {infer_type_sql('raw')} AS t FROM x) SELECT CAST(pos AS INT) AS pos, ['UINT','SINT','ULONG','SLONG','ASCII','BYTES','DECIMAL','NULL'][t + 1] AS type, count(*) AS n FROM y GROUP BY ALL")
def infer_field_types(spark, d):
    rows = X.explode_fields(order_lines(spark, d))
    return rows.groupBy("pos", type_name(infer_type(F.col("raw"))).alias("type")).agg(F.count("*").alias("n"))


EDGES = ["", "   ", "007", "+5", "-5", "-", "+", ".", "5-3", "2015-01-02", "01-2015", "1.2.3", "10.0.0.1", "1.2.3.4.5", "1-2-3-4-5", "9" * 128, "123456789", "1234567890", "9" * 18, "9" * 19, "12 34", "é", "1,234", "-1234567890", " 42", "-30.62", "1e5"]


@query(f"SELECT v, CAST({infer_type_sql('v')} AS INT) AS code FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in EDGES)}) AS z(v)")
def infer_edge_cases(spark, d):
    return spark.createDataFrame([(x,) for x in EDGES], "v string").select("v", infer_type(F.col("v")).cast("int").alias("code"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS a, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(length(a) - instr(a, '.') AS BIGINT) AS price_places, CAST(0 AS BIGINT) AS quantity_places FROM x")
def field_decimal_places(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", decimal_places(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("price_places"), decimal_places(F.col("l_quantity").cast("long").cast("string")).alias("quantity_places"))


@query("WITH x AS (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events) SELECT event_id, CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN length(v) - length(replace(v, '-', '')) = 1 THEN -1 ELSE 1 END AS digits FROM x")
def parse_numeric_digits(spark, d):
    return table(spark, d, "events").select("event_id", signed_digits(F.col("value").cast("decimal(18,2)").cast("string")).alias("digits"))


@query(f"WITH {ORDERS}, {EVENT_TYPES}, s AS (SELECT array_to_string(list_transform(f, lambda v: {infer_type_sql('v')}), '') AS sig FROM o UNION ALL SELECT concat(t0, t1, t2, t3) FROM t) SELECT sig, count(*) AS n FROM s GROUP BY 1")
def signature_counts(spark, d):
    return S.signature_counts(order_lines(spark, d).unionByName(event_lines(spark, d)))


MERGED = "CASE WHEN t3 IN (1, 3) THEN 'SINT' ELSE 'ULONG' END"


@query(f"WITH {EVENT_TYPES} SELECT 'UINT,' || {MERGED} AS types, count(*) AS n FROM t GROUP BY 1")
def template_merge_numeric(spark, d):
    lines = event_lines(spark, d).select(F.concat(F.split("line", ",")[0], F.lit(","), F.split("line", ",")[3]).alias("line"))
    return S.template_table(spark, S.discover(lines)).select("types", "n")


@query(f"WITH {EVENT_TYPES} SELECT 'UINT,DECIMAL?' AS types, count(*) AS n FROM t")
def template_merge_nulls(spark, d):
    lines = event_lines(spark, d).select(F.concat(F.split("line", ",")[0], F.lit(","), F.split("line", ",")[2]).alias("line"))
    return S.template_table(spark, S.discover(lines)).select("types", "n")


FULL = f"WITH {ORDERS}, {EVENT_TYPES}, r AS (SELECT 'UINT,ASCII,DECIMAL?,' || {MERGED} AS types, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT 'UINT,UINT,ASCII,DECIMAL,ASCII,ASCII', count(*) FROM o)"


@query(FULL + " SELECT types, CAST(len(string_split(types, ',')) AS INT) AS n_fields, n FROM r")
def template_discovery_full(spark, d):
    lines = order_lines(spark, d).unionByName(event_lines(spark, d))
    return S.template_table(spark, S.discover(lines)).select("types", "n_fields", "n")


@query(f"WITH {EVENT_TYPES} SELECT rec, event_id AS id, f1 AS kind, CAST(CAST(nullif(f2, '') AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(f3 AS BIGINT) AS user_no FROM t")
def conform_records(spark, d):
    lines = event_lines(spark, d)
    rows = C.conform_columns(lines, S.discover(lines), 4, keep=("rec",))
    return rows.select("rec", F.col("integer_0").alias("id"), F.col("text_1").alias("kind"), F.col("decimal_2").cast("double").alias("amount"), F.col("integer_3").alias("user_no"))


@query(f"WITH {EVENT_TYPES} SELECT CAST(pos AS INT) AS pos, count(*) AS n, count(v) AS filled FROM (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([f0, f1, nullif(f2, ''), f3]) AS v FROM t) GROUP BY 1")
def conform_fields(spark, d):
    lines = event_lines(spark, d)
    rows = C.conform(lines, S.discover(lines), keep=("rec",))
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.count(F.coalesce("text_value", F.col("integer_value").cast("string"), F.col("decimal_value").cast("string"))).alias("filled"))


@query("SELECT n_nationkey, CAST(round_even(n_nationkey + 0.5, 0) AS BIGINT) AS up, CAST(round_even(-n_nationkey - 0.5, 0) AS BIGINT) AS down FROM nation")
def half_even_rounding(spark, d):
    k = F.col("n_nationkey").cast("decimal(38,9)")
    half = F.lit("0.5").cast("decimal(38,9)")
    return table(spark, d, "nation").select("n_nationkey", C.to_long((k + half).cast("decimal(38,9)")).alias("up"), C.to_long((-k - half).cast("decimal(38,9)")).alias("down"))


@query("SELECT 'UINT,DECIMAL' AS types, count(*) AS n FROM events")
def template_merge_decimal(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.abs("value").cast("long").cast("string")).otherwise(F.abs("value").cast("decimal(18,2)").cast("string"))
    return S.template_table(spark, S.discover(e.select(F.concat_ws(",", F.col("event_id").cast("string"), v).alias("line")))).select("types", "n")


@query("""SELECT c_custkey AS rec, CAST(unnest([0, 1, 2]) AS INT) AS pos, unnest([c_name || ', "' || c_mktsegment || '"', CAST(c_custkey AS VARCHAR), '']) AS raw FROM customer""")
def quoted_fields(spark, d):
    c = table(spark, d, "customer")
    quoted = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""'))
    lines = c.select(F.col("c_custkey").alias("rec"), F.concat_ws(",", quoted, F.col("c_custkey").cast("string"), F.lit("")).alias("line"))
    return lines.select("rec", F.posexplode(X.split_quoted(F.col("line"))).alias("pos", "raw"))


@query("SELECT event_id, coalesce(rank, 99) AS template_id FROM events LEFT JOIN (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) AS INT) AS rank FROM (SELECT event_type FROM events GROUP BY 1 HAVING count(*) * (SELECT count(DISTINCT event_type) FROM events) >= (SELECT count(event_type) FROM events))) USING (event_type)")
def template_dispatch(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    # types of at least the mean number of records have a template, rarer ones the default; a row per type
    counts = e.where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    known = counts.crossJoin(F.broadcast(mean)).where("n >= mean").select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("template_id"))
    return C.dispatch(e, known, ["event_type"], "template_id", 99).select("event_id", "template_id")


@query(f"SELECT 'l_quantity' AS field, {stop_bit_width_sql('CAST(l_quantity AS BIGINT)')} AS width, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_orderkey', {stop_bit_width_sql('l_orderkey')} AS width, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'p_name', {stop_bit_width_sql('strlen(p_name)')} AS width, count(*) FROM part GROUP BY ALL")
def byte_width_hist(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("l_quantity"), "l_orderkey")
    one = lambda df, c: A.width_histogram(df, c).select(F.lit(c).alias("field"), "width", "n")
    return one(x, "l_quantity").union(one(x, "l_orderkey")).union(one(table(spark, d, "part"), "p_name"))


def quantities(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")


PREV = "WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_returnflag, lag(CAST(l_quantity AS BIGINT)) OVER w AS prev, lag(CAST(l_linenumber AS BIGINT)) OVER w AS prevn, lag(l_returnflag) OVER w AS prevf FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity))"
KEY = (["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "q"])


@query(f"{PREV} SELECT {stop_bit_width_sql('(q - coalesce(prev, 0))')} AS width, count(*) AS n FROM x GROUP BY 1")
def delta_hist(spark, d):
    return A.delta_histogram(quantities(spark, d), "q", *KEY)


@query(f"{PREV} SELECT {stop_bit_width_sql('q')} AS width, count(*) AS n FROM x WHERE q = prev GROUP BY 1")
def copy_hist(spark, d):
    return A.copy_histogram(quantities(spark, d), "q", *KEY)


@query(f"{PREV} SELECT {stop_bit_width_sql('l_linenumber')} AS width, count(*) AS n FROM x WHERE l_linenumber = prevn + 1 GROUP BY 1")
def increment_hist(spark, d):
    return A.increment_histogram(quantities(spark, d).withColumn("l_linenumber", F.col("l_linenumber").cast("long")), "l_linenumber", *KEY)


def _cost_sql(name: str, v: str, p: str) -> str:
    w = stop_bit_width_sql(v)
    return f"SELECT '{name}' AS field, CAST(sum({w}) AS BIGINT) AS a, CAST(sum(CASE WHEN {v} = {p} THEN 0 ELSE {w} END) AS BIGINT) AS b, CAST(sum(CASE WHEN {v} = {p} + 1 THEN 0 ELSE {w} END) AS BIGINT) AS c, CAST(sum({stop_bit_width_sql(f'({v} - coalesce({p}, 0))')}) AS BIGINT) AS e FROM x"


@query(f"{PREV}, k AS ({_cost_sql('q', 'q', 'prev')} UNION ALL {_cost_sql('l_linenumber', 'l_linenumber', 'prevn')}) SELECT field, CASE WHEN b >= a AND c >= a AND e >= a THEN 'none' WHEN b <= c AND b <= e THEN 'copy' WHEN c <= e THEN 'increment' ELSE 'delta' END AS operator FROM k UNION ALL SELECT 'l_returnflag', CASE WHEN count(*) FILTER (l_returnflag = prevf) >= count(*) // 2 THEN 'copy' ELSE 'delta' END FROM x")
def choose_operator(spark, d):
    x = quantities(spark, d).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return A.operators(x, ["q", "l_linenumber", "l_returnflag"], *KEY)


@query(f"{PREV} SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CASE WHEN l_returnflag = prevf THEN NULL ELSE l_returnflag END AS encoded FROM x")
def enc_copy(spark, d):
    return E.encode_copy(quantities(spark, d), "l_returnflag", *KEY).select("l_orderkey", "l_linenumber", "encoded")


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS decoded FROM lineitem")
def dec_copy(spark, d):
    return E.decode_copy(E.encode_copy(quantities(spark, d), "l_returnflag", *KEY).drop("l_returnflag"), *KEY).select("l_orderkey", "l_linenumber", "decoded")


@query(f"{PREV} SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST(CASE WHEN l_linenumber = prevn + 1 THEN NULL ELSE l_linenumber END AS DOUBLE) AS encoded FROM x")
def enc_increment(spark, d):
    return E.encode_increment(quantities(spark, d), "l_linenumber", *KEY).select("l_orderkey", "l_linenumber", F.col("encoded").cast("double").alias("encoded"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS decoded FROM lineitem")
def dec_increment(spark, d):
    return E.decode_increment(E.encode_increment(quantities(spark, d), "l_linenumber", *KEY), *KEY).select("l_orderkey", "l_linenumber", F.col("decoded").cast("long").alias("decoded"))


def amounts(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.round(F.col("value").cast("decimal(18,2)") * 100).cast("long")).alias("cents"))


CENTS = "c AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) END AS cents FROM events)"


@query(f"WITH {CENTS} SELECT event_id, CAST(cents - coalesce(last_value(cents IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS encoded FROM c")
def enc_delta(spark, d):
    return E.encode_delta(amounts(spark, d), "cents", ["user_id"], ["event_id"]).select("event_id", F.col("encoded").cast("double").alias("encoded"))


@query(f"WITH {CENTS} SELECT event_id, CAST(cents AS DOUBLE) AS decoded FROM c")
def dec_delta(spark, d):
    return E.decode_delta(E.encode_delta(amounts(spark, d), "cents", ["user_id"], ["event_id"]).drop("cents"), ["user_id"], ["event_id"]).select("event_id", F.col("decoded").cast("double").alias("decoded"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS encoded, o_orderstatus AS decoded FROM orders")
def enc_default(spark, d):
    o = table(spark, d, "orders").withColumn("encoded", E.encode_default(F.col("o_orderstatus"), "O"))
    return o.select("o_orderkey", "encoded", E.decode_default(F.col("encoded"), "O").alias("decoded"))


@query("SELECT o_orderkey, CAST(NULL AS VARCHAR) AS encoded, '1.0' AS decoded FROM orders")
def enc_constant(spark, d):
    return table(spark, d, "orders").select("o_orderkey", E.encode_constant(F.lit("1.0")).alias("encoded"), E.decode_constant("1.0").alias("decoded"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def message_counts(spark, d):
    return A.message_counts(table(spark, d, "events"), "event_type")


@query(f"{PREV}, y AS (SELECT CAST(sum(length(CAST(q AS VARCHAR)) + 1) AS BIGINT) AS raw_bytes, CAST(sum({stop_bit_width_sql('q')}) AS BIGINT) AS out_bytes FROM x) SELECT raw_bytes, out_bytes, round(100.0 * (1 - CAST(out_bytes AS DOUBLE) / raw_bytes), 4) AS saved_percent FROM y")
def compression_ratio(spark, d):
    from ..functions.types import stop_bit_width

    got = quantities(spark, d).agg(F.sum(F.octet_length(F.col("q").cast("string")) + 1).alias("raw_bytes"), F.sum(stop_bit_width(F.col("q"))).alias("out_bytes"))
    return got.select("raw_bytes", "out_bytes", A.compression(F.col("raw_bytes"), F.col("out_bytes")).alias("saved_percent"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, round(coalesce(var_samp(value), 0), 4) AS variance, round(sqrt(coalesce(var_samp(value), 0)), 4) AS deviation FROM events GROUP BY 1")
def running_stddev(spark, d):
    got = A.deviation(table(spark, d, "events"), "value", "event_type")
    return got.select("event_type", "n", F.round("mean", 6).alias("mean"), "least", "greatest", F.round("variance", 4).alias("variance"), F.round("deviation", 4).alias("deviation"))


@query("SELECT event_id, round(exp(-(value - m) * (value - m) / (2 * v)) / sqrt(2 * pi() * v), 8) AS density FROM events JOIN (SELECT event_type, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1) USING (event_type)")
def normal_density(spark, d):
    e = table(spark, d, "events")
    return e.join(A.deviation(e, "value", "event_type"), "event_type").select("event_id", F.round(A.normal_density(F.col("value"), F.col("mean"), F.col("variance")), 8).alias("density"))


USER = (["user_id"], ["event_id"])
VALUES = "v AS (SELECT event_id, user_id, CAST(value AS DECIMAL(18,2)) AS v FROM events)"


def values(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,2)").alias("v"))


@query(f"WITH {VALUES} SELECT event_id, round(CAST(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) / 5, 6) AS mean FROM v")
def roller_mean(spark, d):
    v = values(spark, d)
    return v.select("event_id", F.round(R.moving_mean(F.col("v"), 5, *USER), 6).alias("mean"))


@query(f"WITH {VALUES} SELECT event_id, CAST(coalesce(lag(v, 5) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS DOUBLE) AS evicted FROM v")
def roller_evicted(spark, d):
    return values(spark, d).withColumn("v", F.col("v").cast("double")).select("event_id", R.evicted(F.col("v"), 5, *USER).alias("evicted"))


@query(f"WITH {VALUES} SELECT event_id, CAST(coalesce(lag(v, 2) OVER w, 0) AS DOUBLE) AS element, least(row_number() OVER w, 5) AS filled FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def roller_element_at(spark, d):
    v = values(spark, d).withColumn("v", F.col("v").cast("double"))
    return v.select("event_id", R.element_at(F.col("v"), 2, *USER).alias("element"), R.filled(5, *USER).alias("filled"))


def _bucket_sql(value: str, source: str, g: int, span: int, align: int, cast: str) -> str:
    return f"WITH {source}, r AS (SELECT event_id, user_id, row_number() OVER w AS rn, sum({value}) OVER (w ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW) AS s FROM {source.split()[0]} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT *, rn = {span} OR (rn > {span} AND rn >= {span + align} AND (rn - {span + align}) % {g} = 0) AS fresh FROM r) SELECT event_id, fresh, CAST(coalesce(last_value(CASE WHEN fresh THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {cast}) AS result FROM f"


@query(_bucket_sql("k", "i AS (SELECT event_id, user_id, event_id % 100 AS k FROM events)", 2, 6, 0, "BIGINT"))
def bucket_roller_long(spark, d):
    v = table(spark, d, "events").withColumn("k", F.col("event_id") % 100)
    return R.bucket_sum(v, "k", 2, 6, *USER).select("event_id", "fresh", F.col("result").cast("long").alias("result"))


@query(_bucket_sql("v", VALUES, 3, 6, 2, "DOUBLE"))
def bucket_roller_double(spark, d):
    return R.bucket_sum(values(spark, d), "v", 3, 6, *USER, alignment=2).select("event_id", "fresh", F.col("result").cast("double").alias("result"))


@query(f"SELECT p_partkey, {murmur2_sql('p_name')} AS hash FROM part")
def murmur2_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", murmur2(F.col("p_name")).alias("hash"))


BITS = 17  # over 80000 buckets, so that a field of too many values can be told from a key
BUCKETS = f"b AS (SELECT bucket, count(*) AS n FROM (SELECT {murmur2_sql('s')} & {(1 << BITS) - 1} AS bucket FROM (SELECT CAST(user_id AS VARCHAR) AS s FROM events)) GROUP BY 1)"


def buckets(spark, d):
    return A.bucket_counts(table(spark, d, "events"), "user_id", BITS)


@query(f"WITH {BUCKETS} SELECT bucket, n FROM b")
def bucket_frequency(spark, d):
    return buckets(spark, d)


@query(f"WITH {BUCKETS} SELECT count(*) AS distinct_estimate, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total FROM b")
def distinct_estimate(spark, d):
    return A.bucket_summary(buckets(spark, d))


@query(f"WITH {BUCKETS}, a AS (SELECT r.i, coalesce(n, 0) AS n FROM range({1 << BITS}) r(i) LEFT JOIN b ON b.bucket = r.i) SELECT bucket, n FROM b WHERE n > (SELECT quantile_disc(n, 0.86) FROM a)")
def heavy_buckets(spark, d):
    return A.heavy_buckets(buckets(spark, d), BITS)


@query(f"WITH {BUCKETS} SELECT count(*) AS distinct_estimate, CAST(sum(n) AS BIGINT) AS total, count(*) > 0 AND count(*) < 80000 AND CAST(sum(n) AS BIGINT) // count(*) > 10 AS repeating_key FROM b")
def repeating_key(spark, d):
    return A.could_be_key(buckets(spark, d))


@query()
def huffman_codes(spark, d):
    return huffman.code_table(table(spark, d, "events"), "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def new_members(spark, d):
    """Customers without an urgent order."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return M.new_members(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def overlap_check(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return M.overlap(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def set_difference(spark, d):
    a = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    return M.bit_difference(a, table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), "k")


@query(f"SELECT k, side, {murmur2_sql('name')} AS at FROM (SELECT *, concat_ws('|', CAST(k AS VARCHAR), side, '7') AS name FROM (SELECT n_nationkey AS k, 'a' AS side FROM nation UNION ALL SELECT r_regionkey, 'b' FROM region))")
def interleave(spark, d):
    a, b = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    return M.mixed(a, b, "k", 7)


@query("WITH x AS (SELECT DISTINCT o_custkey AS p, o_custkey // 32768 AS piece FROM orders) SELECT p AS position, p - coalesce(lag(p) OVER (PARTITION BY piece ORDER BY p), piece * 32768) AS gap FROM x")
def position_gaps(spark, d):
    return M.gaps(table(spark, d, "orders").select(F.col("o_custkey").alias("position")), "position").select("position", "gap")


@query()
def bloom_membership(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return M.found(o.select(F.col("o_custkey").alias("k")), "k", M.bitmap(c.select(F.col("c_custkey").alias("k")), "k"))


@query("SELECT CAST(sum(strlen(o_orderpriority) + 1) AS BIGINT) AS bytes FROM orders")
def raw_text_size(spark, d):
    return M.raw_size(table(spark, d, "orders"), "o_orderpriority")


@query()
def gzip_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", M.gzip_size(F.col("text").cast("binary")).alias("bytes"))


@query("SELECT doc_id, CAST(strlen(text) - len(regexp_extract_all(text, '[\\x30-\\x7F]')) AS BIGINT) AS breaks FROM documents")
def tokenize_punctuation(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_starts(F.col("text")).alias("breaks"))


@query("SELECT page_id, count(*) AS chunks, CAST(sum(least(1024, strlen(html) - 1024 * i)) AS BIGINT) AS bytes FROM (SELECT page_id, html, unnest(range(0, (strlen(html) + 1023) // 1024)) AS i FROM pages) GROUP BY 1")
def byte_chunks(spark, d):
    p = X.byte_chunks(table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("html")), "html", 1024)
    return p.groupBy("page_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("bytes")).cast("long").alias("bytes"))


@query("SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10))) FROM documents) GROUP BY 1")
def line_split_documents(spark, d):
    return X.split_lines(table(spark, d, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_message_counts(spark, d):
    schema = table(spark, d, "events").schema
    out, log = T.place(spark, "counts"), T.place(spark, "log")
    T.drain_counts(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet"), "event_type", out, log)
    return spark.read.parquet(out)
