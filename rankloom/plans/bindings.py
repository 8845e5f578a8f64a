"""The driver's tables in the roles of a retrieval evaluation, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Item parameters of five criteria: fixed values.
GAMMA = [1.169, 1.047, 0.940, 1.157, 0.687]
BETA = [-2.572, -2.002, -0.251, 0.709, 4.116]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, tied: bool = False) -> DataFrame:
    """System rankings: event types rank the numbers in their users' properties by the best value."""
    e = table(spark, sf_dir, "events").filter("NOT (event_type = 'click' AND user_id % 11 = 3)")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    rows = e.groupBy("event_type", "user_id", k.alias("k")).agg(F.max("value").alias("score"), F.min("event_id").alias("pos"))
    score = F.floor(F.col("score") / 25).cast("double") if tied else F.col("score")
    return rows.select(
        F.col("event_type").alias("system"), F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.col("user_id").cast("string").alias("query_id"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("doc_id"), score.alias("score"), "pos",
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, k, dataset, query_id, doc_id) of every user and number."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    rows = users.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    return rows.select(
        "u", "k", F.concat(F.lit("ds"), (F.col("u") % 3).cast("string")).alias("dataset"),
        F.col("u").cast("string").alias("query_id"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("doc_id"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded labels with abilities; a tenth of the queries has no positive one."""
    rows = grid(spark, sf_dir).filter("(u * 31 + k * 17) % 5 < 2")
    grade = F.when(F.col("u") % 10 == 7, F.lit(0)).otherwise((F.col("u") * 7 + F.col("k") * 3) % 4).cast("double")
    theta = ((F.col("u") * 13 + F.col("k") * 7) % 101 - 50) / F.lit(10.0)
    return rows.select("dataset", "query_id", "doc_id", F.col("k").alias("pos"), grade.alias("grade"), grade.alias("gain"), theta.alias("theta"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).filter("(u + k) % 3 <> 0").select("dataset", "query_id", "doc_id", ((F.col("k") * 37) % 100).alias("pos"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).filter("k % 29 = u % 29").select("dataset", "query_id", "doc_id")


def pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).select("u", "dataset", "query_id").distinct()
    return rows.select("dataset", "query_id", F.floor(F.col("u") / 6).cast("long").alias("group_id"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged windows, one row a placement: orders hold documents, quantity and part give what the judge saw."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    from pyspark.sql import Window

    doc = (F.col("l_partkey") % 40).alias("d")
    rows = lines.select(F.col("l_orderkey").alias("r"), doc, *order)
    first = F.row_number().over(Window.partitionBy("r", "d").orderBy(*order))
    rows = rows.withColumn("n", first).filter("n = 1").withColumn("position", F.row_number().over(Window.partitionBy("r").orderBy(*order)))
    s = F.col("l_quantity") + 3 * (F.col("d") % 20)
    return rows.withColumn("s", s.cast("double")).select(
        F.col("r").alias("record_id"), (F.col("r") % 50).cast("string").alias("query_id"), F.concat(F.lit("d"), F.col("d").cast("string")).alias("doc_id"),
        F.col("position").cast("long").alias("position"), (F.col("s") / 10).alias("score"),
        *[(F.col("s") >= x).cast("int").alias(f"c{i + 1}") for i, x in enumerate((20, 35, 50, 65, 80))],
        (F.col("r") % 17 != 0).alias("valid"), F.element_at(F.array(F.lit("random"), F.lit("stratified"), F.lit("adaptive")), (F.col("r") % 3 + 1).cast("int")).alias("phase"),
        F.concat(F.lit("cat"), (F.col("r") % 5).cast("string")).alias("category"), F.concat(F.lit("j"), (F.floor(F.col("r") / 50) % 2).cast("string")).alias("judge"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgement log: one line a record, keys that repeat, the time of recording."""
    heads = placements(spark, sf_dir).select("record_id", "query_id", "valid", "phase", "judge").distinct()
    times = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("recorded_at"))
    return heads.join(times, "record_id").withColumn("key", F.col("record_id") % 1000)


_USERS = "SELECT DISTINCT user_id AS u FROM events"

CTE = {
    "run": """run AS (
  SELECT event_type AS system, 'ds' || (user_id % 3) AS dataset, user_id::VARCHAR AS query_id, 'd' || k AS doc_id, max(value) AS score, min(event_id) AS pos
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events WHERE NOT (event_type = 'click' AND user_id % 11 = 3))
  GROUP BY event_type, user_id, k)""",
    "run_tied": """run AS (
  SELECT event_type AS system, 'ds' || (user_id % 3) AS dataset, user_id::VARCHAR AS query_id, 'd' || k AS doc_id, floor(max(value) / 25)::DOUBLE AS score, min(event_id) AS pos
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events WHERE NOT (event_type = 'click' AND user_id % 11 = 3))
  GROUP BY event_type, user_id, k)""",
    "grid": f"""grid AS (SELECT u, k, 'ds' || (u % 3) AS dataset, u::VARCHAR AS query_id, 'd' || k AS doc_id FROM ({_USERS}), (SELECT unnest(range(100)) AS k))""",
    "qrels": """qrels AS (
  SELECT dataset, query_id, doc_id, k AS pos, CASE WHEN u % 10 = 7 THEN 0 ELSE (u * 7 + k * 3) % 4 END::DOUBLE AS grade,
    CASE WHEN u % 10 = 7 THEN 0 ELSE (u * 7 + k * 3) % 4 END::DOUBLE AS gain, ((u * 13 + k * 7) % 101 - 50) / 10.0::DOUBLE AS theta
  FROM grid WHERE (u * 31 + k * 17) % 5 < 2)""",
    "pools": "pools AS (SELECT dataset, query_id, doc_id, (k * 37) % 100 AS pos FROM grid WHERE (u + k) % 3 <> 0)",
    "excluded": "excluded AS (SELECT dataset, query_id, doc_id FROM grid WHERE k % 29 = u % 29)",
    "pair_groups": "pair_groups AS (SELECT DISTINCT dataset, query_id, u // 6 AS group_id FROM grid)",
    "placements": """placements AS (
  SELECT r AS record_id, (r % 50)::VARCHAR AS query_id, 'd' || d AS doc_id, row_number() OVER (PARTITION BY r ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS position,
    s / 10 AS score, (s >= 20)::INT AS c1, (s >= 35)::INT AS c2, (s >= 50)::INT AS c3, (s >= 65)::INT AS c4, (s >= 80)::INT AS c5,
    r % 17 <> 0 AS valid, ['random', 'stratified', 'adaptive'][1 + r % 3] AS phase, 'cat' || (r % 5) AS category, 'j' || (r // 50 % 2) AS judge
  FROM (SELECT l_orderkey AS r, l_partkey % 40 AS d, (l_quantity + 3 * (l_partkey % 40 % 20))::DOUBLE AS s, *,
      row_number() OVER (PARTITION BY l_orderkey, l_partkey % 40 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem)
  WHERE n = 1)""",
    "log": """log AS (
  SELECT h.*, o_orderdate AS recorded_at, record_id % 1000 AS key
  FROM (SELECT DISTINCT record_id, query_id, valid, phase, judge FROM placements) h JOIN orders ON o_orderkey = record_id)""",
}


def sql(names: str, body: str) -> str:
    """``body`` over the named bindings."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
