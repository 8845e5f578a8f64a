"""A benchmark's tables in a local folder, one Parquet folder each: corpus, queries, qrels, top_ranked, excluded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, dataset: str = "") -> dict[str, DataFrame]:
    """labels, pools, excluded, corpus and queries, each with its dataset; an ability without a gain is a ValueError."""
    name = F.lit(dataset).alias("dataset")
    qrels = spark.read.parquet(f"{folder}/qrels")
    extra = [F.col(c).cast("double").alias(c) if c in qrels.columns else F.lit(None).cast("double").alias(c) for c in ("gain", "theta")]
    labels = qrels.select(name, F.col("`query-id`").cast("string").alias("query_id"), F.col("`corpus-id`").cast("string").alias("doc_id"), F.col("score").cast("double").alias("grade"), *extra)
    bad = labels.filter("theta IS NOT NULL AND gain IS NULL").head(1)
    if bad:
        raise ValueError(f"an ability without a gain: {bad[0].asDict()}")
    pools = spark.read.parquet(f"{folder}/top_ranked").select(name, F.col("`query-id`").cast("string").alias("query_id"), F.posexplode("`corpus-ids`").alias("pos", "doc_id"))
    out = spark.read.parquet(f"{folder}/excluded").select(name, F.col("`query-id`").cast("string").alias("query_id"), F.explode("`excluded-corpus-ids`").alias("doc_id"))
    return {"labels": labels, "pools": pools, "excluded": out, "corpus": spark.read.parquet(f"{folder}/corpus"), "queries": spark.read.parquet(f"{folder}/queries")}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """The same tables back; pools keep their order."""
    tables["corpus"].write.parquet(f"{folder}/corpus")
    tables["queries"].write.parquet(f"{folder}/queries")
    tables["labels"].select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("grade").alias("score"), "gain", "theta").write.parquet(f"{folder}/qrels")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"])
    tables["pools"].groupBy(F.col("query_id").alias("query-id")).agg(ordered.alias("corpus-ids")).write.parquet(f"{folder}/top_ranked")
    tables["excluded"].groupBy(F.col("query_id").alias("query-id")).agg(F.collect_set("doc_id").alias("excluded-corpus-ids")).write.parquet(f"{folder}/excluded")


def suite(parts: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Several data sets' labels, pools and exclusions as one, told apart by ``dataset``."""
    named = {t: [p[t].withColumn("dataset", F.lit(name)) for name, p in parts.items()] for t in ("labels", "pools", "excluded")}
    return {t: reduce(DataFrame.unionByName, frames) for t, frames in named.items()}
