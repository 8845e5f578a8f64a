"""Rankings and corpora in files: TREC, BEIR, JSON lines, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import KEYS, metric_order
from rankloom.operators.validate import check_rankings, grades

#: Other names of the columns: fixed values.
ALIASES = {
    "system": ("system", "model", "run", "tag"),
    "dataset": ("dataset", "task", "subset"),
    "query_id": ("query_id", "query-id", "qid"),
    "doc_id": ("doc_id", "corpus-id", "corpus_id", "docno"),
    "score": ("score", "sim"),
}


def named(rows: DataFrame, dataset: str | None = None) -> DataFrame:
    """Rows under the canonical names, ids as strings, the score a double; ``dataset`` where no column names one."""
    have = set(rows.columns)
    picked = []
    for name, others in ALIASES.items():
        hit = next((o for o in others if o in have), None)
        if hit is None and name == "dataset":
            picked.append(F.lit(dataset or "").alias("dataset"))
        elif hit is None:
            raise ValueError(f"no column for {name}; there are {sorted(have)}")
        else:
            picked.append(F.col(f"`{hit}`").cast("double" if name == "score" else "string").alias(name))
    pos = F.col("pos").cast("long") if "pos" in have else F.monotonically_increasing_id()
    return rows.select(*picked, pos.alias("pos"))


def read_trec(spark: SparkSession, path: str, dataset: str = "") -> DataFrame:
    """A TREC run: six fields a line, the last the system; a line of another arity is a ValueError."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), r"\s+"))
    bad = lines.filter(F.size("f") != 6).head(1)
    if bad:
        raise ValueError(f"not six fields: {bad[0]['value']!r}")
    f = F.col("f")
    return lines.select(f[5].alias("system"), F.lit(dataset).alias("dataset"), f[0].alias("query_id"), f[2].alias("doc_id"), f[4].cast("double").alias("score"), f[3].cast("long").alias("pos"))


def write_trec(run: DataFrame, path: str) -> None:
    rows = run.withColumn("rank", F.row_number().over(metric_order()))
    rows.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", "rank", "score", "system").alias("value")).write.text(path)


def _refused(row: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.substring(row, 1, 200)))


def read_json(spark: SparkSession, path: str, dataset: str = "") -> DataFrame:
    """JSON lines of rankings, in any of four shapes: one document's score; a map of scores; lists of documents and of scores; documents, best first.

    A row names its query as query_id or id, and its list as doc_ids or ranking. Refused, with the line: what is no JSON
    object, has no query, has neither scores nor documents, a document without its score, lists of different lengths.
    ``pos`` is a document's place in its row; rows of one document each have none of their own and stand by score alone.
    """
    kinds = "system string, dataset string, query_id string, id string, doc_id string, score double, scores string, doc_ids array<string>, ranking array<string>, broken string"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", kinds, {"columnNameOfCorruptRecord": "broken"}).alias("r")).select("value", "r.*")
    rows = rows.withColumn("order", F.coalesce("doc_ids", "ranking")).withColumn("query_id", F.coalesce("query_id", "id"))
    as_map, as_list = F.from_json("scores", "map<string,double>"), F.from_json("scores", "array<double>")
    mapped, listed = F.col("scores").startswith("{"), F.col("scores").startswith("[")
    of_map = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("d"), e["value"].alias("s")))
    n = F.size("order")
    of_order = F.transform("order", lambda d, i: F.struct(d.alias("d"), F.when(listed, F.get(as_list, i)).otherwise((n - i).cast("double")).alias("s")))
    entries = (
        F.when(F.col("broken").isNotNull(), _refused(F.col("value"), "not a JSON object"))
        .when(F.col("query_id").isNull(), _refused(F.col("value"), "a row without a query_id"))
        .when(F.col("doc_id").isNotNull() & F.col("score").isNull(), _refused(F.col("value"), "a document without its score"))
        .when(F.col("doc_id").isNotNull(), F.array(F.struct(F.col("doc_id").alias("d"), F.col("score").alias("s"))))
        .when(mapped, of_map)
        .when(F.col("order").isNotNull() & listed & (F.size(as_list) != n), _refused(F.col("value"), "scores and documents differ in length"))
        .when(F.col("order").isNotNull(), of_order)
        .otherwise(_refused(F.col("value"), "a row without scores or documents"))
    )
    out = rows.select("system", F.coalesce("dataset", F.lit(dataset)).alias("dataset"), "query_id", F.posexplode(entries).alias("pos", "e"))
    return out.select(*KEYS, F.col("e.d").alias("doc_id"), F.col("e.s").alias("score"), F.col("pos").cast("long").alias("pos"))


def read_json_map(spark: SparkSession, path: str, system: str, dataset: str = "") -> DataFrame:
    """One JSON object of all queries: of each a map of scores, or its documents, best first. The file is one row, so one machine's."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "v"))
    listed = F.from_json("v", "array<string>")
    of_list = F.transform(listed, lambda d, i: F.struct(d.alias("key"), (F.size(listed) - i).cast("double").alias("value")))
    entries = (
        F.when(F.col("v").startswith("["), of_list).when(F.col("v").startswith("{"), F.map_entries(F.from_json("v", "map<string,double>")))
        .otherwise(_refused(F.col("query_id"), "neither scores nor documents for query"))
    )
    out = rows.select(F.lit(system).alias("system"), F.lit(dataset).alias("dataset"), "query_id", F.posexplode(entries).alias("pos", "e"))
    return out.select(*KEYS, F.col("e.key").alias("doc_id"), F.col("e.value").alias("score"), F.col("pos").cast("long").alias("pos"))


def _strict(spark: SparkSession, path: str, fields: dict[str, str], needed: tuple[str, ...]) -> DataFrame:
    """JSON lines whose keys are ``fields`` and no others, the needed ones there and not null; anything else is refused with its line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kinds = ", ".join(f"`{k}` {v}" for k, v in fields.items())
    r = F.from_json("value", f"{kinds}, broken string", {"columnNameOfCorruptRecord": "broken"})
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    rows = lines.select("value", r.alias("r"), keys.alias("keys"))
    odd = F.array_except("keys", F.array(*[F.lit(k) for k in fields]))
    lacks = F.filter(F.array(*[F.when(F.col(f"r.`{k}`").isNull(), F.lit(k)) for k in needed]), lambda x: x.isNotNull())
    sound = (
        F.when(F.col("r.broken").isNotNull() | (F.size("keys") == 0), _refused(F.col("value"), f"{path}: not a record"))
        .when(F.size(odd) > 0, _refused(F.concat(F.array_join(odd, ", "), F.lit(" in "), F.col("value")), f"{path}: unknown keys"))
        .when(F.size(lacks) > 0, _refused(F.concat(F.array_join(lacks, ", "), F.lit(" in "), F.col("value")), f"{path}: nothing for"))
        .otherwise(F.lit(True))
    )
    return rows.filter(sound).select("r.*").drop("broken")


def read_corpus(spark: SparkSession, folder: str, qrels: bool = True) -> dict[str, DataFrame]:
    """corpus, queries and qrels of a folder of JSON lines, read strictly: a key that is none of a record's is refused, not dropped.

    corpus.jsonl has doc_id and text; queries.jsonl query_id, query and perhaps an instruction; qrels.jsonl query_id and a
    map of grades, which must be finite numbers. A document or query given twice is refused.
    """
    tables = {
        "corpus": _strict(spark, f"{folder}/corpus.jsonl", {"doc_id": "string", "text": "string"}, ("doc_id", "text")),
        "queries": _strict(spark, f"{folder}/queries.jsonl", {"query_id": "string", "query": "string", "instruction": "string"}, ("query_id", "query")).withColumnRenamed("query", "text"),
    }
    for name, key in (("corpus", "doc_id"), ("queries", "query_id")):
        if twice := tables[name].groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(key).limit(5).collect():
            raise ValueError(f"{folder}: given more than once: {[r[0] for r in twice]}")
    if qrels:
        rows = _strict(spark, f"{folder}/qrels.jsonl", {"query_id": "string", "qrels": "map<string,string>"}, ("query_id", "qrels"))
        tables["qrels"] = grades(rows.select("query_id", F.explode("qrels").alias("doc_id", "score"))).select("query_id", "doc_id", "grade")
    return tables


def read_rankings(spark: SparkSession, path: str, dataset: str = "", kind: str | None = None) -> DataFrame:
    """Rankings by the path's suffix, or by ``kind``: parquet, csv, tsv, trec, jsonl; checked."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("trec", "run", "txt"):
        rows = read_trec(spark, path, dataset)
    elif kind in ("jsonl", "json"):
        rows = read_json(spark, path, dataset)
    elif kind in ("csv", "tsv"):
        rows = named(spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True), dataset)
    elif kind == "parquet":
        rows = named(spark.read.parquet(path), dataset)
    else:
        raise ValueError(f"no reader for {kind!r}")
    return check_rankings(rows)


def read_beir(spark: SparkSession, folder: str, split: str = "test", suffix: str = "") -> dict[str, DataFrame]:
    """corpus, queries and qrels of a BEIR folder; a missing text reads as empty, ``suffix`` may be ``.gz``."""
    ident = F.coalesce("_id", "id", "doc_id").alias("id")
    kinds = "_id string, id string, doc_id string, title string, text string"
    corpus = spark.read.schema(kinds).json(f"{folder}/corpus.jsonl{suffix}").select(ident.alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    queries = spark.read.schema(kinds).json(f"{folder}/queries.jsonl{suffix}").select(ident.alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    qrels = spark.read.schema("query_id string, doc_id string, score string").csv(f"{folder}/qrels/{split}.tsv{suffix}", sep="\t")
    header = (F.col("query_id") == "query-id") & (F.col("doc_id") == "corpus-id")
    qrels = grades(qrels.filter(~header)).select("query_id", "doc_id", "grade")
    return {"corpus": corpus, "queries": queries, "qrels": qrels}


def write_beir(tables: dict[str, DataFrame], folder: str, split: str = "test") -> None:
    """The three tables as a BEIR folder; grades must be whole numbers."""
    odd = tables["qrels"].filter("grade <> floor(grade)").head(1)
    if odd:
        raise ValueError(f"grade is not whole: {odd[0].asDict()}")
    tables["corpus"].select(F.col("doc_id").alias("_id"), "title", "text").write.json(f"{folder}/corpus.jsonl")
    tables["queries"].select(F.col("query_id").alias("_id"), "text").write.json(f"{folder}/queries.jsonl")
    tables["qrels"].select("query_id", "doc_id", F.col("grade").cast("int")).write.csv(f"{folder}/qrels/{split}.tsv", sep="\t")


def flatten_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """corpus, queries and qrels of nested rows (query_id, query, doc_ids, docs, qrels map)."""
    pairs = rows.select("query_id", F.posexplode(F.arrays_zip("doc_ids", "docs")).alias("pos", "d"))
    return {
        "corpus": pairs.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.docs").alias("text")).dropDuplicates(["doc_id"]),
        "queries": rows.select("query_id", F.col("query").alias("text")),
        "qrels": rows.select("query_id", F.explode("qrels").alias("doc_id", "grade")),
    }


def record_id(columns: list[str]):
    """A row's identity: the digest of its named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


#: Documents a query keeps in a predictions file: fixed value.
MOST = 1000


def write_rankings(run: DataFrame, path: str, kind: str | None = None) -> None:
    """Rankings by the path's suffix, or by ``kind``: parquet, csv, tsv, jsonl (one row a query, a map of scores), trec."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    rows = run.select(*KEYS, "doc_id", "score")
    if kind in ("trec", "run", "txt"):
        write_trec(run, path)
    elif kind == "parquet":
        rows.write.parquet(path)
    elif kind in ("csv", "tsv"):
        rows.write.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    elif kind in ("jsonl", "json"):
        rows.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "score"))).alias("scores")).write.json(path)
    else:
        raise ValueError(f"no writer for {kind!r}")


def predictions(run: DataFrame, labels: DataFrame, split: str = "test") -> DataFrame:
    """(dataset, split, query_id, scores): labelled queries alone, each with its first MOST documents, ties by doc_id descending.

    A labelled query that the run does not rank is a ValueError; ranked queries without labels are left out.
    """
    asked = labels.select("dataset", "query_id").distinct()
    lost = asked.join(run, ["dataset", "query_id"], "left_anti").head(1)
    if lost:
        raise ValueError(f"not ranked: {lost[0].asDict()}")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), F.col("doc_id").desc()))
    rows = run.join(asked, ["dataset", "query_id"], "left_semi").withColumn("place", place).filter(F.col("place") <= MOST)
    scores = F.map_from_entries(F.collect_list(F.struct("doc_id", "score")))
    return rows.groupBy("dataset", "query_id").agg(scores.alias("scores")).select("dataset", F.lit(split).alias("split"), "query_id", "scores")


def write_predictions(rows: DataFrame, path: str) -> None:
    """Predictions as JSON lines by data set and split; a folder that is there keeps its other splits."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "split").json(path)


def write_rows(tables: dict[str, DataFrame], path: str) -> None:
    """corpus, queries and qrels as JSON lines, one nested row a query, as ``flatten_rows`` reads them."""
    docs = tables["qrels"].join(tables["corpus"].select("doc_id", "text"), "doc_id")
    rows = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "grade"))).alias("d"))
    rows = rows.select("query_id", F.col("d.doc_id").alias("doc_ids"), F.col("d.text").alias("docs"), F.map_from_arrays("d.doc_id", "d.grade").alias("qrels"))
    rows.join(tables["queries"].select("query_id", F.col("text").alias("query")), "query_id").write.json(path)


def read_rows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested rows of ``write_rows`` as tables."""
    return flatten_rows(spark.read.schema("query_id string, query string, doc_ids array<string>, docs array<string>, qrels map<string,double>").json(path))


def write_records(rows: DataFrame, path: str, kind: str) -> None:
    """Result records appended as jsonl or parquet, or computed and dropped (null)."""
    if kind not in ("jsonl", "parquet", "null"):
        raise ValueError(f"no sink {kind!r}")
    if kind == "null":
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.write.mode("append").format("json" if kind == "jsonl" else kind).save(path)
