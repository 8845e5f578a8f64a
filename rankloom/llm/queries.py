"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import audio, bpe, embeddings, fm_dedup, mixing, pieces, pitman_yor, quality, runs, simhash, suffix_dedup, urls, variants
from rankloom.llm.common import read


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audio.features(audio.encode(read(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "n_frames", F.size("spans").cast("long").alias("n_segments"), "tensors",
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(read(spark, sf_dir, "documents"), want=("size", "n_removed", "n_spans", "kept"))
    return rows.select("doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, read(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fm_dedup.dedup(read(spark, sf_dir, "documents"), want=("size", "n_removed", "kept"))
    return rows.select("doc_id", F.col("size").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(spark, read(spark, sf_dir, "documents"), verify=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "round_trip",
    )


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.collapse(read(spark, sf_dir, "documents"), repeat=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    rows = rows.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("r.start")).alias("start"), F.col("r.length"), (-F.col("r.period")).alias("period"),
        F.expr("1000 * r.length div -r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(spark, read(spark, sf_dir, "documents"), packed=True)
    rows = bpe.decode(spark, ids, carry=("ids",), packed=True)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_audio, op2_suffix_dedup, op3_mixing, op4_simhash, op5_urls, op6_quality, op7_fm_dedup, op8_embeddings, op9_pieces, op10_pitman_yor,
        op11_variants, op12_runs, op13_bpe,
    )
}

ORACLE_SQL = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0) AS used,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM s WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(lim, max((budget - used) / rest) OVER () * weight) AS target FROM f
), p AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS place,
    ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(u + place * rate) - floor(u + (place - 1) * rate))::BIGINT * size)::BIGINT AS taken FROM p
""",
    "op5_urls": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
""",
}
