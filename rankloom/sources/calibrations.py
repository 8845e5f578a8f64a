"""Calibrations on disk: tables of a version first, the line that makes it the current one last."""

from __future__ import annotations

import json
import math
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.calibrate import Calibration, settings
from rankloom.operators.joint import Priors

TABLES = {"thetas": "query_id string, doc_id string, theta double, se double, source string", "queries": "query_id string, tau double, alpha double"}
MANIFEST = "version long, name string, payload string, written timestamp"


def _print(table: DataFrame) -> dict:
    """Rows and an order-free digest of a table: what a read is held against. Equal rows are told apart by nothing, so they may not repeat."""
    row = table.agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(table.columns)}))").alias("x"), F.expr(f"sum(cast(hash({', '.join(table.columns)}) as long))").alias("s")).first()
    return {"rows": row.n, "xor": row.x or 0, "sum": row.s or 0}


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _current(spark: SparkSession, folder: str):
    try:
        rows = _versions(spark, folder).orderBy(F.desc("version"), F.desc("written"), F.desc("name")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return rows[0] if rows else None


def save(calibration: Calibration, folder: str) -> int:
    """Writes a new version to ``folder``, any place that all machines reach; returns its number.

    The tables go to a folder of their own, are read back for their digests, and one line appended to the manifest then
    makes the version current. A job that dies before leaves the last version as it was, and files that nothing names.
    Numbers that are not finite are refused before anything is written. Of two writers at once the later line stands.
    """
    spark = calibration.thetas.sparkSession
    payload = settings(calibration)
    json.dumps(payload, allow_nan=False)
    last = _current(spark, folder)
    name = uuid.uuid4().hex
    prints = {}
    for table, kind in TABLES.items():
        rows = getattr(calibration, table)
        rows = spark.createDataFrame([], kind) if rows is None else rows.select(*[c.split()[0] for c in kind.split(", ")])
        rows.write.parquet(f"{folder}/versions/{name}/{table}")
        prints[table] = _print(spark.read.schema(kind).parquet(f"{folder}/versions/{name}/{table}"))
    version = last.version + 1 if last else 1
    line = [(version, name, json.dumps(payload | {"tables": prints}, allow_nan=False), datetime.now(timezone.utc))]
    spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None, check: bool = True) -> Calibration:
    """The current version, or the numbered one. With ``check`` tables that differ from what was written are refused."""
    row = _current(spark, folder)
    if row and version is not None:
        rows = _versions(spark, folder).filter(F.col("version") == version).orderBy(F.desc("written"), F.desc("name")).limit(1).collect()
        row = rows[0] if rows else None
    if row is None:
        raise FileNotFoundError(f"{folder} holds no calibration" + (f" of version {version}" if version is not None else ""))
    p = json.loads(row.payload)
    tables = {t: spark.read.schema(kind).parquet(f"{folder}/versions/{row.name}/{t}") for t, kind in TABLES.items()}
    if check:
        for t, table in tables.items():
            if (got := _print(table)) != p["tables"][t]:
                raise ValueError(f"{folder}: {t} of version {row.version} is not what was written: {got}, not {p['tables'][t]}")
    if not all(math.isfinite(x) for x in (*p["gamma"], *p["beta"])) or len(p["gamma"]) != len(p["criteria"]):
        raise ValueError(f"{folder}: the items of version {row.version} are none")
    return Calibration(
        p["mode"], p["criteria"], p["gamma"], p["beta"], p["severity"], tables["thetas"], tables["queries"] if p["mode"] == "tournament" else None, Priors(**p["priors"]),
        tuple(p["prior"]) if p["prior"] else None, p["identity"], [tuple(w) for w in p["warnings"]], p["diagnostics"],
    )
