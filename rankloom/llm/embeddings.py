"""Near-duplicate vectors by randomly rotated binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.components import components

#: Chance that a pair at the threshold meets in no table; standard deviations of the estimate that a bound allows.
MISS, SIGMAS, SEED = 0.01, 3.0, 5
#: Vectors of a bucket that one unit of work takes; larger buckets are split into pairs of blocks.
BLOCK = 2048

_CODED = "vec_id long, code binary, coarse binary, factor double, step double, keys array<long>"


@lru_cache(maxsize=64)
def rotation(dim: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, k)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket's key and the number of tables: about 32 unrelated vectors a bucket, and MISS at the threshold."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / 32 + 1)))
    agree = 1 - math.acos(min(threshold, 1.0)) / math.pi
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree**bits)))


def _code(bits: int, tables: int):
    """Unit vectors to codes: signs after the first rotation, the factor <vector, code>, the vector itself in 8 bits."""

    def coded(x: np.ndarray) -> tuple:
        dim = x.shape[1]
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        turned = x @ rotation(dim, 0)
        code = np.packbits(turned >= 0, axis=1)
        factor = np.abs(turned).sum(1) / math.sqrt(dim)
        step = np.maximum(np.abs(turned).max(1), 1e-12) / 127
        # rounding at random keeps the estimate unbiased
        noise = np.random.default_rng((SEED, dim)).random(turned.shape[1])
        coarse = np.floor(turned / step[:, None] + noise).clip(-128, 127).astype(np.int8)
        signs = np.hstack([x @ rotation(dim, 1 + k) >= 0 for k in range(-(-bits * tables // dim))])
        weight = 1 << np.arange(bits, dtype=np.int64)
        keys = [(t << 48) | (signs[:, t * bits : (t + 1) * bits] @ weight) ^ (dim << 32) for t in range(tables)]
        return code, coarse, factor, step, np.stack(keys, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            ids = batch.column(0).to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                x = flat[(starts[mine][:, None] + np.arange(dim))].astype(np.float64)
                code, coarse, factor, step, keys = coded(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[mine]), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([c.tobytes() for c in coarse], pa.binary()),
                     pa.array(factor), pa.array(step), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.reshape(-1)))],
                    names=["vec_id", "code", "coarse", "factor", "step", "keys"],
                )

    return run


def _units(table: pa.Table):
    """The rows of each unit of work, and whether each stands on its first side (pairs within one block: both)."""
    key, i, j = (table[c].to_numpy() for c in ("key", "i", "j"))
    side = table["side"].to_numpy()
    order = np.lexsort((side, j, i, key))
    k, a, b = key[order], i[order], j[order]
    edges = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if y - x > 1:
            yield order[x:y], a[x] == b[x]


_HOPEFUL = "key long, i int, j int, side int, vec_id long"


def _hopeful(threshold: float):
    """Vectors with a partner in their bucket whose estimated inner product may reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        factor, step = table["factor"].to_numpy(), table["step"].to_numpy()
        code, coarse = table["code"].to_pylist(), table["coarse"].to_pylist()
        keep = np.zeros(table.num_rows, bool)
        for rows, within in _units(table):
            dim = len(coarse[rows[0]])
            signs = np.unpackbits(np.frombuffer(b"".join(code[r] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :dim].astype(np.float32) * 2 - 1
            q = np.frombuffer(b"".join(coarse[r] for r in rows), np.int8).reshape(len(rows), dim).astype(np.float32)
            f, s = factor[rows], step[rows]
            # <q, o> is estimated by <q, code of o> / <o, code of o>; the bound follows from the factor
            estimate = (q @ signs.T) * s[:, None] / math.sqrt(dim) / f[None, :]
            bound = SIGMAS * np.sqrt(np.maximum(1 - f * f, 0)) / f / math.sqrt(max(dim - 1, 1)) + s.max() * 2 / math.sqrt(dim)
            pair = (estimate + estimate.T) / 2 + np.maximum(bound[None, :], bound[:, None]) >= threshold
            np.fill_diagonal(pair, False)
            if not within:
                mine = side[rows]
                pair &= mine[:, None] != mine[None, :]
            keep[rows] |= pair.any(1)
        return table.select(["key", "i", "j", "side", "vec_id"]).filter(pa.array(keep))

    return run


_FOUND = "vec_id long, n long, low long"


def _exact(threshold: float):
    """Links of a unit, each pair in the first table where it meets: (vector, partners, smallest vector reached here)."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, weight = (table[c].to_numpy() for c in ("side", "vec_id", "weight"))
        vectors, keys, key = table["embedding"].to_pylist(), table["keys"].to_pylist(), table["key"].to_numpy()
        out: list[tuple] = []
        for rows, within in _units(table):
            x = np.array([vectors[r] for r in rows], np.float64)
            norm = np.linalg.norm(x, axis=1)
            link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
            np.fill_diagonal(link, False)
            if not within:
                mine = side[rows]
                link &= mine[:, None] != mine[None, :]
            a, b = np.nonzero(link)
            if not len(a):
                continue
            all_keys = np.array([keys[r] for r in rows])
            first = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 18):
                p, q = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                first[at : at + (1 << 18)] = all_keys[p, (all_keys[p] == all_keys[q]).argmax(1)] == key[rows[0]]
            n = np.bincount(a[first], weight[rows][b[first]], len(rows)).astype(np.int64)
            low = ids[rows].copy()
            while True:
                new = low.copy()
                np.minimum.at(new, a, low[b])
                if (new == low).all():
                    break
                low = new
            some = np.unique(a)
            out.append((ids[rows][some], n[some], low[some]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "n", "low"])

    return run


def _in_units(rows: DataFrame, sizes: DataFrame, chunks: int) -> DataFrame:
    """Rows of buckets of two or more, once for each unit of work they take part in."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    rows = rows.join(sizes.filter("n > 1"), "key").withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.withColumn("side", (F.col("own") == F.col("j")).cast("int"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("key", "i", "j"), F.lit(chunks)).cast("int"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    Links are pairs of cosine ``threshold`` or more, computed in double precision. Equal vectors fold into one first and
    are counted by number. Candidates meet in a bucket of one of several tables of sign bits after random rotations;
    bits and tables follow the number of vectors, so that a pair at the threshold is missed with chance MISS. A bucket
    holds codes, not vectors: the estimate and its bound drop most pairs, and only vectors with a pair left are
    fetched for the exact cosine. Buckets above BLOCK vectors are split into pairs of blocks.

    Null and zero vectors, those with null or non-finite components, and those without vec_id link with nothing. Vectors of different
    lengths do not link. Rows that repeat a vec_id and vector count as vectors of their own; an empty table gives an
    empty result. Other columns than vec_id and embedding are not looked at and left out.
    """
    rows = vectors.select("vec_id", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & (norm > 0) & (norm < float("inf")), F.lit(False))
    folded = common.cut(rows.filter(good).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")))
    n = folded.count()
    bits, tables = plan(n, threshold)
    chunks = common.parts(folded)
    coded = common.cut(folded.select("vec_id", "embedding").mapInArrow(_code(bits, tables), _CODED))
    keyed = coded.withColumn("key", F.explode("keys"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    units = _in_units(keyed.select("vec_id", "code", "coarse", "factor", "step", "key"), sizes, chunks)
    hopeful = units.groupBy("chunk").applyInArrow(_hopeful(threshold), _HOPEFUL)
    exact = hopeful.join(folded, "vec_id").join(coded.select("vec_id", "keys"), "vec_id")
    exact = exact.withColumn("chunk", F.pmod(F.xxhash64("key", "i", "j"), F.lit(chunks)).cast("int"))
    found = common.cut(exact.groupBy("chunk").applyInArrow(_exact(threshold), _FOUND))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    reach = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    per = folded.join(counts, "vec_id", "left").join(reach.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per = per.select(
        "embedding",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    linked = rows.filter(good).join(per, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
