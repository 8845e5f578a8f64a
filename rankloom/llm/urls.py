"""URL filters: host and path rules held in a cascade of Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common

#: The rules of the production query: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: A cascade that needs more bits than this is refused rather than broadcast.
MAX_BITS = 1 << 30


def split_url(url):
    """Columns host and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), common.UPPER, common.LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host.alias("host"), path.alias("path")


class Level:
    """One Bloom filter: ``bits`` bits, ``hashes`` positions a key, salted by its level."""

    def __init__(self, keys: np.ndarray, bits: int, hashes: int, salt: int):
        self.bits, self.hashes, self.salt = bits, hashes, np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        words = np.zeros(bits // 64, np.uint64)
        for at in self._places(keys):
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.words = words

    def _places(self, keys: np.ndarray):
        h = common.mix(keys ^ self.salt)
        step = common.mix(h) | np.uint64(1)
        for _ in range(self.hashes):
            yield h % np.uint64(self.bits)
            h = h + step

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def holds(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe: the first level that does not hold a key decides."""
    out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for depth, level in enumerate(levels):
        hit = level.holds(keys[open_])
        out[open_[~hit]] = depth % 2 == 1  # left at a level of false positives: a listed key
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def _bits(n: int, rate: float) -> tuple[int, int]:
    hashes = max(1, round(-np.log2(rate)))
    return max(64, int(-(-n * hashes * 1.45 // 64)) * 64), hashes


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell ``listed(key)`` from the rest of ``universe(key)`` without error; keys are 64-bit hashes.

    Level 1 holds the listed keys, at a rate of false positives of about the listed share of the universe, so that
    about as many false positives are left as keys are listed; level 2 holds those, level 3 the listed keys that
    level 2 wrongly holds, and so on until a level errs nowhere. The false positives are found by a scan of the
    distributed universe; what reaches the driver is in proportion to the listed keys, and refused beyond MAX_BITS.
    """
    size = listed.agg(F.count("*")).first()[0]
    if not size:
        return []
    total = universe.agg(F.count("*")).first()[0]
    bits, hashes = _bits(size, min(0.5, size / max(total, 1)))
    if bits > MAX_BITS:
        raise ValueError(f"{size} listed keys need {bits} bits; the limit is {MAX_BITS}")
    keys = np.array([r[0] for r in listed.toLocalIterator()], np.int64).view(np.uint64)
    levels = [Level(keys, bits, hashes, 1)]

    def false(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[levels[0].holds(b["key"].to_numpy(np.int64).view(np.uint64))]

    wrong = universe.join(F.broadcast(listed), "key", "left_anti").mapInPandas(false, "key long")
    inside, outside = keys, np.array([r[0] for r in wrong.toLocalIterator()], np.int64).view(np.uint64)
    while len(outside):
        level = Level(outside, *_bits(len(outside), 0.5), len(levels) + 1)
        levels.append(level)
        inside, outside = outside, inside[level.holds(inside)]
    return levels


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits each url, else ``default``.

    A rule (host, path prefix, verdict) fits its host and every subdomain if the url's path starts with its path. The
    keys of a page are all suffixes of its host at dots, each with the path's prefixes of the rules' lengths; the keys
    of all pages are the universe of a Bloom cascade over the rules. A key that the cascade holds is a rule, by its
    text, so the pages need no join. Null urls and urls without ``://`` have empty host and path and fit no rule; ties
    cannot occur, as keys of one page differ; repeated rows are judged each. A url of any length is judged by its own
    keys; no pages give no rows; other columns than page_id and url are not looked at and left out.
    """
    lengths = sorted({len(p) for _, p, _ in rules})
    verdicts = {h + p: v for h, p, v in rules}
    split = pages.select("page_id", F.col("url").alias("u")).select("page_id", *split_url(F.col("u")))
    labels = F.split("host", r"\.")
    hosts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    keyed = split.withColumn(
        "keys",
        F.flatten(F.transform(hosts, lambda h: F.transform(F.array_compact(starts), lambda p: F.concat(h, p)))),
    )
    universe = keyed.select(F.explode("keys").alias("k")).select(F.xxhash64("k").alias("key")).distinct()
    listed = spark.createDataFrame([(k,) for k in verdicts], "k string").select(F.xxhash64("k").alias("key"))
    levels = cascade(listed, universe)

    @F.pandas_udf("array<boolean>")
    def member(keys: pd.Series) -> pd.Series:
        counts = keys.map(len).to_numpy(np.int64)
        flat = np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
        return pd.Series(np.split(holds(levels, flat), np.cumsum(counts)[:-1]), dtype=object)

    hit = keyed.withColumn("in", member(F.transform("keys", lambda k: F.xxhash64(k))))
    fits = F.filter(F.zip_with("keys", "in", lambda k, i: F.when(i, k)), lambda k: k.isNotNull())
    best = F.aggregate(fits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    verdict = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv]), F.col("rule")), F.lit(default)) if verdicts else F.lit(default)
    return hit.select("page_id", "host", "path", best.alias("rule")).withColumn("verdict", verdict)
