"""Near copies by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common
from rankloom.llm.components import components


def _fingerprint(text: bytes, starts: list[int], ends: list[int]) -> int:
    ones, n, of = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        some = [of(text[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, rows, raw, offsets in common.slices(batch):
                low = common.fold(raw)
                starts, ends, row = common.words_of(low, offsets)
                joined, at = common.spaced(low, starts, ends)  # a shingle is one stretch of it
                text, first = joined.tobytes(), np.searchsorted(row, np.arange(rows + 1))
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    if a == b:
                        out.append(0)
                        continue
                    w = min(width, b - a)
                    out.append(_fingerprint(text, at[a : b - w + 1].tolist(), (at[a + w : b + 1] - 1).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text over its shingles of ``width`` words.

    A-Z is lower-cased; shingles count as often as they occur; a text of fewer words is one shingle; a null, empty or
    blank text has fingerprint 0. Repeated rows give repeated rows.
    """
    return docs.select("doc_id", "text").mapInArrow(common.tidy(_fingerprints(width)), "doc_id long, fp long")


def _ball(no: int, value, flips):
    return F.transform(flips, lambda x: F.struct(F.lit(no).alias("no"), value.bitwiseXOR(x).alias("value")))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of ``prints(fp)`` that differ in 1 to ``distance`` bits.

    The 64 bits are split into the fewest segments of which one must differ in at most one bit: two for distances up
    to 3. Every fingerprint stands in the table under each of its segments. It also looks up all values within one bit
    of each of its segments in that table, and the complete distance of what it finds is verified. With two segments
    a bucket depends on 32 exact bits, so that it does not grow with the input as a short band's would.
    """
    count = max(2, (distance + 2) // 2)
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    fps = prints.select("fp").distinct().repartition(common.parts(prints))  # few bytes, but many probes each
    segments, balls, at = [], [], 0
    for i, width in enumerate(widths):
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        segments.append((value, F.lit(i)))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
        balls.append(_ball(i, value, flips))
        at += width
    table = fps.select("fp", F.inline(F.array(*[F.struct(n.alias("no"), v.alias("value")) for v, n in segments])))
    probes = fps.select(F.col("fp").alias("a"), F.inline(F.concat(*balls)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance
    return probes.join(table, ["no", "value"]).filter((F.col("a") < F.col("fp")) & near).select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): near copies linked at ``distance`` bits or fewer, and the smallest doc_id reachable.

    Documents of one fingerprint fold into one row before any pairing, so groups of exact copies cost one row. Texts
    without words all have fingerprint 0 and link like any others. An empty table gives an empty result; rows that
    repeat a doc_id are kept, and share a component only if their fingerprints do. A null doc_id is never the smallest;
    a component of nothing else is null. A text of any length is one task's. Other columns than doc_id and text are not
    looked at and left out.
    """
    of = common.cut(fingerprints(docs, width))
    prints = of.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    reach = components(links(of, distance)).select(F.col("node").alias("fp"), "component_id")
    ids = prints.join(reach, "fp", "left").withColumn("component_id", F.coalesce("component_id", "fp"))
    least = ids.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    ids = ids.join(least, "component_id").select("fp", F.col("least").alias("component_id"))
    return of.join(ids, "fp").select("doc_id", "fp", "component_id")


def _masks(width: int, radius: int) -> list[int]:
    """Every value of ``width`` bits that has at most ``radius`` ones."""
    return [sum(1 << b for b in bits) for n in range(min(width, radius) + 1) for bits in combinations(range(width), n)]


def _order(star: int) -> int:
    """What a node is XORed with to give its place in the order of this round: nodes are hashes, so orders differ at random."""
    return (star + 1) * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63)


class _Union:
    """Sets of places that grow together; a set is named by its smallest place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


#: Candidates of one node in one group up to which each is a row; pairs of nodes that both have more are known by their cluster.
MANY = 32
#: Rows of nodes under their groups that one task deals.
WIDE = 1 << 20
#: Pairs looked at together.
AT_ONCE = 1 << 20


def wide_links(nodes: DataFrame, distance: int, radius: int, size: int, star: int | None = None, many: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b but for stars, of ``nodes(node, fp, part)`` whose fingerprints differ in ``distance`` bits or fewer.

    As ``links``, with balls of ``radius`` bits in the fewest segments of which one must differ in so few: distance 11
    and radius 3 take three. A node travels to the groups whose leading bits lie within the radius of its own; a group
    looks up the rest of the ball in its own nodes, so that no ball is shuffled. Only nodes of different ``part`` are
    paired, and others are not even looked at: a dense group of one part costs no pairs. A pair is named by the first
    segment that finds it. With ``star`` (a number that sets the order) every node is paired with one other alone, the
    first of all that stand first in a bucket it looks up. With ``many`` there is a column ``heavy`` too: a pair of which
    one node has at most ``many`` candidates in the group is a row (heavy false); all other pairs of the group are inside
    clusters, and each node but the first of a cluster is a row with that first (heavy true). So rows follow the nodes,
    and so does memory. Groups follow ``size``, the number of nodes; what a lookup finds by chance grows with the nodes
    over 2**21.
    """
    count = max(2, -(-(distance + 1) // (radius + 1)))
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    lead = min(max(2, (size >> 16).bit_length()), min(widths) - 1)
    places = [sum(widths[:i]) for i in range(count)]
    tops = []
    for i, (width, at) in enumerate(zip(widths, places)):
        top = F.shiftrightunsigned("fp", at + width - lead).bitwiseAND(F.lit((1 << lead) - 1))
        tops.append(_ball(i, top, F.array(*[F.lit(m).cast("long") for m in _masks(lead, radius)])))

    def find(table: pa.Table) -> pa.Table:
        no, group = table["no"][0].as_py(), table["value"][0].as_py()
        rest = widths[no] - lead
        fps, node = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
        part = np.unique(table["part"].to_numpy(), return_inverse=True)[1]
        value = fps >> np.uint64(places[no]) & np.uint64((1 << widths[no]) - 1)
        low = (value & np.uint64((1 << rest) - 1)).astype(np.int64)
        off = np.bitwise_count(value >> np.uint64(rest) ^ np.uint64(group))
        own = np.flatnonzero(off == 0)
        parts = int(part.max()) + 1
        turn = node ^ np.int64(_order(star or 0))
        own = own[np.lexsort((turn[own] if star is not None else part[own], low[own]))]
        start = np.concatenate(([0], np.cumsum(np.bincount(low[own], minlength=1 << rest))))
        keys = low[own] * parts + part[own]
        best, rank = np.full(len(node), -1), turn.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        met, clusters = np.zeros(len(node), np.int64), _Union(len(node))

        def pairs(mine: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
            size = end - begin
            hit = np.flatnonzero(size)
            mine, begin, size = mine[hit], begin[hit], size[hit]
            upto = np.cumsum(size)
            first = 0
            while first < len(mine):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + AT_ONCE, "right")))
                some(mine[first:last], begin[first:last], size[first:last])
                first = last

        def some(mine: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
            probe = np.repeat(mine, size)
            other = own[np.arange(len(probe)) + np.repeat(begin - np.cumsum(size) + size, size)]
            off = fps[probe] ^ fps[other]
            near = (node[probe] < node[other]) & (np.bitwise_count(off) <= distance)
            for k in range(no):  # an earlier segment has found it
                near &= np.bitwise_count(off >> np.uint64(places[k]) & np.uint64((1 << widths[k]) - 1)) > radius
            if not near.any():
                return
            a, b = probe[near], other[near]
            if many is not None:
                np.add.at(met, a, 1)
                np.add.at(met, b, 1)
                heavy = (met[a] > many) & (met[b] > many)  # and stay so
                clusters.add(a[heavy], b[heavy])
                a, b = a[~heavy], b[~heavy]
            found.append((a, b))

        for n in range(radius + 1):
            mine = np.flatnonzero(off == n)
            for mask in _masks(rest, radius - n) if len(mine) and len(own) else []:
                at = low[mine] ^ mask
                live = start[at + 1] > start[at]
                m, at = mine[live], at[live]
                if star is not None:
                    first = own[start[at]]
                    near = (np.bitwise_count(fps[m] ^ fps[first]) <= distance) & (part[m] != part[first]) & (turn[first] < rank[m])
                    best[m[near]], rank[m[near]] = first[near], turn[first[near]]
                else:
                    mark = at * parts + part[m]
                    pairs(m, start[at], np.searchsorted(keys, mark, "left"))
                    pairs(m, np.searchsorted(keys, mark, "right"), start[at + 1])
        if star is not None:
            some = np.flatnonzero(best >= 0)
            a, b = node[best[some]], node[some]
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "turn": pa.array(rank[some])})
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if many is None:
            return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})
        heavy = (met[a] > many) & (met[b] > many)
        clusters.add(a[heavy], b[heavy])
        inner = np.flatnonzero(clusters.root != np.arange(len(node)))
        a, b = np.concatenate((a[~heavy], clusters.root[inner])), np.concatenate((b[~heavy], inner))
        mark = np.arange(len(a)) >= len(a) - len(inner)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64()), "heavy": pa.array(mark)})

    tasks = -(-size * count * len(_masks(lead, radius)) // WIDE)
    # two at least: a single partition would serve for the groups too
    groups = nodes.select("node", "fp", "part").repartition(max(2, tasks)).select("*", F.inline(F.concat(*tops))).groupBy("no", "value")
    if star is None:
        return groups.applyInArrow(common.tidy(find), "a long, b long" + ", heavy boolean" * (many is not None))
    return groups.applyInArrow(common.tidy(find), "a long, b long, turn long").groupBy("b").agg(F.min_by("a", "turn").alias("a")).select("a", "b")


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = next(_fingerprints(width)(iter([batch.select(["doc_id", "text"])])))
            out: list[int] = []
            for _, rows, raw, offsets in common.slices(batch):
                low = common.fold(raw)
                starts, ends, row = common.words_of(low, offsets)
                joined, at = common.spaced(low, starts, ends)
                cut = at[np.searchsorted(row, np.arange(rows + 1))].tolist()
                text = joined.tobytes()
                out += [xxhash.xxh64_intdigest(text[a:b], 7) for a, b in zip(cut[:-1], cut[1:])]
            node = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([prints.column(0), batch.column(2), prints.column(1), node], names=["doc_id", "raw", "fp", "node"])

    return run


def _shingles(width: int):
    """(node, shingles): the distinct 64-bit shingle hashes of a text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, rows, raw, offsets in common.slices(batch):
                low = common.fold(raw)
                starts, ends, row = common.words_of(low, offsets)
                joined, at = common.spaced(low, starts, ends)
                text, first = joined.tobytes(), np.searchsorted(row, np.arange(rows + 1)).tolist()
                for a, b in zip(first[:-1], first[1:]):
                    w = min(width, b - a)
                    spans = zip(at[a : b - w + 1].tolist(), (at[a + w : b + 1] - 1).tolist()) if w else ()
                    out.append(np.unique(np.array([xxhash.xxh64_intdigest(text[x:y], 42) for x, y in spans], np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    return run


def _alike(similarity: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of = {n: np.frombuffer(s, np.uint64) for n, s in zip(sets["node"].to_pylist(), sets["shingles"].to_pylist())}
        good = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            x, y = of[a], of[b]
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
            good.append(both >= similarity * (len(x) + len(y) - both))
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


#: Nodes whose texts are fetched by a broadcast of their keys; more are fetched by a shuffle.
BROADCAST = 1 << 19
#: Rounds in which every node is verified against one other, before all pairs of different parts are.
TURNS = 3


def _sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes of ``asked(node)``."""
    wanted = common.cut(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "raw"))
    n = wanted.count()
    wanted = common.few(wanted, n)
    keys = F.broadcast(wanted) if n <= BROADCAST else wanted
    texts = docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw")).join(keys, "raw").groupBy("raw", "node").agg(F.min("text").alias("text"))
    return texts.select("node", "text").mapInArrow(common.tidy(_shingles(width)), "node long, shingles binary")


def _verified(docs: DataFrame, nodes: DataFrame, met: DataFrame, width: int, similarity: float, side: int) -> DataFrame:
    """The pairs of ``met(a, b)`` whose sets of shingles are similar. Sets travel once a cell of blocks of nodes, not once a pair."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    pairs = common.cut(met.withColumn("cell", (cell("a") * side + cell("b")).cast("int")))
    pairs = common.few(pairs, pairs.count())
    asked = pairs.select(F.col("cell").alias("at"), F.col("a").alias("node")).unionByName(pairs.select(F.col("cell").alias("at"), F.col("b").alias("node"))).distinct()
    sets = asked.join(_sets(docs, nodes, asked, width), "node")
    return pairs.groupBy("cell").cogroup(sets.groupBy("at")).applyInArrow(common.tidy(_alike(similarity)), "a long, b long")


#: Members of a cluster's block: a sixteenth of the cluster within these bounds, so that blocks fit a task.
BLOCK = (256, 8192)


def _joins(distance: int, similarity: float):
    """The links of a unit (one block of a cluster, or two blocks against each other) that join what was not joined."""

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("node")
        i, j = unit["i"][0].as_py(), unit["j"][0].as_py()
        node, fps, at = unit["node"].to_numpy(), unit["fp"].to_numpy().view(np.uint64), unit["at"].to_numpy()
        root = np.unique(unit["part"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        names, of = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(of, np.cumsum(size)[:-1])
        mark, out = np.zeros(len(names), bool), []
        for a in np.flatnonzero(at == i).tolist():
            near = (root != root[a]) & (np.bitwise_count(fps ^ fps[a]) <= distance) & (np.minimum(size, size[a]) >= similarity * np.maximum(size, size[a]))
            near &= (at == j) if i != j else (np.arange(len(node)) > a)
            others = np.flatnonzero(near)
            if not len(others):
                continue
            mark[sets[a]] = True
            upto = np.concatenate(([0], np.cumsum(mark[np.concatenate([sets[b] for b in others])])))
            mark[sets[a]] = False
            end = np.cumsum(size[others])
            both = upto[end] - upto[end - size[others]]
            for b in others[both >= similarity * (size[a] + size[others] - both)].tolist():
                if root[b] != root[a]:
                    root[root == root[b]] = root[a]
                    out.append((node[a], node[b]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _within(docs: DataFrame, nodes: DataFrame, parted: DataFrame, met: DataFrame, width: int, distance: int, similarity: float) -> DataFrame:
    """Verified links (a, b) inside the clusters that ``met(a, b)`` ties together, as many as join what their links join.

    All members of a cluster meet, block against block, each with its set of shingles; pairs are compared in the task
    and never rows. A task's memory follows its two blocks; the comparisons of a cluster of nodes that the rounds did
    not join grow with the square of its members, dealt over the units.
    """
    reach = components(met).select("node", F.col("component_id").alias("cluster"))
    least, most = BLOCK
    sizes = reach.groupBy("cluster").agg(F.count("*").alias("n"))
    sizes = sizes.select("cluster", F.ceil(F.col("n") / F.least(F.greatest(F.col("n") / 16, F.lit(least)), F.lit(most))).cast("int").alias("blocks"))
    members = common.cut(parted.join(reach.join(sizes, "cluster"), "node").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    members = common.few(members, members.count())
    rows = members.join(_sets(docs, nodes, members, width), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = rows.select("node", "fp", "part", "cluster", "shingles", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    return units.groupBy("cluster", "i", "j").applyInArrow(common.tidy(_joins(distance, similarity)), "a long, b long")


def _joined(parted: DataFrame, links_: DataFrame, star: int, size: int) -> DataFrame:
    """``parted(node, fp, part)``, ``size`` rows, with linked parts under one name where a few steps can give it.

    Every part points to the one of those linked with it whose first node in the round's order comes first, if before its
    own, and takes the name four pointers on: all that a star's centre is linked with take the centre's name. Parts that stay apart are only paired later; ``components`` has the last word. Rounds go through written tables, as
    a checkpoint remembers how its rows were dealt, and the joins of every round would multiply what it remembers.
    """
    of = parted.select("node", "part")
    ends = links_.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").filter("x <> y").select("x", "y").distinct()
    turns = parted.groupBy("part").agg(F.min(F.col("node").bitwiseXOR(F.lit(_order(star)))).alias("turn"))
    ends = ends.join(turns.toDF("x", "x_turn"), "x").join(turns.toDF("y", "y_turn"), "y")
    down = F.col("x_turn") < F.col("y_turn")
    to = ends.select(
        F.when(down, F.col("y")).otherwise(F.col("x")).alias("part"), F.when(down, F.col("x")).otherwise(F.col("y")).alias("to"), F.least("x_turn", "y_turn").alias("turn")
    )
    step = common.few(common.written(to.groupBy("part").agg(F.min_by("to", "turn").alias("to"))), size)
    for _ in range(2):
        step = step.join(step.toDF("to", "far"), "to", "left").select("part", F.coalesce("far", "to").alias("to"))
    return common.few(common.written(parted.join(step, "part", "left").select("node", "fp", F.coalesce("to", "part").alias("part"))), size)


def similar_copies(docs: DataFrame, width: int = 5, distance: int = 11, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id, raw, root) as ``near_duplicates``, of links whose similarity is verified.

    Texts whose fingerprints differ in ``distance`` bits or fewer are linked if the Jaccard similarity of their sets of
    distinct shingles is ``similarity`` or more. Texts of equal words are one node, as are all without words. In TURNS
    rounds every node is verified against one other, the same for all of a dense group; what is linked then is one
    part, and all pairs between different parts follow, so that the components are those of all links: as rows where a
    node has at most MANY candidates in a group, inside the tasks of its cluster where both have more. ``raw`` is the text's
    xxhash64, and rows of one ``root`` are one component, also where component_id is null because no doc_id in it is
    known, or where rows of one doc_id have different texts. Very long texts are read whole; repeated rows are kept; an
    empty table gives an empty result.
    """
    blocks = common.parts(docs)
    side = max(2, int(blocks**0.5))
    raw = F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw")
    of = common.cut(docs.select("doc_id", "text", raw).mapInArrow(common.tidy(_nodes(width)), "doc_id long, raw long, fp long, node long"))
    nodes = common.cut(of.groupBy("node").agg(F.min("fp").alias("fp"), F.min("raw").alias("raw"), F.min("doc_id").alias("doc_id")))
    size = nodes.count()
    nodes = common.few(nodes, size)
    parted, stars = nodes.select("node", "fp", F.col("node").alias("part")), None
    for turn in range(TURNS):
        good = common.few(common.cut(_verified(docs, nodes, wide_links(parted, distance, radius, size, turn), width, similarity, side)), size)
        stars = good if stars is None else stars.unionByName(good)
        parted = _joined(parted, good, turn, size)
    met = common.cut(wide_links(parted, distance, radius, size, many=MANY))
    met = common.few(met, met.count())
    rest = _verified(docs, nodes, met.filter("NOT heavy").select("a", "b"), width, similarity, side)
    heavy = met.filter("heavy").select("a", "b")
    if not heavy.isEmpty():
        rest = rest.unionByName(_within(docs, nodes, parted, heavy, width, distance, similarity))
    rest = common.cut(rest)
    rest = common.few(rest, rest.count())
    of_part = parted.select("node", "part")
    ends = stars.unionByName(rest).join(of_part.toDF("a", "x"), "a").join(of_part.toDF("b", "y"), "b").filter("x <> y")
    reach = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).select(F.col("node").alias("part"), F.col("component_id").alias("root"))
    ids = nodes.select("node", "doc_id").join(of_part, "node").join(reach, "part", "left").withColumn("root", F.coalesce("root", "part"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return of.join(ids.join(least, "root").select("node", "component_id", "root"), "node").select("doc_id", "fp", "component_id", "raw", "root")
