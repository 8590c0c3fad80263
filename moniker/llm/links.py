"""From buckets of likely partners to classes and exact numbers of links, without pairs in tables.

(1) edges_within: members of a bucket are compared by sketches; what comes out is a spanning forest of the pairs that may be
linked, at most one edge a member. Pairs already connected aren't compared, so a bucket of copies takes one pass.
(2) components: the connected components of those edges are the only places where links can be.
(3) resolve: the members of a component meet with their whole contents, each moved once, and all pairs of a component are
verified exactly. Each member gets its number of links and the class that verified links connect.

Hot groups. A bucket of more than `block` members is split: first each member is compared with the bucket's least one; those that match it are
connected by that, and only the others ("odd") meet blocks of the rest. A component whose contents exceed a block is split, too: each
block is compared within itself and with the component's least member, the centre. Members within half the distance that makes a
link ("tight") are surely linked with each other, by the triangle inequality, so these pairs are counted and not compared; only the others ("loose") meet all
blocks. So a group of any size takes blocks of bounded memory, and a tight group's work is in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Members of a bucket, and members and bytes of contents of a component, that are compared in one task.
BUCKET, MEMBERS, BYTES = 4096, 2048, 1 << 25
#: Edges that are united in one task.
ONE_TASK = 4_000_000


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups out of batches that are sorted by integer keys: a table of some, and the places where they begin, with its end."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.r_[0, np.flatnonzero(changes([t.column(k).to_numpy() for k in keys])) + 1, t.num_rows]

    def changes(columns: list[np.ndarray]) -> np.ndarray:
        return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])

    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield out(held)
            held = []
        new = np.flatnonzero(changes([b.column(k).to_numpy(zero_copy_only=False) for k in keys]))
        if len(new):
            cut = int(new[-1]) + 1
            yield out([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield out(held)


class Forest:
    """Labels of nodes 0 to n - 1, the least node of each connected set."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Connects i with the others; gives those of them, one of each set, by which sets came together."""
        labels, at = np.unique(self.label[others], return_index=True)
        at = at[labels != self.label[i]]
        if len(at):
            every = np.r_[self.label[i], self.label[others[at]]]
            self.label[np.isin(self.label, every)] = every.min()
        return others[at]


def _forest(sketch: Callable[[list[bytes]], object]):
    """Tasks (bucket, p, q): side 0 and side 1 of p < q meet each other, those of p = q meet among themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in groups(batches, "bucket", "p", "q"):
            rid, side = t.column("rid").to_numpy(), t.column("side").to_numpy()
            s = sketch(t.column("sketch").to_pylist())
            p, q = t.column("p").to_numpy(), t.column("q").to_numpy()
            left, right = [], []
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            two = two[(p[two] == q[two]) | (side[two] != side[two + 1])]
            if len(two):  # most buckets: all at once
                two = two[s.pairs(two, two + 1)]
                left.append(two)
                right.append(two + 1)
            for a, z in zip(edge[:-1][size > 2], edge[1:][size > 2], strict=True):
                f = Forest(z - a)
                first = np.flatnonzero(side[a:z] == 1) if p[a] != q[a] else np.arange(z - a - 1)
                second = np.flatnonzero(side[a:z] == 0) if p[a] != q[a] else None
                for i, j in s.likely(a + first, a + second) if second is not None else s.likely(a + first, None):
                    i, j = i - a, (np.arange(i - a + 1, z - a) if second is None else second) if j is None else j - a
                    j = j[f.label[j] != f.label[i]]
                    if len(j):
                        j = f.join(i, j[s.many(a + i, a + j)])
                        left.append(np.full(len(j), a + i))
                        right.append(a + j)
            if left:
                x, y = rid[np.concatenate(left)], rid[np.concatenate(right)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _star(sketch: Callable[[list[bytes]], object]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                s = sketch(b.column("sketch").to_pylist() + b.column("first").to_pylist())
                odd = ~s.pairs(np.arange(n), np.arange(n, 2 * n)) & (b.column("rid").to_numpy() != b.column("c").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("rid"), b.column("c"), pa.array(odd)], ["bucket", "rid", "c", "odd"])

    return run


def edges_within(members: DataFrame, sketches: DataFrame, sketch: Callable[[list[bytes]], object], block: int | None = None) -> DataFrame:
    """Edges a < b that span what is connected within the buckets. members: bucket, rid, distinct; sketches: rid, sketch.

    sketch makes an object of a list of sketches with pairs(a, b), which compares them in pairs, many(i, others), and likely(a, b), which gives for each of a
    those of b (of what follows it, if b is None) that many() need be asked about, None being all.
    """
    block = block or BUCKET
    counts = C.cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("c")).where("n > 1"))
    # most members are alone in their buckets; both sides of the joins grow with the corpus, so none of them is broadcast
    met = C.sieve(members, F.col("bucket"), counts.select("bucket"))[0].join(counts.hint("merge"), "bucket")
    sketches = sketches.hint("merge")
    tasks = lambda df: df.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "side", "rid").mapInArrow(_forest(sketch), "a long, b long")
    zero = F.lit(0).cast("long")
    cold = tasks(met.where(F.col("n") <= block).select("bucket", "rid", zero.alias("p"), zero.alias("q"), zero.alias("side")).join(sketches, "rid"))
    if not counts.where(F.col("n") > block).take(1):
        edges = C.cut(cold)
        C.discard(counts)
        return edges
    hot = met.where(F.col("n") > block).join(sketches, "rid").join(sketches.select(F.col("rid").alias("c"), F.col("sketch").alias("first")), "c")
    hot = C.cut(hot.mapInArrow(_star(sketch), "bucket long, rid long, c long, odd boolean"))
    stars = hot.where("not odd and rid <> c").select(F.col("c").alias("a"), F.col("rid").alias("b"))
    # blocks 0 to g - 1 of those that match, g to g + h - 1 of odd ones; tasks p <= q have an odd block as q
    blocks = hot.groupBy("bucket").agg(F.ceil(F.count(F.when(~F.col("odd"), 1)) / block).alias("g"), F.ceil(F.count(F.when(F.col("odd"), 1)) / block).alias("h")).where("h > 0")
    own = F.when(F.col("odd"), F.col("g") + F.pmod(F.xxhash64("rid"), "h")).otherwise(F.pmod(F.xxhash64("rid"), "g"))
    at = hot.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.when(F.col("odd"), F.sequence(F.lit(0).cast("long"), F.col("g") + F.col("h") - 1)).otherwise(F.sequence("g", F.col("g") + F.col("h") - 1))))
    # the odd block of a task is its side 1; of two odd ones the later
    at = at.select("bucket", "rid", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("odd") & (F.col("own") >= F.col("other"))).cast("long").alias("side"))
    edges = C.cut(cold.unionByName(stars).unionByName(tasks(at.join(sketches, "rid"))))
    C.discard(counts, hot)
    return edges


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of the task."""
    parts = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if parts:
        nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
        ends = np.split(at, np.cumsum([len(x) for p in parts for x in p])[:-1])
        left, right = np.concatenate(ends[::2]), np.concatenate(ends[1::2])
        root = np.arange(len(nodes))
        while len(left):
            x, y = root[left], root[right]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not (root == root[root]).all():
                root = root[root]
            apart = root[left] != root[right]
            left, right = left[apart], right[apart]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "label"])


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """node, label: the least node of each connected component, for the nodes of edges (a, b). Gives a table of cut().

    Up to `one_task` distinct edges (64 MB) are united in one task. More take rounds of large and small stars: in a round each node's greater
    neighbours are linked to its least one, then each node's lesser ones. The number of edges never grows, rounds grow with the logarithm of the number of nodes,
    no node's neighbours are gathered in a row, and each round is written so that lost executors repeat one at most.
    """
    one_task = ONE_TASK if one_task is None else one_task
    e = C.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= one_task:
        out = C.cut(e.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1).mapInArrow(_unite, "node long, label long"))
        C.discard(e)
        return out

    def star(pairs: DataFrame) -> DataFrame:
        """(v, least neighbour of u or u itself) for each (u, v) with v > u (large) as pairs has them."""
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    while True:
        # large: all neighbours; those above u go to the least
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(star(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small: u with its lesser neighbours
        large = C.cut(large)
        least = star(large)
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = C.cut(small.where("u <> v").distinct())
        changed = small.join(e, ["u", "v"], "left_anti").take(1) or e.join(small, ["u", "v"], "left_anti").take(1)
        C.discard(large, e)
        e = small
        if not changed:
            out = C.cut(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
            C.discard(e)
            return out


_OUT = ["label", "blk", "rid", "m", "n", "root", "loose"]
_OUT_SCHEMA = "label long, blk long, rid long, m long, n long, root long, loose boolean"


def _first(matcher: object):
    """Within a block: links and classes of all its members, and whether they are loose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in groups(batches, "label", "blk"):
            rid, own, m, g = (t.column(c).to_numpy() for c in ("rid", "own", "m", "g"))
            contents = t.column("contents")
            parts = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                # rows are sorted by own, rid: the centre from another block comes first; repeated rows are dropped
                at = a + np.flatnonzero(np.r_[True, (rid[a + 1 : z] != rid[a : z - 1]) | (own[a + 1 : z] != own[a : z - 1])])
                centre = at[own[at] == 0]
                mine = at[own[at] == 1]
                x = [contents[int(i)].as_py() for i in mine]
                f, n = Forest(len(mine)), np.zeros(len(mine), np.int64)
                for i, hits in matcher.among(x):
                    n[i] += m[mine[hits]].sum()
                    n[hits] += m[mine[i]]
                    f.join(i, hits)
                loose = np.zeros(len(mine), bool)
                if g[a] > 1:
                    home = centre if len(centre) else mine[rid[mine] == t.column("label")[int(a)].as_py()]
                    loose = ~matcher.tight(contents[int(home[0])].as_py(), x)
                k = len(mine)
                parts.append((np.repeat(t.column("label").to_numpy()[a], k), np.repeat(t.column("blk").to_numpy()[a], k), rid[mine], m[mine], n, rid[mine][f.label], loose))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], _OUT)

    return run


def _second(matcher: object):
    """Loose members (side 1) against those of another block (side 0); a loose one of side 0 is counted where it is on side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in groups(batches, "label", "blk", "part"):
            rid, side, m = (t.column(c).to_numpy() for c in ("rid", "side", "m"))
            loose, contents = t.column("loose").to_numpy(zero_copy_only=False), t.column("contents")
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                at = a + np.flatnonzero(np.r_[True, (rid[a + 1 : z] != rid[a : z - 1]) | (side[a + 1 : z] != side[a : z - 1])])
                p, q = at[side[at] == 0], at[side[at] == 1]
                if not len(p) or not len(q):
                    continue
                get = lambda rows: [contents[int(i)].as_py() for i in rows]
                n, f = np.zeros(len(p) + len(q), np.int64), Forest(len(p) + len(q))
                for i, hits in matcher.between(get(q), get(p)):
                    n[len(p) + i] += m[p[hits]].sum()
                    tight = hits[~loose[p[hits]]]
                    n[tight] += m[q[i]]
                    f.join(len(p) + i, hits)
                nodes = rid[np.r_[p, q]]
                some = np.flatnonzero((n > 0) | (f.label != np.arange(len(n))))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(n[some]), pa.array(nodes[f.label[some]])], ["rid", "n", "root"])

    return run


def resolve(labels: DataFrame, weights: DataFrame, contents: Callable[[DataFrame], DataFrame], matcher: object, members: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """rid, cls (the least rid of its class) and n, the weight of all that it is linked with.

    labels: node, label as of components(); weights: rid, m, bytes of each; contents gives a table of rids the column contents, rows may be
    repeated; matcher has among(list), between(list, list), which give numbers of linked partners one row at a time, each pair once, and tight(centre, list).
    """
    members, most_bytes = members or MEMBERS, most_bytes or BYTES
    known = labels.select(F.col("node").alias("rid"), "label").join(weights, "rid")
    stats = C.cut(known.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum("bytes") / most_bytes)).alias("g")))
    any_hot = bool(stats.where("g > 1").take(1))
    known = known.join(stats, "label").select("rid", "label", "m", "bytes", "g", F.pmod(F.xxhash64("rid"), "g").alias("home"))
    full = contents(known)
    full = C.cut(full) if any_hot else full
    one = F.lit(1).cast("long")
    at = full.select("rid", "label", "m", "g", F.col("home").alias("blk"), one.alias("own"), "contents")
    if any_hot:  # the centre goes to all blocks
        centre = full.where("g > 1 and rid = label").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).where("blk <> home")
        at = at.unionByName(centre.select("rid", "label", "m", "g", "blk", F.lit(0).cast("long").alias("own"), "contents"))
    found = C.cut(at.repartition("label", "blk").sortWithinPartitions("label", "blk", "own", "rid").mapInArrow(_first(matcher), _OUT_SCHEMA))
    done = found.join(stats.where("g > 1").select("label"), "label", "left_anti") if any_hot else found
    done = done.select("rid", F.col("root").alias("cls"), "n")
    if not any_hot:
        C.discard(stats)
        return done
    hot = found.join(stats.where("g > 1"), "label")
    # tight members of other blocks are linked with tight ones for sure
    tight = hot.where("not loose").groupBy("label", "blk").agg(F.sum("m").alias("there"))
    everywhere = tight.groupBy("label").agg(F.sum("there").alias("everywhere"))
    sure = hot.where("not loose").join(everywhere, "label").join(tight, ["label", "blk"]).select("rid", (F.col("n") + F.col("everywhere") - F.col("there")).alias("n"))
    counts = sure.unionByName(hot.where("loose").select("rid", "n"))
    edges = hot.select(F.col("rid").alias("a"), F.col("root").alias("b")).unionByName(hot.where("not loose").select(F.col("rid").alias("a"), F.col("label").alias("b")))
    full = full.where("g > 1")
    parts = hot.where("loose").select("rid").join(full, "rid").groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum("bytes") / most_bytes)).alias("parts"))
    parts = C.cut(parts)
    if parts.take(1):
        state = full.join(parts, "label").join(hot.select("rid", "loose"), "rid")
        number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        p = state.withColumn("part", number("parts")).select("label", F.col("home").alias("blk"), "part", F.lit(0).cast("long").alias("side"), "rid", "m", "loose", "contents")
        q = state.where("loose").withColumn("part", F.pmod(F.xxhash64("rid", F.lit(1)), "parts")).withColumn("blk", number("g")).where("blk <> home").select("label", "blk", "part", F.lit(1).cast("long").alias("side"), "rid", "m", "loose", "contents")
        more = C.cut(p.unionByName(q).repartition("label", "blk", "part").sortWithinPartitions("label", "blk", "part", "side", "rid").mapInArrow(_second(matcher), "rid long, n long, root long"))
        counts = counts.unionByName(more.select("rid", "n"))
        edges = edges.unionByName(more.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    classes = components(edges.where("a <> b"))
    counts = counts.groupBy("rid").agg(F.sum("n").alias("n"))
    return done.unionByName(counts.join(classes, F.col("rid") == F.col("node"), "left").select("rid", F.coalesce("label", "rid").alias("cls"), "n"))
