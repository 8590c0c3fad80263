"""Sharding by sampled splitters.

Records are to fall into ranges of a key, of about `shard_size` each. (1) Places of records are sampled with a probability in
proportion to size, a record as often as its size asks for. (2) Quantiles of the sample are the boundaries. (3) Each record's range is found by
binary search. (4) The true sizes of the ranges are summed; a range of more than SLACK times the wanted size is subdivided
in the same way: first by key, and where a range has but one key, by the second key and a hash of
the record, until none is overfull or every overfull range is one place. A record that is overfull by itself gets boundaries before and after it, so it
doesn't spoil the quantiles of its neighbours.

That is done at two levels: the driver samples boundaries of coarse ranges of many shards (up to RANGE characters and ROWS rows), so that it holds
OVERSAMPLE places for each of those at most; within a coarse range, which fits a task, the shards' quantiles are taken from all of its records.

A record's place is the order of (key, second key, hash); shard numbers follow it, so shards are ranges of keys, of which only
one too large is spread over neighbouring shards. Fully repeated rows have one place and are counted before they are moved.

Defined results: a null key comes first, as do null second keys; a null size or text has the size 0, an empty table no rows. Fully repeated
rows stay together. Other columns don't matter. Second keys are never changed, whatever nulls are beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

OVERSAMPLE, SLACK, RANGE, ROWS = 32, 1.5, 1_000_000_000, 1_000_000
Place = tuple


def quantiles(sample: list[tuple[Place, int]], parts: int) -> list[Place]:
    """Boundaries out of places with the numbers of times they were drawn: parts - 1, or fewer where places repeat; and around places that take more than a
    part (SLACK times) by themselves. A boundary belongs to the part above it; the least place is none."""
    sample = sorted(sample)
    if not sample:
        return []
    upto = np.cumsum([n for _, n in sample])
    at = {int(np.searchsorted(upto, upto[-1] * k / parts, side="right")) for k in range(1, parts)}
    found = {sample[i][0] for i in at}
    for place, n in sample:
        if n > SLACK * upto[-1] / parts:
            found |= {place, after(place)}
    return sorted(p for p in found if p > sample[0][0])


def after(place: Place) -> Place:
    return (*place[:-1], place[-1] + 1)


def cuts_within(key: np.ndarray, size: np.ndarray, wanted: float) -> np.ndarray:
    """Where shards begin among distinct places in order; key: the rank of each one's key."""
    upto = np.r_[0, np.cumsum(size)]
    begins, todo = [], [(0, len(size))]
    while todo:
        a, z = todo.pop()
        total = upto[z] - upto[a]
        if total <= SLACK * wanted or z - a < 2:
            begins.append(a)
            continue
        parts = max(2, round(total / wanted))
        at = np.searchsorted(upto, upto[a] + total * np.arange(1, parts) / parts, side="right") - 1
        large = a + np.flatnonzero(size[a:z] > SLACK * wanted)
        if key[a] != key[z - 1]:
            at = np.searchsorted(key, key[at])
            if not (at > a).any():  # the first key takes it all
                at = np.searchsorted(key, key[a : a + 1], side="right")
        at = np.unique(np.r_[at, large, large + 1])
        at = at[(at > a) & (at < z)]
        if not len(at):
            at = np.array([a + 1])
        todo += list(zip(np.r_[a, at].tolist(), np.r_[at, z].tolist(), strict=True))
    return np.sort(np.array(begins, np.int64))


def _assign(cuts: dict[int, list[Place]], numbers: dict[int, int]):
    """Replaces a range's number by its part's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            old = b.column("part").to_numpy(zero_copy_only=False)
            parts, at = np.unique(old, return_inverse=True)
            new = np.array([numbers[int(p)] for p in parts], np.int64)[at]
            column = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "k2", "h")}
            for p in parts:
                if bounds := cuts.get(int(p)):
                    rows = np.flatnonzero(old == p)
                    # places as ranks among boundaries: one sorted search a column, from the first on
                    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(bounds), np.int64)
                    for c, name in enumerate(("k", "k2", "h")):
                        values = column[name][rows]
                        edge = np.array([x[c] for x in bounds], dtype=object if values.dtype == object else np.int64)
                        for x, y in {*zip(lo.tolist(), hi.tolist(), strict=True)}:
                            if x == y:
                                continue
                            of = np.flatnonzero((lo == x) & (hi == y))
                            lo[of] = x + np.searchsorted(edge[x:y], values[of], side="left")
                            hi[of] = x + np.searchsorted(edge[x:y], values[of], side="right")
                    new[rows] += hi
            yield b.set_column(b.schema.get_field_index("part"), "part", pa.array(new))

    return run


def _within(wanted: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("k", "ascending"), ("k2", "ascending"), ("h", "ascending")]))
        k = t.column("k").to_pylist()
        key = np.r_[0, np.cumsum([a != b for a, b in zip(k, k[1:], strict=False)])].astype(np.int64)
        size = t.column("size").to_numpy() * t.column("n").to_numpy()
        begins = cuts_within(key, size, wanted)
        shard = np.searchsorted(begins, np.arange(t.num_rows), side="right") - 1
        return t.select(["key", "second", "size", "n", "part"]).append_column("shard", pa.array(shard))

    return run


def shards(docs: DataFrame, *, shard_size: int = 4_000_000, key_col: str = "source", second_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """key_col, second_col, size (characters) and shard, 0 and up in order of keys, of each row."""
    spark = C.ready(docs.sparkSession)
    d = C.pick(docs, key=key_col, second=second_col, text=text_col)
    # of the hash one bit goes, so that there is a place after each
    rows = d.select("key", "second", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), F.shiftright(F.xxhash64(F.lit(seed), "key", "second", "text"), 1).alias("h"))
    text = lambda c: F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0"))
    whole_numbers = dict(rows.dtypes)["second"] in ("bigint", "int", "smallint", "tinyint")
    k2 = F.coalesce(F.col("second").cast("long"), F.lit(-(1 << 63))) if whole_numbers else text("second")
    rows = rows.groupBy("key", "second", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    rows = C.cut(rows.select("key", "second", "size", "n", text("key").alias("k"), k2.alias("k2"), "h", F.lit(0).cast("long").alias("part")))
    lowest = -(1 << 63) if whole_numbers else ""
    # rows weigh something by themselves, so that a range of empty texts fits a task, too
    total = rows.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    wide = max(4 * shard_size, min(RANGE, total["size"] / (4 * spark.sparkContext.defaultParallelism)))
    weight = F.col("size") * F.col("n") + F.lit(wide / ROWS)
    attempt = 0
    while True:
        sums = rows.groupBy("part").agg(F.sum(weight).alias("weight"), F.min("k").alias("k"), F.max("k").alias("top"), F.min(F.struct("k", "k2", "h")).alias("first"), F.max(F.struct("k", "k2", "h")).alias("last"))
        sums = {r["part"]: r for r in sums.collect()}  # a row a coarse range
        over = {p: max(2, round(r["weight"] / wide)) for p, r in sums.items() if r["weight"] > SLACK * wide and r["first"] != r["last"]}
        if not over:
            break
        u = F.pmod(F.xxhash64(F.lit(seed + attempt), "k", "k2", "h"), F.lit(1 << 40)) / float(1 << 40)
        drawn = rows.withColumn("draws", F.floor(weight * OVERSAMPLE / wide + u)).where("draws > 0")
        if len(over) < len(sums):  # few are overfull after the first round
            drawn = drawn.join(spark.createDataFrame([(p,) for p in over], "part long"), "part", "left_semi")
        samples: dict[int, list[tuple[Place, int]]] = {p: [] for p in over}
        for r in drawn.select("part", "k", "k2", "h", "draws").collect():
            samples[r["part"]].append(((r["k"], r["k2"], r["h"]), r["draws"]))
        cuts: dict[int, list[Place]] = {}
        for p, parts in over.items():
            r, bounds = sums[p], quantiles(samples[p], parts)
            if r["k"] != r["top"]:  # boundaries are keys, but around a record that is too large by itself
                large = {x for place, n in samples[p] if n > SLACK * OVERSAMPLE for x in (place, after(place))}
                start = lambda k: (k, lowest, -(1 << 63))
                bounds = [b for b in {b if b in large else start(b[0]) for b in bounds} if b > tuple(r["first"])] or [start(r["k"] + "\0")]  # after the first key
            # a boundary above the last place would make an empty part
            cuts[p] = sorted(b for b in bounds if tuple(r["first"]) < b <= tuple(r["last"])) or [tuple(r["last"])]
        numbers, n = {}, 0
        for p in sorted(sums):
            numbers[p] = n
            n += 1 + len(cuts.get(p, []))
        older, rows = rows, C.cut(rows.mapInArrow(_assign(cuts, numbers), rows.schema))
        C.discard(older)
        attempt += 1
    kinds = dict(rows.dtypes)
    done = C.cut(rows.groupBy("part").applyInArrow(_within(shard_size), f"key {kinds['key']}, second {kinds['second']}, size long, n long, part long, shard long"))
    C.discard(rows)
    counts, n, offsets = done.groupBy("part").agg(F.max("shard").alias("last")).collect(), 0, []
    for r in sorted(counts, key=lambda r: r["part"]):
        offsets.append((r["part"], n))
        n += r["last"] + 1
    done = done.join(spark.createDataFrame(offsets, "part long, offset long"), "part")
    done = done.withColumn("again", F.explode(F.expr("array_repeat(0, cast(n as int))")))
    return done.select(F.col("key").alias(key_col), F.col("second").alias(second_col), "size", (F.col("shard") + F.col("offset")).alias("shard"))
