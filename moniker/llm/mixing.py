"""Mixing sources to target weights by pivotal dependent rounding.

A source of weight w gets the size w * budget / total weight, so each of its items the fractional number of copies
(that size) / (the source's present size). The whole part is given to each item; the fraction is a probability, and
pivotal rounding turns the probabilities of all items into 0 or 1: two are paired, mass is transferred between them at
random so that one becomes integral and each keeps its expectation, and the other goes on. Within a bucket the pairs form
a knock-out tree that is computed a round at a time; what a bucket leaves over, one item at most, meets the leftovers of
FAN other buckets of its source in the next level, and so on up a reduction tree, at last across sources. So each source
gets its number of items to within one, the whole mixture too, and no step holds more than a bucket.

The size of an item is its text's length in characters; with equal documents the rounding keeps numbers of items, so sizes
are met as closely as the sizes within a source are alike.

Defined results: all rows with one id (a null id is one, too) are one item, whose rows get the same number of copies and
whose size is their sum; its source is the least that is not null. A null source is a source of its own, whose weight
is that of "" . A null text has the size 0. A source without weight given gets `default_weight`, or where that is None its
present share to the power `alpha`. A source of size 0 keeps its items once each. An empty table gives an empty result.
Random numbers are hashes of seed and ids, so a lost task gives the same when run again. Other columns don't matter, whatever
their names; ids are never changed, whatever nulls are beside them.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PER_BUCKET, FAN = 20_000, 64


def pivotal(p: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Rounds probabilities to 0 or 1, but for one item at most, which keeps what is left. Neighbours are paired first."""
    p = p.astype(np.float64).copy()
    eps = 1e-12
    live = np.flatnonzero((p > eps) & (p < 1 - eps))
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    salt = np.uint64(0x9E3779B97F4A7C15)
    depth = 0
    while len(live) > 1:
        odd = live[len(live) // 2 * 2 :]
        i, j = live[: len(live) // 2 * 2 : 2], live[1 : len(live) // 2 * 2 : 2]
        a, b = p[i], p[j]
        with np.errstate(over="ignore"):
            u = C.uniform(C.mix64(C.mix64(keys[i] ^ (np.uint64(seed + 1) * salt)) ^ C.mix64(keys[j] + np.uint64(depth))))
        low = a + b < 1
        # below 1: one gets all, the other nothing; else one gets 1, the other the rest
        first = u * np.where(low, a + b, 2 - a - b) < np.where(low, a, 1 - b)
        p[i] = np.where(low, np.where(first, a + b, 0), np.where(first, 1, a + b - 1))
        p[j] = np.where(low, np.where(first, 0, a + b), np.where(first, a + b - 1, 1))
        for k in (i, j):
            near = p[k]
            p[k] = np.where(near < eps, 0.0, np.where(near > 1 - eps, 1.0, near))
        rest = np.concatenate([i, j])
        rest = rest[(p[rest] > 0) & (p[rest] < 1)]
        live = np.sort(np.concatenate([rest, odd]))
        depth += 1
    return p


def _round(seed: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("key", "ascending")]))
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(pivotal(t.column("p").to_numpy(), t.column("key").to_numpy().view(np.uint64), seed)))

    return run


def copies(docs: DataFrame, *, weights: Mapping[str, float] | None = None, default_weight: float | None = None, alpha: float = 0.7, budget: int | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id_col, source_col, size, expected (copies) and copies of each item; budget is the size wanted in all, by default that at hand."""
    C.ready(docs.sparkSession)
    d = C.pick(docs, id=id_col, source=source_col, text=text_col).select("id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    items = C.cut(d.groupBy("id").agg(F.min("source").alias("source"), F.sum("size").alias("size")))
    by_source = items.groupBy("source").agg(F.sum("size").alias("has"), F.count(F.lit(1)).alias("n"))
    given = F.lit(None).cast("double")
    for name, w in (weights or {}).items():
        given = F.when(F.coalesce("source", F.lit("")) == name, F.lit(float(w))).otherwise(given)
    total = by_source.agg(F.sum("has").alias("all"))
    by_source = by_source.crossJoin(total)
    own = F.lit(float(default_weight)) if default_weight is not None else F.pow(F.col("has") / F.greatest("all", F.lit(1)), F.lit(alpha))
    by_source = by_source.withColumn("w", F.when(F.col("has") > 0, F.coalesce(given, own)).otherwise(0.0))
    sums = by_source.agg(F.sum("w").alias("w_all"))
    target = F.col("w") / F.col("w_all") * (F.lit(float(budget)) if budget is not None else F.col("all"))
    rates = by_source.crossJoin(sums).select("source", F.when(F.col("has") > 0, F.round(target / F.col("has"), 9)).otherwise(1.0).alias("expected"), F.ceil(F.col("n") / PER_BUCKET).alias("width"))
    # a row a source, of which a corpus has few, so the check of size is Spark's own
    e = items.join(rates, items["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    e = e.select("id", "source", "size", "expected", F.floor("expected").alias("whole"), (F.col("expected") - F.floor("expected")).alias("p"), F.xxhash64(F.lit(seed), "id").alias("key"), "width")
    e = e.withColumn("bucket", F.pmod("key", "width").cast("long"))
    columns = ["id", "source", "size", "expected", "whole", "p", "key", "bucket"]
    e, done, groups, run = e.select(columns), None, ["source", "bucket"], _round(seed)
    schema = e.schema
    while True:
        rows = C.cut(e.groupBy(*groups).applyInArrow(run, schema))
        whole = rows.where("p = 0 or p = 1")
        done = whole if done is None else done.unionByName(whole)
        left = rows.where("p > 0 and p < 1")
        n, top = left.agg(F.count(F.lit(1)), F.max("bucket")).first()
        if n <= 1:
            break
        if len(groups) == 2 and top > 0:
            e = left.withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        else:  # the sources' leftovers
            groups = ["bucket"]
            e = left.withColumn("bucket", F.pmod("key", F.lit(C.buckets(n, PER_BUCKET))).cast("long"))
    last = left.withColumn("p", (F.pmod(F.hash(F.lit(seed), "key"), F.lit(1_000_000)) < F.col("p") * 1_000_000).cast("double"))
    done = done.unionByName(last)
    return done.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "expected", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """The input with each row as many times as copies() says."""
    key, n, copy = C.free(docs, "mixed_id"), C.free(docs, "mixed_copies"), C.free(docs, "mixed_copy")
    c = copies(docs, id_col=id_col, **settings).select(F.col(id_col).alias(key), F.col("copies").cast("int").alias(n)).where(F.col(n) > 0)
    # a decision a document grows with the corpus, so it isn't broadcast
    rows = docs.join(c.hint("merge"), docs[f"`{id_col}`"].eqNullSafe(c[key]))
    columns = [f"`{x}`" for x in docs.columns]
    return rows.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(copy)).select(columns)
