"""Embedding near-duplicates by a pivot-permutation index.

A sample of the vectors are reference points ("pivots"): PER_ROOT times the square root of the number of vectors, so that
both the search for pivots and the lists grow with the power 1.5 of the input. They are drawn by hash, but none within the cosine APART of
one drawn before: a large group of near copies would else hold more pivots than a member has nearest ones, and its members would have few in
common. Where so few directions are apart, there are fewer pivots and longer lists. Each vector is described by its NEAREST nearest
pivots, nearest first. It is entered in inverted lists of pivots; of two vectors that share at least SHARED pivots, one of the first
NEAREST - SHARED + 1 by number must be shared, so only those lists are entered, and nothing is lost by it. Within a list
the pivots that two vectors share are counted; pairs with at least SHARED whose cosine may reach the threshold connect their vectors.
That "may" is by vectors rounded to 8 bits a coordinate, with the errors of both taken into account, so nothing is lost; lists hold those and not the vectors.
Then the vectors that are connected meet once, and all pairs among them are verified by their cosine. No pairs are written: see links.py, also for
lists and groups of any size. There is no cap on lists or partners.

The search is approximate: near vectors may have less than SHARED pivots in common, and be connected by no others. The tests hold its recall against
brute force.

Identical vectors (bit by bit) are searched once, and all links of one are the other's.

Defined results: null vectors, vectors with nulls, infinities or NaN and vectors of norm 0 match nothing. Only vectors of equal length are
compared. Null ids are kept; equal ids with different vectors are rows of their own; fully repeated rows count once. An empty
table gives an empty result. Other columns don't matter. Ids are never changed, whatever nulls are beside them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import links

PER_ROOT, NEAREST, SHARED, APART = 4, 16, 7, 0.9


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of 32-bit numbers, those that can be compared."""
    for b in batches:
        if b.num_rows:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)
            at = np.r_[0, np.cumsum(v.value_lengths().to_numpy())]
            raw = [x[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
            good = np.array([bool(np.isfinite(y).all() and np.any(y)) for y in raw])
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(good)), pa.array(np.diff(at)[good].astype(np.int64)), pa.array([y.tobytes() for y, g in zip(raw, good, strict=True) if g], pa.binary())], ["id", "dim", "v"])


def apart(x: np.ndarray, taken: np.ndarray, wanted: int) -> np.ndarray:
    """The pivots taken, and after them the rows, in turn, that are within APART of no pivot before, up to `wanted` in all."""
    out = np.empty((wanted, x.shape[1]), np.float32)
    n = len(taken)
    out[:n] = taken
    for a in range(0, len(x), 256):
        part = x[a : a + 256]
        part = part[~(part @ out[:n].T >= APART).any(1)]
        near = part @ part.T >= APART
        own: list[int] = []
        for i in range(len(part)):
            if n + len(own) < wanted and not near[i, own].any():
                own.append(i)
        out[n : n + len(own)] = part[own]
        n += len(own)
        if n == wanted:
            break
    return out[:n]


def _outside(taken: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                yield part.filter(pa.array(~(unit(part.column("v").to_pylist()) @ taken.T >= APART).any(axis=1)))

    return run


def draw(vectors: DataFrame, dim: int, wanted: int, seed: int) -> np.ndarray:
    """Pivots out of a column v of distinct vectors of one length, fewer than wanted only if no other vector is apart from them.

    Twice the wanted number, by hash, come to the driver at once; mostly that suffices. If not, the next ones come from what is apart from
    the pivots so far.
    """
    taken, left = np.zeros((0, dim), np.float32), vectors
    while len(taken) < wanted:
        drawn = left.orderBy(F.xxhash64(F.lit(seed), "v")).limit(2 * wanted).collect()
        more = apart(unit([x["v"] for x in drawn]), taken, wanted) if drawn else taken
        if len(more) == len(taken) or len(drawn) < 2 * wanted:
            return more
        taken = more
        left = vectors.mapInArrow(_outside(taken), "v binary")
    return taken


def describe(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first; ties go to the lower number."""
    k = min(NEAREST, len(pivots))
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ pivots.T
        top = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
        out[a : a + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def _enter(pivots: dict[int, np.ndarray]):
    """The lists that each vector is entered in, and its sketch: numbers of nearest pivots, the rounded vector's scale and error, and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                u = unit(part.column("v").to_pylist())
                near = np.sort(describe(u, pivots[int(dim)]), axis=1)
                scale = np.maximum(np.abs(u).max(1, keepdims=True), np.float32(1e-30)) / np.float32(127)
                q = np.rint(u / scale).astype(np.int8)
                error = np.linalg.norm(u.astype(np.float64) - q * scale.astype(np.float64), axis=1)[:, None].astype(np.float32) + np.float32(1e-6)
                sketch = [a.tobytes() + s.tobytes() + e.tobytes() + x.tobytes() for a, s, e, x in zip(near, scale, error, q, strict=True)]
                lists = near[:, : max(1, near.shape[1] - SHARED + 1)].astype(np.int64) + (int(dim) << 32)
                of = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), of, pa.array(sketch, pa.binary())], ["rid", "lists", "sketch"])

    return run


class Sketches:
    """Sketches of vectors of any dimensions, those of one bucket having the same: shared pivots, then what the cosine may be at most."""

    def __init__(self, raw: list[bytes], threshold: float, nearest: dict[int, int]) -> None:
        self.threshold, self.size = threshold, np.array([len(x) for x in raw])
        self.at, self.of, self.mark = np.zeros(len(raw), np.int64), {}, np.zeros(1, np.int8)
        for n in np.unique(self.size):
            rows = np.flatnonzero(self.size == n)
            self.at[rows] = np.arange(len(rows))
            x = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), -1)
            # length: 4 for each nearest pivot, 8, 1 for each dimension
            k = next(k for d, k in nearest.items() if 4 * k + 8 + d == n)
            part = lambda a, z, kind: np.ascontiguousarray(x[:, a:z]).view(kind)  # noqa: E731, B023
            q = part(4 * k + 8, int(n), np.int8).astype(np.float32) * part(4 * k, 4 * k + 4, np.float32)
            # one mark for each pivot
            if len(self.mark) <= (most := int(part(0, 4 * k, np.int32).max())):
                self.mark = np.zeros(most + 1, np.int8)
            self.of[int(n)] = part(0, 4 * k, np.int32), q, part(4 * k + 4, 4 * k + 8, np.float32)[:, 0]

    def _may(self, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near, q, e = self.of[n]
        least = min(SHARED, near.shape[1])
        if len(a) == 1:  # one with many: its pivots are marked
            self.mark[near[a[0]]] = 1
            out = self.mark[near[b]].sum(1) >= least
            self.mark[near[a[0]]] = 0
        else:
            out = (near[a][:, :, None] == near[b][:, None, :]).sum((1, 2)) >= least
        some = np.flatnonzero(out)
        x = a if len(a) == 1 else a[some]
        bound = (q[x] * q[b[some]]).sum(1) + (1 + e[x]) * (1 + e[b[some]]) - 1
        out[some] = bound >= self.threshold - 1e-5
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for n in np.unique(self.size[a]):
            rows = np.flatnonzero(self.size[a] == n)
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                x, y = self.at[a[some]], self.at[b[some]]
                out[some] = self._may(int(n), x, y)
        return out

    def many(self, i: int, others: np.ndarray) -> np.ndarray:
        return self._may(int(self.size[i]), self.at[[i]], self.at[others])


    def likely(self, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """By what the cosines may be at most, many at a time; shared pivots are counted for those only."""
        _, q, e = self.of[int(self.size[a[0]])]
        among = np.r_[a, a[-1] + 1] if b is None else b
        x, y = self.at[a], self.at[among]
        for k in range(0, len(x), 512):
            i = x[k : k + 512]
            close = q[i] @ q[y].T + ((1 + e[i])[:, None] * (1 + e[y]) - 1) >= self.threshold - 1e-5
            for r, row in enumerate(close):
                j = np.flatnonzero(row) if b is not None else k + r + 1 + np.flatnonzero(row[k + r + 1 :])
                if len(j):
                    yield int(a[k + r]), among[j]


class Vectors:
    """Exact comparison of vectors of length 1."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def among(self, raw: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        if raw:
            x = unit(raw)
            for a in range(0, len(x), 512):
                s = x[a : a + 512] @ x.T >= self.threshold
                for i in range(len(s)):
                    j = a + i + 1 + np.flatnonzero(s[i, a + i + 1 :])
                    if len(j):
                        yield a + i, j

    def between(self, left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        y = unit(right)
        for a in range(0, len(left), 512):
            for i, s in enumerate(unit(left[a : a + 512]) @ y.T >= self.threshold):
                if s.any():
                    yield a + i, np.flatnonzero(s)

    def tight(self, centre: bytes, raw: list[bytes]) -> np.ndarray:
        """Whether the angle with the centre is at most half of the threshold's, with some room for rounding."""
        least = math.cos(math.acos(self.threshold) / 2) + 1e-5
        return unit(raw) @ unit([centre])[0] >= least if raw else np.zeros(0, bool)


def near_duplicates(embeddings: DataFrame, *, threshold: float = 0.95, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector with another whose cosine is at or above the threshold: id_col, class_id and n_links.

    n_links is the number of such others, copies included. class_id is the least id of all that links connect it with, null if none of them has an id.
    """
    C.ready(embeddings.sparkSession)
    d = C.pick(embeddings, id=id_col, v=vector_col)
    kind = dict(d.dtypes)["id"]
    # in an array that is cast, numbers beyond a float's become infinite
    d = d.where("v is not null").select("id", F.col("v").cast("array<float>").alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    rows = C.cut(d.mapInArrow(_packed, f"id {kind}, dim long, v binary").distinct())
    one = C.cut(rows.groupBy("dim", "v").agg(F.count(F.lit(1)).alias("m")).withColumn("rid", F.xxhash64("v")))
    pivots: dict[int, np.ndarray] = {}
    for r in one.groupBy("dim").count().collect():  # a row a length of vectors
        wanted = max(NEAREST, round(PER_ROOT * math.sqrt(r["count"])))
        pivots[r["dim"]] = draw(one.where(F.col("dim") == r["dim"]).select("v"), r["dim"], wanted, seed)
    nearest = {k: min(NEAREST, len(p)) for k, p in pivots.items()}
    entered = C.cut(one.select("dim", "rid", "v").mapInArrow(_enter(pivots), "rid long, lists array<long>, sketch binary"))
    edges = links.edges_within(entered.select("rid", F.explode("lists").alias("bucket")), entered.select("rid", "sketch"), lambda raw: Sketches(raw, threshold, nearest))
    labels = links.components(edges)
    C.discard(entered, edges)
    weights = one.select("rid", "m", F.length("v").cast("long").alias("bytes"))
    found = links.resolve(labels, weights, lambda known: known.join(one.select("rid", F.col("v").alias("contents")), "rid"), Vectors(threshold))
    every = rows.join(one.select("dim", "v", "rid", "m"), ["dim", "v"]).join(found, "rid", "left")
    every = C.cut(every.select("id", F.coalesce("cls", "rid").alias("cls"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")).where("n_links > 0"))
    least = every.groupBy("cls").agg(F.min("id").alias("class_id"))
    return every.join(least, "cls").select(F.col("id").alias(id_col), "class_id", "n_links")
