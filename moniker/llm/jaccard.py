"""N-gram Jaccard join: MinHash bands give candidates, Bayesian pruning drops most, the rest is verified exactly.

The n-grams of a text are its runs of `n` lower-case words (runs of letters and digits); a text with fewer words has one
n-gram, all its words. Texts without words match nothing. Two texts match if the Jaccard similarity of their n-gram sets
is at least `threshold`. Texts with equal sets match.

Method: (1) one pass over the texts gives for each two hashes of its n-gram set and `HASHES` MinHash values of 16 bits; (2) one text
stands for all with the same set, so copies cost nothing further; (3) texts that agree in a band of MinHash values meet
in a bucket, where pairs are compared `STEP` values at a time: with m of k values equal and a uniform prior, the similarity
has the posterior Beta(m + 1, k - m + 1), and a pair whose posterior probability of reaching the threshold is below
`tolerance` is dropped; (4) where the pairs that are left connect texts, all pairs of the connected ones are
verified against their full n-gram sets. No pairs are written: see links.py, also for groups and buckets of any size. There is no
cap on buckets or partners.

Sets are told apart by 64 bits, and copies are such only if 32 further bits agree. The search is approximate: a pair that shares no band,
or is dropped wrongly, is missed unless other matches connect it. The tests hold the recall against brute force.

Nulls, ties, repeats: a null or empty text has no words. Rows with equal text match each other, whether or not their ids
are equal; rows are told apart by (id, text), so fully repeated rows count as one. A null id is an id like others. An empty
table gives an empty result. Other columns of the input are ignored, whatever their names.
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

HASHES, ROWS, STEP = 63, 3, 21
BANDS = HASHES // ROWS


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(9))
    return g.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 1 << 63, HASHES, dtype=np.uint64)


A, B = _coefficients()


def ngram_sets(strings: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, one text's after another's; and n + 1 offsets."""
    data, start, end, counts = C.words(strings)
    per = np.diff(counts)
    grams = np.where(per == 0, 0, np.maximum(1, per - n + 1))
    offsets = np.r_[0, np.cumsum(grams)]
    owner = np.repeat(np.arange(len(per)), grams)
    first = counts[:-1][owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    last = np.minimum(first + n, counts[1:][owner]) - 1
    if not len(first):
        return np.zeros(0, np.uint64), offsets
    h = C.span_hashes(data, start[first], end[last])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(per) + 1))


def minhashes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES values for each set that isn't empty: the low 16 bits of least hashes of 32."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), HASHES), np.uint16)
    if len(starts):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((((h ^ B[k]) * A[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches, "text"):
            h, offsets = ngram_sets(b.column("text"), n)
            some = np.flatnonzero(np.diff(offsets) > 0)
            if not len(some):
                continue
            of = lambda x: (t := np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)])[offsets[some + 1]] - t[offsets[some]]  # noqa: E731, B023
            rid = C.mix64(of(C.mix64(h))).view(np.int64)
            proof = (C.mix64(of(C.mix64(h ^ A[0]))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sig = minhashes(h, offsets)
            at = pa.array(some)
            columns = [b.column("id").take(at), b.column("row").take(at), pa.array(rid), pa.array(proof), pa.array(np.diff(offsets)[some].astype(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "rid", "proof", "grams", "sig"])

    return run


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each k compared, the least m with P(similarity >= threshold | m of k equal) >= tolerance."""
    out = {}
    for k in range(STEP, HASHES + 1, STEP):
        for m in range(k + 1):
            # Beta(m + 1, k - m + 1) above t is a binomial(k + 1, t) of at most m
            if sum(math.comb(k + 1, i) * threshold**i * (1 - threshold) ** (k + 1 - i) for i in range(m + 1)) >= tolerance:
                out[k] = m
                break
    return out


class Signatures:
    """MinHash signatures, compared step by step."""

    def __init__(self, raw: list[bytes], least: dict[int, int]) -> None:
        self.sig, self.least = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, HASHES), least

    def _compare(self, n: int, left: object, right: object) -> np.ndarray:
        """left and right give STEP values, from a column on, of the pairs numbered."""
        live, m = np.arange(n), np.zeros(n, np.int64)
        for at in range(0, HASHES, STEP):
            m = m + (left(live, at) == right(live, at)).sum(1)
            keep = m >= self.least[at + STEP]
            live, m = live[keep], m[keep]
        out = np.zeros(n, bool)
        out[live] = True
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._compare(len(a), lambda k, at: self.sig[a[k], at : at + STEP], lambda k, at: self.sig[b[k], at : at + STEP])

    def many(self, i: int, others: np.ndarray) -> np.ndarray:
        return self._compare(len(others), lambda _, at: self.sig[i, at : at + STEP][None], lambda k, at: self.sig[others[k], at : at + STEP])

    def likely(self, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[int, None]]:
        return ((int(i), None) for i in a)


class Sets:
    """Exact comparison of sets of hashes, each ascending. Sets become rows of bits over the hashes that several of them have."""

    CHUNK = 1 << 16

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def _bits(self, sets: list[np.ndarray]) -> Iterator[np.ndarray]:
        every = np.concatenate(sets)
        values, at, n = np.unique(every, return_inverse=True, return_counts=True)
        number = np.cumsum(n > 1) - 1
        shared = n[at] > 1
        row, column = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[shared], number[at][shared]
        width = int((n > 1).sum())
        for a in range(0, width, self.CHUNK):
            w = min(self.CHUNK, width - a)
            here = (column >= a) & (column < a + w)
            bits = np.zeros((len(sets), -(-w // 64) * 64), bool)
            bits[row[here], column[here] - a] = True
            yield np.packbits(bits, axis=1).view(np.uint64)

    def among(self, raw: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        if len(sets) == 2:
            both = np.concatenate(sets)
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if shared / (len(both) - shared) >= self.threshold:
                yield 0, np.array([1])
        elif len(sets) > 2:
            yield from self._linked(sets, range(len(sets) - 1), lambda i: np.arange(i + 1, len(sets)))

    def between(self, left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        sets = [np.frombuffer(x, np.uint64) for x in [*left, *right]]
        others = np.arange(len(left), len(sets))
        for i, hits in self._linked(sets, range(len(left)), lambda _: others):
            yield i, hits - len(left)

    def _linked(self, sets: list[np.ndarray], rows: range, others: object) -> Iterator[tuple[int, np.ndarray]]:
        size = np.array([len(x) for x in sets])
        chunks = self._bits(sets)
        shared = [np.zeros(len(others(i)), np.int64) for i in rows]
        for bits in chunks:
            for k, i in enumerate(rows):
                j = others(i)
                shared[k] += np.bitwise_count(bits[j[0] : j[-1] + 1] & bits[i]).sum(1, dtype=np.int64)
        for k, i in enumerate(rows):
            j = others(i)
            hits = j[shared[k] / (size[i] + size[j] - shared[k]) >= self.threshold]
            if len(hits):
                yield i, hits

    def tight(self, centre: bytes, raw: list[bytes]) -> np.ndarray:
        """Whether the distance 1 - similarity from the centre is at most half of 1 - threshold."""
        c = np.frombuffer(centre, np.uint64)
        out = np.zeros(len(raw), bool)
        for k, x in enumerate(raw):
            x = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(c, x), len(c) - 1)
            shared = int((c[at] == x).sum())
            out[k] = 2 * shared >= (1 + self.threshold) * (len(c) + len(x) - shared)
        return out


def _sets(n: int):
    kept = ["rid", "label", "m", "bytes", "g", "home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches, "text"):
            h, offsets = ngram_sets(b.column("text"), n)
            raw = [h[offsets[i] : offsets[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(raw, pa.binary())], [*kept, "contents"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    C.ready(docs.sparkSession)
    d = C.pick(docs, id=id_col, text=text_col)
    return d.withColumn("row", F.xxhash64("id", "text"))


def _matches(rows: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
    """id, row, cls, n_links and copies (how often it is repeated in full) of each distinct row with words."""
    kind = dict(rows.dtypes)["id"]
    sig = C.cut(rows.mapInArrow(_signatures(n), f"id {kind}, row long, rid long, proof int, grams long, sig binary"))
    one = C.cut(sig.groupBy("rid").agg(F.min(F.struct("row", "proof", "grams", "sig")).alias("o")).select("rid", "o.*"))
    least = least_matches(threshold, tolerance)
    word = lambda k: F.substring("sig", k * ROWS * 2 + 1, ROWS * 2)
    members = one.select("rid", F.explode(F.array(*[F.xxhash64(word(k), F.lit(k)) for k in range(BANDS)])).alias("bucket"))
    edges = links.edges_within(members, one.select("rid", F.col("sig").alias("sketch")), lambda raw: Signatures(raw, least))
    owners = sig.groupBy("id", "row", "rid", "proof").agg(F.count(F.lit(1)).alias("copies"))
    weights = one.join(owners.groupBy("rid").agg(F.count(F.lit(1)).alias("m")), "rid").select("rid", "row", "m", (8 * F.col("grams")).alias("bytes"))
    labels = links.components(edges)
    C.discard(edges)

    def contents(known: DataFrame) -> DataFrame:
        wanted = C.cut(known.join(weights.select("rid", "row"), "rid"))
        may, _ = C.sieve(rows.select("row", "text"), F.col("row"), wanted.select("row"))
        return may.join(wanted.hint("merge"), "row").select("rid", "label", "m", "bytes", "g", "home", "text").mapInArrow(_sets(n), "rid long, label long, m long, bytes long, g long, home long, contents binary")

    found = links.resolve(labels, weights.select("rid", "m", "bytes"), contents, Sets(threshold))
    # rows whose set is another one with the same hash, if there ever are any, match nothing
    true = owners.join(one.select("rid", F.col("proof").alias("whose")), "rid").join(weights.select("rid", "m"), "rid").join(found, "rid", "left")
    same = F.col("proof") == F.col("whose")
    return true.select("id", "row", F.when(same, F.coalesce("cls", "rid")).otherwise(F.xxhash64("rid", "proof")).alias("cls"), F.when(same, F.coalesce("n", F.lit(0)) + F.col("m") - 1).otherwise(F.lit(0)).alias("n_links"), "copies")


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, tolerance: float = 0.01) -> DataFrame:
    """A row for each document that matches another: id_col, class_id and n_links.

    n_links is the number of documents that it matches, copies included. class_id is the least id of all that matches connect it with, null
    if none of them has an id.
    """
    found = C.cut(_matches(_rows(docs, id_col, text_col), n, threshold, tolerance).where("n_links > 0"))
    least = found.groupBy("cls").agg(F.min("id").alias("class_id"))
    return found.join(least, "cls").select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, tolerance: float = 0.01) -> DataFrame:
    """The input without all but one of each group of matching documents, a group being what matches connect.

    The row with the least id stays (a null id is the least; among equal ids the least hash), once if it is repeated. Texts without words stay.
    """
    found = C.cut(_matches(_rows(docs, id_col, text_col), n, threshold, tolerance).where("n_links > 0 or copies > 1"))
    stays = found.groupBy("cls").agg(F.min(F.struct("id", "row")).alias("stays"))
    marked = C.cut(found.join(stays, "cls").select("id", "row", (F.col("row") == F.col("stays.row")).alias("stays"), "copies").where("not stays or copies > 1"))
    key = C.free(docs, "row_hash")
    keyed = docs.withColumn(key, F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text_col}`"]))
    on = lambda d, m: (d[key] == m["row"]) & d[f"`{id_col}`"].eqNullSafe(m["id"])
    # written on its own, as it is mostly empty, and its known size then spares this branch a shuffle of texts
    again = C.cut(marked.where("stays").select("id", "row").coalesce(1))
    may, others = C.sieve(keyed, F.col(key), marked.select("row"))
    return others.unionByName(may.join(marked, on(may, marked), "left_anti")).unionByName(may.join(again, on(may, again), "left_semi").dropDuplicates([key])).select([f"`{c}`" for c in docs.columns])
