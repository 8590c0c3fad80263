"""Best-fit packing by best-two-fit.

Documents are packed into bins of `capacity` characters, whole. A bin is filled greedily: the largest unpacked document
that fits, until none fits. Then its smallest document, of size s, is replaced by the two unpacked documents whose sizes
sum to the most that is over s and at most s + the gap, if there are two such: they fit the expanded gap more tightly. The replaced document
is unpacked again. A document longer than a bin is first cut into pieces of the capacity and one rest, so all text is packed.

Documents are packed within buckets of about BUCKET characters by a hash of text, id and the row's number, as many as the input needs, so buckets are packed in
parallel and the memory a task needs doesn't grow; one bin a bucket is left partly empty, at worst.

Defined results: of equal sizes the row with the least (id, hash of text) goes first, null ids before others. Empty and null texts are put in no bin.
Repeated rows are packed each by itself, and spread over buckets. An empty table gives an empty result. Other columns don't matter. Ids are never changed, whatever
nulls are beside them.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY, BUCKET = 8192, 16_000_000


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in sizes, all of which are from 1 to capacity."""
    at: dict[int, deque[int]] = defaultdict(deque)
    for i, s in enumerate(sizes):
        at[s].append(i)
    mask = 0
    for s in at:
        mask |= 1 << s
    have = np.zeros(capacity + 1, np.int64)
    for s, q in at.items():
        have[s] = len(q)
    distinct = np.flatnonzero(have)
    dead = 0
    bins = []

    def take(s: int) -> int:
        nonlocal mask, dead
        i = at[s].popleft()
        have[s] -= 1
        if not at[s]:
            mask ^= 1 << s
            dead += 1
        return i

    while mask:
        gap, inside = capacity, []
        while gap and (fits := mask & ((1 << (gap + 1)) - 1)):
            s = fits.bit_length() - 1
            inside.append((s, take(s)))
            gap -= s
        if gap and mask:
            small, i = inside[-1]
            room = small + gap
            if dead * 2 > len(distinct):
                distinct, dead = np.flatnonzero(have), 0
            d = distinct[: np.searchsorted(distinct, room)]
            d = d[have[d] > 0]
            if len(d):
                # for each size the largest not above it that fits with it
                p = np.searchsorted(d, np.minimum(room - d, d), side="right") - 1
                ok = p >= 0
                if ok.any():
                    x, y = d[ok], d[p[ok]]
                    alone = (x == y) & (have[x] < 2)
                    if alone.any():
                        lower = p[ok] - 1
                        y = np.where(alone, np.where(lower >= 0, d[np.maximum(lower, 0)], -capacity), y)
                    total = x + y
                    best = int(total.max())
                    if best > small:
                        k = int(np.flatnonzero(total == best)[-1])
                        inside.pop()
                        inside += [(int(x[k]), take(int(x[k]))), (int(y[k]), take(int(y[k])))]
                        at[small].appendleft(i)
                        if not have[small]:
                            mask |= 1 << small
                            if small in distinct:
                                dead -= 1
                            else:
                                distinct = np.sort(np.append(distinct, small))
                        have[small] += 1
        bins.append([i for _, i in inside])
    return bins


def _bucket(capacity: int, with_text: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("id", "ascending"), ("h", "ascending")], null_placement="at_start"))
        size, row = t.column("size").to_numpy(), np.arange(t.num_rows)
        n = np.maximum(1, -(-size // capacity))
        of = np.repeat(row, n)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * capacity
        length = np.minimum(size[of] - start, capacity)
        bins = pack(length.tolist(), capacity)
        inside = np.concatenate([np.array(b, np.int64) for b in bins])
        offsets = np.r_[0, np.cumsum([len(b) for b in bins])].astype(np.int32)
        of, start, length = of[inside], start[inside], length[inside]
        listed = lambda values: pa.ListArray.from_arrays(pa.array(offsets), values)
        ids = t.column("id").combine_chunks()
        out = {"bucket": pa.array(np.repeat(t.column("bucket")[0].as_py(), len(bins))), "bin": pa.array(np.arange(len(bins), dtype=np.int64)), "doc_ids": listed(ids.take(pa.array(of)))}
        out |= {"starts": listed(pa.array(start)), "lengths": listed(pa.array(length)), "filled": pa.array(np.add.reduceat(length, offsets[:-1]))}
        if with_text:
            texts = t.column("text").to_pylist()
            out["texts"] = listed(pa.array([texts[i][a : a + k] for i, a, k in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)], pa.string()))
        return pa.table(out)

    return run


def packed(docs: DataFrame, *, capacity: int = CAPACITY, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a bin: bucket and bin (its number there), and of each document or piece in it doc_ids, starts and lengths in characters; filled, their sum; texts if wanted."""
    C.ready(docs.sparkSession)
    d = C.pick(docs, id=id_col, text=text_col)
    kind = dict(d.dtypes)["id"]
    sized = d.select("id", "text", F.length("text").cast("long").alias("size"), F.xxhash64("id", "text").alias("h")).where("size > 0")
    if not with_text:
        sized = C.cut(sized.drop("text"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # rows that are repeated in full have one hash, so the row's number takes part
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(C.buckets(total, BUCKET))))
    schema = f"bucket long, bin long, doc_ids array<{kind}>, starts array<long>, lengths array<long>, filled long" + ", texts array<string>" * with_text
    return sized.groupBy("bucket").applyInArrow(_bucket(capacity, with_text), schema)
