"""Helpers that the corpus operators share: cutting lineage, unique internal names, vectorised text."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import ready, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(ready(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir or set by setCheckpointDir. Where neither is set, a temporary one, if all
    runs on this machine; on a cluster that is an error, as executors wouldn't see each other's files."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there:
        return there
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='moniker-')}"
    return _LOCAL[sc.applicationId]


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back, so that lost executors cost no recomputation.

    The table goes by discard(), or when the JVM of the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() gave, once nothing that is still to run reads them."""
    for df in tables:
        files, at = _path(df.sparkSession, df._cut)
        files.delete(at, True)


def free(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it (names are compared without regard to case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


SIEVE_BITS = 1 << 26


def sieve(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows whose key (a hash of 64 bits) may be among those of `wanted`, a table of one column, and rows whose key surely isn't.

    So that a join with `wanted` needn't shuffle the second. A Bloom filter decides, of 16 to 32 bits a key and SIEVE_BITS (8 MB) at most, the size of what is
    broadcast; with more keys than that holds (about 20 million) all rows are in the first part, and the join gives the same.
    """
    spark, name = df.sparkSession, wanted.columns[0]
    n = wanted.count()
    size = 1 << max(16, min(SIEVE_BITS.bit_length() - 1, (16 * n).bit_length()))
    if 3 * n > size:
        return df, df.where(F.lit(False))
    place = lambda k: (k.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(size - 1)))
    words = wanted.select(F.explode(F.array(*place(F.col(name)))).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    held = free(df, "sieve_bits")
    one = F.broadcast(spark.createDataFrame(pa.table({held: pa.array([bits], pa.list_(pa.int64()))})))
    true = lambda p: F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    may = reduce(Column.__and__, map(true, place(key)))
    return df.join(one, may, "left_semi"), df.join(one, may, "left_anti")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: other columns of the input can't clash with them."""
    return df.select(*[df[f"`{name}`"].alias(alias) for alias, name in columns.items()])


def buckets(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) from hashed uint64."""
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices batches so that the texts of a slice have about most_bytes bytes; no text is cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = np.cumsum(sizes) // most_bytes
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
            yield batch.slice(int(a), int(b - a))


def text_buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets into them; a null text counts as empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if strings.null_count:
        strings = pc.fill_null(strings, "")
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if data is None or not len(strings):
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


_R = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and its inverse modulo 2**64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            size = max(1 << 16, 1 << int(n + 1).bit_length())
            inverse = pow(_R, -1, 1 << 64)
            up, down = np.full(size, _R, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for many spans, from one pass of prefix sums."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words of each text, a word being a run of letters, digits and other bytes above ASCII.

    Gives bytes in which one space follows each word, starts and ends of words in them, and n + 1 offsets of the texts'
    words.
    """
    raw, offs = text_buffer(pc.utf8_lower(pc.fill_null(strings, "")))
    is_word = _WORD[raw]
    after = np.zeros(len(raw) + 1, bool)
    after[1:] = is_word
    inner = offs[1:-1]
    after[inner] = False  # words don't run over texts
    first = is_word & ~after[:-1]
    starts = np.flatnonzero(first)
    ends_mask = np.zeros(len(raw) + 1, bool)
    ends_mask[:-1] = ~is_word
    ends_mask[offs] = True
    last = is_word & ends_mask[1:]
    ends = np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, offs)
    lengths = ends - starts
    out_start = np.cumsum(np.r_[0, lengths + 1])[:-1] if len(starts) else np.zeros(0, np.int64)
    data = np.full(int((lengths + 1).sum()), 32, np.uint8)
    if len(starts):
        keep = np.flatnonzero(is_word)
        data[keep - np.repeat(starts - out_start, lengths)] = raw[keep]
    return data, out_start, out_start + lengths, counts


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = True


def total_rows(df: DataFrame) -> int:
    return df.select(F.lit(1)).count()
