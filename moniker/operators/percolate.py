"""Reverse search of documents against all stored names, with gaps.

A name occurs where its tokens come in order with at most `slop` other tokens between them in all. Documents' pairs of near tokens meet the names' first two; where
they agree the rest is verified within the document. Of documents with any such place the distinct tokens meet the clusters' postings; clusters that share enough
tokens are ranked by BM25, and places of the best ones' names are mentions. So only few documents are ranked, and no row holds all of a document's clusters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MIN_TOKEN_CHARS, MIN_TOKEN_COUNT, Settings
from ..functions import scan as S
from ..functions import text as X
from ..functions.lattice import common_schema
from .extract import pair_of

K1, B = 1.2, 0.75


def weights(posting_rows: DataFrame) -> DataFrame:
    """token, key, w: what a token adds to the BM25 score of a cluster."""
    sizes = posting_rows.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_all"), F.avg("len").alias("avg_len"))  # one row
    df = posting_rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = posting_rows.join(df, "token").join(sizes, "key").crossJoin(totals)
    idf = F.log(1 + (F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return weighted.select("token", "key", (idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).alias("w"))


def _least(settings: Settings) -> int:
    return max(1, settings.percolate_min_should_match)


def blocked(docs: DataFrame, posting_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, key, n_shared of pairs that share enough distinct tokens (P13), with their BM25 score to 6 digits."""
    return _scored(S.known(docs, S.bits(posting_rows, S.hash_of(F.col("token")))), posting_rows, settings)


def _scored(known: DataFrame, posting_rows: DataFrame, settings: Settings) -> DataFrame:
    d = known.where(F.size("t") >= _least(settings)).select("doc_id", F.explode("t").alias("token"))
    pairs = d.join(weights(posting_rows), "token").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_shared"), F.round(F.sum("w"), 6).alias("score"))
    return pairs.where(F.col("n_shared") >= _least(settings))


def ranked(pairs: DataFrame, limit: int) -> DataFrame:
    """The best `limit` clusters of each document with their rank (L2); of equal scores the least key first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "key")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def follow(t: Column, name: Column, at: Column, slop: int) -> Column:
    """The place (from 0) of the last token of `name` where its first is at `at` of t and the others follow, each as early as may be, with at most `slop` tokens
    between; null if they don't. The slice bounds what is passed over."""
    n = F.size(name)
    state = F.struct(F.lit(1).alias("k"), at.alias("at"), at.alias("last"))

    def step(s: Column, x: Column) -> Column:
        hit = (s["k"] < n) & (x == F.element_at(name, F.least(s["k"] + 1, n)))
        return F.struct((s["k"] + hit.cast("int")).alias("k"), (s["at"] + 1).alias("at"), F.when(hit, s["at"] + 1).otherwise(s["last"]).alias("last"))

    end = F.aggregate(F.slice(t, at + 2, n + F.lit(slop - 1)), state, step)
    return F.when((F.element_at(t, at + 1) == F.element_at(name, 1)) & (end["k"] == n), end["last"])


def occurrences(docs: DataFrame, named: DataFrame, slop: int, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, known, text, start, end and the columns of named for each occurrence of a name (of two tokens or more)."""
    width = named.agg(F.max(F.size("toks"))).first()[0] or MIN_TOKEN_COUNT
    found = S.near(docs, S.bits(named, S.pair_hash(F.col("toks"))), width + slop, slop, vocabulary)
    second = F.explode(F.array_distinct(F.slice("t", 2, slop + 1)))
    found = found.where(F.size("t") > 1).select("*", second.alias("_2")).withColumn("pair", F.xxhash64(F.element_at("t", 1), "_2"))
    met = found.join(named.withColumn("pair", pair_of(F.col("toks"))), "pair").drop("pair", "_2")
    last = follow(F.col("t"), F.col("toks"), F.lit(0), slop)
    hits = met.withColumn("last", last).where("last is not null")
    n = F.col("last") + 1
    return hits.select("doc_id", "known", F.array_join(F.slice("o", 1, n), " ").alias("text"), "start", F.element_at("ends", n).alias("end"), *named.columns)


def percolate(docs: DataFrame, cluster_rows: DataFrame, posting_rows: DataFrame, slop: int = 0, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, text (the surface, gaps included), start, end and schema of all mentions; a span has the label of its best-ranked cluster."""
    named = cluster_rows.select("key", common_schema(F.col("schemata")).alias("schema"), F.explode(F.concat(F.transform("names", lambda x: F.struct(F.lit(0).alias("is_alias"), x.alias("name"))), F.transform("aliases", lambda x: F.struct(F.lit(1).alias("is_alias"), x.alias("name"))))).alias("n"))
    named = named.select("key", "schema", "n.is_alias", "n.name", X.forms(F.col("n.name")).alias("toks")).where(F.size("toks") >= MIN_TOKEN_COUNT)
    vocabulary = S.bits(posting_rows, S.hash_of(F.col("token")))
    limit = settings.percolate_block_limit
    if posting_rows.select("key").distinct().limit(limit + 1).count() <= limit:
        hits = _all_ranked(docs, named, posting_rows, slop, vocabulary, settings)
    else:
        hits = _best_ranked(docs, named, posting_rows, slop, vocabulary, settings)
    first = F.min_by(F.struct("text", "schema"), F.struct("rank", "is_alias", "name"))
    return hits.groupBy("doc_id", "start", "end").agg(first.alias("m")).select("doc_id", "m.text", "start", "end", "m.schema")


def _all_ranked(docs: DataFrame, named: DataFrame, posting_rows: DataFrame, slop: int, vocabulary: np.ndarray, settings: Settings) -> DataFrame:
    """Occurrences of clusters that share enough tokens, where all clusters are within the limit: a cluster is scored where it occurs, and its rank is that of score and key."""
    w = weights(posting_rows).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("w"))
    hits = occurrences(docs, named.join(w, "key"), slop, vocabulary).withColumn("w", F.filter("w", lambda x: F.array_contains("known", x["token"])))
    score = F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x["w"]), 6)
    return hits.where(F.size("w") >= _least(settings)).withColumn("rank", F.struct((-score).alias("less"), "key"))


def _best_ranked(docs: DataFrame, named: DataFrame, posting_rows: DataFrame, slop: int, vocabulary: np.ndarray, settings: Settings) -> DataFrame:
    """Occurrences of the best clusters up to the limit; only documents with any occurrence are ranked."""
    hits = occurrences(docs, named, slop, vocabulary)
    known = hits.select("doc_id", F.array_sort("known").alias("t")).distinct()
    best = ranked(_scored(known, posting_rows, settings), settings.percolate_block_limit).select("doc_id", "key", "rank")
    return hits.join(best, hits["doc_id"].eqNullSafe(best["doc_id"]) & (hits["key"] == best["key"])).drop(best["doc_id"], best["key"])
