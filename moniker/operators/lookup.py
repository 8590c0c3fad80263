"""Fuzzy lookup of strings among known names.

Candidates within two edits are found by an equi-join of deletion neighbourhoods (all beginnings with up to two characters left out), which is
complete for edits with swaps of neighbours; only those pairs are verified. Similarities are computed once for each distinct pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.keys import name_key, parts
from ..functions.lattice import common_schema
from ..functions.phonetic import metaphone_code
from ..functions.similarity import best_ratio, jaro_similarity, osa_distance
from .clusters import caption

BOOSTS = {"key": 3.0, "name": 2.0, "alias": 1.0}
PHONETIC_BOOST = 0.5


PREFIX = 20


def deletions(s: Column) -> Column:
    """Hashes of all strings that the first PREFIX characters of s become when up to two of them are left out: 211 at most.

    Strings within two edits share one. Edits before the cut are undone by leaving out at most one character each on either side; where they shift the
    cut, what one side has more before it is left out at its end, which takes no more than the two.
    """
    s = F.substring(s, 1, PREFIX)
    without = lambda x, i: F.when(i == 0, x).otherwise(F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
    one = F.transform(F.sequence(F.lit(0), F.length(s)), lambda i: F.struct(i.alias("i"), without(s, i).alias("s")))
    two = F.transform(one, lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.length(x["s"])), lambda j: (j == 0) | (j >= x["i"])), lambda j: F.xxhash64(without(x["s"], j))))
    return F.array_distinct(F.flatten(two))


def terms(cluster_rows: DataFrame) -> DataFrame:
    """field, term, key: what queries are compared with."""
    of = lambda field, c: F.transform(c, lambda x: F.struct(F.lit(field).alias("field"), x.alias("term")))
    return cluster_rows.select("key", F.explode(F.concat(of("key", F.array("key")), of("name", F.col("names")), of("alias", F.col("aliases")))).alias("t")).select("t.field", "t.term", "key")


def fuzzy(queries: DataFrame, cluster_rows: DataFrame) -> DataFrame:
    """clean_q, key, score: boosts of the fields with a value within two edits of the cleaned query."""
    left = queries.select("clean_q").distinct().withColumn("v", F.explode(deletions(F.col("clean_q"))))
    right = terms(cluster_rows).withColumn("v", F.explode(deletions(F.col("term"))))
    pairs = left.join(right, "v").select("clean_q", "term", "key", "field").distinct().withColumn("d", F.levenshtein("clean_q", "term", 4)).where("d >= 0")
    # two edits without swaps are decided natively; each swap counts two there, so only 3 and 4 need the other metric
    swaps = lambda c: F.when(F.col("d") > 2, F.col(c))
    near = pairs.withColumn("o", osa_distance(swaps("clean_q"), swaps("term"))).where("d <= 2 or o <= 2")
    score = reduce(Column.__add__, [F.max(F.when(F.col("field") == f, F.lit(x)).otherwise(0.0)) for f, x in BOOSTS.items()])
    return near.groupBy("clean_q", "key").agg(score.alias("score"))


def phonetic(queries: DataFrame, code_postings: DataFrame, code: Callable[[Column], Column] = metaphone_code) -> DataFrame:
    """query, key, score: half the BM25 of shared phonetic codes (J2, R2). `code` is what the postings were made with."""
    q = queries.select("query", F.explode(F.array_distinct(parts(F.col("query")))).alias("part"))
    codes = q.select("part").distinct().withColumn("code", code(F.col("part"))).where("code <> ''")
    q = q.join(codes, "part").select("query", "code").distinct()
    sizes = code_postings.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_all"), F.avg("len").alias("avg_len"))
    df = code_postings.groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = code_postings.join(df, "code").join(sizes, "key").crossJoin(totals).select("code", "key", (idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))).alias("w"))
    return q.join(w, "code").groupBy("query", "key").agg(F.round(PHONETIC_BOOST * F.sum("w"), 6).alias("score"))


def cleaned(queries: DataFrame, settings: Settings) -> DataFrame:
    """Distinct queries with their cleaned form, those that are long enough (P5)."""
    return queries.select("query").where("query is not null").distinct().withColumn("clean_q", name_key(F.col("query"))).where(F.length("clean_q") >= max(1, settings.min_length))


def ranked(queries: DataFrame, cluster_rows: DataFrame, code_postings: DataFrame | None = None, *, schemata: list[str] | None = None, settings: Settings = Settings(), code: Callable[[Column], Column] = metaphone_code) -> DataFrame:  # noqa: B008
    """query, clean_q, key, score, rank of the best clusters (L1). With schemata all clusters of any of them are candidates, scores only rank them."""
    q = cleaned(queries, settings)
    scored = q.join(fuzzy(q, cluster_rows), "clean_q").select("query", "clean_q", "key", "score")
    if code_postings is not None:
        scored = scored.unionByName(q.join(phonetic(q, code_postings, code), "query").select("query", "clean_q", "key", "score"))
        scored = scored.groupBy("query", "clean_q", "key").agg(F.round(F.sum("score"), 6).alias("score"))
    if schemata:
        may = cluster_rows.where(F.arrays_overlap("schemata", F.array(*[F.lit(s) for s in schemata]))).select("key")
        # of those that score nothing only the least keys can be among the best, no more than the limit
        idle = q.crossJoin(F.broadcast(may.orderBy("key").limit(settings.limit))).withColumn("score", F.lit(0.0))
        scored = scored.join(may, "key", "left_semi").unionByName(idle).groupBy("query", "clean_q", "key").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= settings.limit).select("query", "clean_q", "key", "score", "rank")


def lookup(queries: DataFrame, cluster_rows: DataFrame, code_postings: DataFrame | None = None, *, threshold: float | None = None, schemata: list[str] | None = None, fallback: bool = True, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """query, key, names, aliases, countries, schemata, score, common_schema, caption of the first acceptable cluster of each query that has one.

    First in order of rank is the one whose key is similar enough to the cleaned query (L3); for queries without one, the
    first with a name whose key is (L4). Similar enough is above the threshold, not at it.
    """
    least = settings.fuzzy_threshold if threshold is None else threshold
    best = ranked(queries, cluster_rows, code_postings, schemata=schemata, settings=settings).drop("score")
    rows = best.withColumn("score", jaro_similarity("clean_q", "key"))
    if fallback:
        rows = rows.withColumn("hit", F.max(F.col("score") > least).over(Window.partitionBy("query"))).where((F.col("score") > least) | ~F.col("hit"))
        rows = rows.join(cluster_rows, "key")
        named = F.when(~F.col("hit"), F.transform("names", name_key))
        rows = rows.withColumn("score", F.when(F.col("hit"), F.col("score")).otherwise(best_ratio("clean_q", named) / 100))
    else:
        rows = rows.where(F.col("score") > least).join(cluster_rows, "key")
    found = F.struct("key", "names", "aliases", "countries", "schemata", F.round("score", 6).alias("score"))
    hits = rows.where(F.col("score") > least).groupBy("query").agg(F.min_by(found, "rank").alias("h")).select("query", "h.*")
    return hits.withColumns({"common_schema": common_schema(F.col("schemata")), "caption": caption(F.col("names"))})
