"""Dictionary extraction of name mentions.

Texts are read once. Where two tokens may begin a pattern, they leave their document with as many of the next as the longest pattern has and with their offsets;
these rows are joined with the patterns and verified, and what is true, little, is gathered by document and selected. Texts are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIN_TOKEN_COUNT, Settings
from ..functions import scan as S
from ..functions import text as X
from ..functions.lattice import common_schema
from .clusters import all_names


def patterns(cluster_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """pattern, n_tokens, first_bigram, schema: normalised names and aliases of at least two tokens and twice the least token length, each with
    the common schema of all clusters that have it."""
    rows = cluster_rows.select("schemata", F.explode(all_names(cluster_rows)).alias("name")).select("schemata", X.forms(F.col("name")).alias("t"))
    rows = rows.withColumn("pattern", F.array_join("t", " ")).where((F.size("t") >= MIN_TOKEN_COUNT) & (F.length("pattern") >= settings.min_token_length * MIN_TOKEN_COUNT))
    found = rows.groupBy("pattern").agg(common_schema(F.flatten(F.collect_set("schemata"))).alias("schema"))
    t = F.split("pattern", " ")
    return found.select("pattern", F.size(t).alias("n_tokens"), F.array_join(F.slice(t, 1, 2), " ").alias("first_bigram"), "schema")


def pair_of(t: Column) -> Column:
    return F.xxhash64(F.element_at(t, 1), F.element_at(t, 2))


def _met(docs: DataFrame, pattern_rows: DataFrame) -> DataFrame:
    """Rows of S.near() beside each pattern that begins with their first two tokens; the rest isn't verified yet."""
    p = pattern_rows.withColumn("_p", F.split("pattern", " "))
    width = p.agg(F.max("n_tokens")).first()[0] or MIN_TOKEN_COUNT
    found = S.near(docs, S.bits(p, S.pair_hash(F.col("_p"))), width)
    return found.withColumn("pair", pair_of(F.col("t"))).join(p.withColumn("pair", pair_of(F.col("_p"))), "pair").drop("pair", "first_bigram", "_p")


def candidates(docs: DataFrame, pattern_rows: DataFrame) -> DataFrame:
    """doc_id, pos, pattern, n_tokens, schema where a document's bigram at pos (from 0) begins a pattern; not yet verified."""
    return _met(docs, pattern_rows).select("doc_id", "pos", "pattern", "n_tokens", "schema")


def leftmost_longest(found: Column) -> Column:
    """Of array<struct<pos, n, ...>> those that a scan takes from left to right, the longest at each place first.

    A match begins two tokens after the last token of the one before at the earliest, as both would need the space between.
    """
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), (-x["n"]).alias("least"), x.alias("m")))), lambda x: x["m"])
    start = F.struct(F.lit(-2).alias("last"), F.slice(found, 1, F.lit(0)).alias("out"))
    step = lambda acc, x: F.when(x["pos"] > acc["last"] + 1, F.struct((x["pos"] + x["n"] - 1).alias("last"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    return F.aggregate(ordered, start, step)["out"]


def slices(docs: DataFrame, pattern_rows: DataFrame) -> DataFrame:
    """doc_id, text (the surface), start, end and schema of all mentions in documents doc_id, text; slice: what the document has from start to end."""
    n, end = F.col("n_tokens"), F.element_at("ends", F.col("n_tokens"))
    true = _met(docs, pattern_rows).where(F.array_join(F.slice("t", 1, n), " ") == F.col("pattern"))
    one = F.struct("pos", n.alias("n"), "schema", F.array_join(F.slice("o", 1, n), " ").alias("text"), "start", end.alias("end"), F.col("piece").substr(F.lit(1), end - F.col("start")).alias("slice"))
    rows = true.groupBy("doc", "doc_id").agg(F.collect_set(one).alias("found"))
    return rows.select("doc_id", F.explode(leftmost_longest(F.col("found"))).alias("m")).select("doc_id", "m.text", "m.start", "m.end", "m.schema", "m.slice")


def extract(docs: DataFrame, pattern_rows: DataFrame) -> DataFrame:
    """doc_id, text (the surface), start, end and schema of all mentions in documents doc_id, text."""
    return slices(docs, pattern_rows).drop("slice")
