"""Names out of the driver's tables, which have no entities of their own.

From `benchmark`: each item's first two and first three tokens are the names of two entities; the schema follows item_id modulo 4, the country
is the nation of item_id modulo 25; the longer one's alias is the shorter name in capitals. From `part`: p_name with p_brand as alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import originals
from ..operators import clusters as K
from ..sources.readers import allowed


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _properties(name: Column, alias: Column, country: Column) -> Column:
    return F.create_map(F.lit("name"), F.array(name), F.lit("alias"), F.when(alias.isNull(), F.array().cast("array<string>")).otherwise(F.array(alias)), F.lit("country"), F.array(country))


def benchmark_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", originals(F.col("text")).alias("t")).select("item_id", "t", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).where("size(t) >= k")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = F.element_at(F.array(*[F.lit(s) for s in ("Person", "Company", "PublicBody", "LegalEntity")]), (F.col("item_id") % 4 + 1).cast("int"))
    joined = lambda k: F.array_join(F.slice("t", 1, k), " ")
    rows = items.join(nation, F.col("item_id") % 25 == F.col("n_nationkey"))
    return rows.select(F.concat_ws("-", F.lit("b"), "item_id", "k").alias("id"), schema.alias("schema"), _properties(joined(F.col("k")), F.when(F.col("k") == 3, F.upper(joined(2))), F.col("n_name")).alias("properties"))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = F.element_at(F.array(*[F.lit(s) for s in ("Company", "Organization", "Vessel", "PublicBody")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    part = read(spark, sf_dir, "part")
    return part.select(F.concat_ws("-", F.lit("p"), "p_partkey").alias("id"), schema.alias("schema"), _properties(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("properties"))


FORMS = ("Bank", "Holding Ltd", "Group Inc", "International GmbH", "Trading Company")
GIVEN = ("Jane", "John", "Maria")


def nation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From `nation`: a company with one of FORMS after the nation's name, whose alias has the next one, and a person with one of GIVEN before it."""
    of = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    n, key, name = read(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_name")
    company = n.select(F.concat_ws("-", F.lit("c"), key).alias("id"), F.lit("Company").alias("schema"), _properties(F.concat_ws(" ", name, of(FORMS, key)), F.concat_ws(" ", name, of(FORMS, key + 1)), name).alias("properties"))
    person = n.select(F.concat_ws("-", F.lit("n"), key).alias("id"), F.lit("Person").alias("schema"), _properties(F.concat_ws(" ", of(GIVEN, key), name), F.lit(None).cast("string"), name).alias("properties"))
    return company.unionByName(person)


def clusters_of(entities: DataFrame) -> DataFrame:
    return K.clusters(K.facts(K.unpack(allowed(entities))))


def typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct `query`: part names without the character at 1 + p_partkey modulo their length."""
    i = (F.col("p_partkey") % F.length("p_name")).cast("int")
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(F.concat(name.substr(F.lit(1), i), name.substr(i + 2, F.length(name))).alias("query")).distinct()
