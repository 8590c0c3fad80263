"""Entities to facts to clusters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COUNTRY_PROPERTIES, MIN_TOKEN_CHARS, NAME_PROPERTIES, PARENTS, SCHEMATA, Settings
from ..functions.keys import name_key, parts
from ..functions.phonetic import metaphone_code
from ..functions.text import forms


def _values(*properties: str) -> Column:
    """The distinct values of some properties, sorted; without nulls and empty strings."""
    of = lambda p: F.coalesce(F.col("properties")[p], F.array().cast("array<string>"))
    return F.array_sort(F.filter(reduce(F.array_union, [of(p) for p in properties]), lambda x: x.isNotNull() & (x != "")))


def unpack(entities: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """key, schema, names, aliases, countries of each entity with a usable caption.

    The caption is the first name as given, or where that is the name of a schema, the least of the names that isn't.
    """
    known = [*SCHEMATA, *PARENTS]
    given = F.filter(F.coalesce(F.col("properties")["name"], F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    rows = entities.where(F.size(_values(*NAME_PROPERTIES)) > 0).select(
        "schema", given.alias("given"), _values("name", "previousName").alias("names"), _values("alias").alias("aliases"), F.transform(_values(*COUNTRY_PROPERTIES), F.lower).alias("countries")
    )
    caption = F.when(F.size("given") > 0, F.element_at("given", 1))
    other = F.filter("names", lambda x: ~x.isin(*known))
    rows = rows.withColumn("caption", F.when(caption.isin(*known), F.when(F.size(other) > 0, F.element_at(other, 1))).otherwise(caption))
    rows = rows.where((F.length("caption") >= settings.min_caption_length) & ~F.col("caption").isin(*known))
    return rows.withColumn("key", name_key(F.col("caption"))).where("key <> ''").select("key", "schema", "names", "aliases", "countries")


def facts(unpacked: DataFrame) -> DataFrame:
    """Distinct (key, schema, kind, value) in long form (A2)."""
    kinds = (("name", "names"), ("alias", "aliases"), ("country", "countries"))
    of = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    pairs = F.flatten(F.array(*[of(kind, c) for kind, c in kinds]))
    return unpacked.select("key", "schema", F.explode(pairs).alias("f")).select("key", "schema", "f.kind", "f.value").dropDuplicates()


def accumulate(*loads: DataFrame) -> DataFrame:
    """Facts of several loads (U4)."""
    return reduce(DataFrame.unionByName, loads).dropDuplicates()


def clusters(fact_rows: DataFrame) -> DataFrame:
    """One row a key with sorted sets of names, aliases, countries and schemata (A3)."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))
    return fact_rows.groupBy("key").agg(of("name").alias("names"), of("alias").alias("aliases"), of("country").alias("countries"), F.array_sort(F.collect_set("schema")).alias("schemata"))


def count(fact_rows: DataFrame) -> DataFrame:
    """n_clusters, the exact number of distinct keys (A4)."""
    return fact_rows.agg(F.countDistinct("key").alias("n_clusters"))


def scan(cluster_rows: DataFrame, key: str | None = None) -> DataFrame:
    """All clusters by key (S8, L5), or the one with this key (S9), which is pushed down to the files."""
    return cluster_rows.orderBy("key") if key is None else cluster_rows.where(F.col("key") == key).limit(1)


def all_names(c: DataFrame) -> Column:
    """Distinct names and aliases."""
    return F.array_union("names", "aliases")


def postings(cluster_rows: DataFrame) -> DataFrame:
    """Distinct (token, key) of names and aliases, tokens of at least two characters."""
    toks = F.array_distinct(F.flatten(F.transform(all_names(cluster_rows), forms)))
    return cluster_rows.select("key", F.explode(F.filter(toks, lambda x: F.length(x) >= MIN_TOKEN_CHARS)).alias("token"))


def phonetic_postings(cluster_rows: DataFrame, code: Callable[[Column], Column] = metaphone_code) -> DataFrame:
    """Distinct (code, key) of names and aliases (A5, F6). Codes are computed once for each distinct part."""
    rows = cluster_rows.select("key", F.explode(F.array_distinct(F.flatten(F.transform(all_names(cluster_rows), parts)))).alias("part"))
    codes = rows.select("part").distinct().withColumn("code", code(F.col("part"))).where("code <> ''")
    return rows.join(codes, "part").select("code", "key").distinct()


def features(cluster_rows: DataFrame) -> DataFrame:
    """Clusters with their sorted tokens."""
    toks = F.array_sort(F.array_distinct(F.flatten(F.transform(all_names(cluster_rows), forms))))
    return cluster_rows.withColumn("tokens", F.filter(toks, lambda x: F.length(x) >= MIN_TOKEN_CHARS))


# a lexicon of our own from common usage; what else a full knowledge base would know is out of scope
_FORMS = "ltd inc corp co gmbh ag sa plc llc llp lp kg ev srl spa sarl sas bv nv ab as oy ooo ao zao ptyltd pvtltd spzoo gmbhcokg coop assn eg ltda"
_WORDS = "bank holding group international trading company fund trust foundation insurance investment capital energy oil gas steel mining shipping airlines media hotel university ministry council parliament court police army party church school hospital institute agency"
_PLACES = {"north": "north northern nord norte", "south": "south southern sud sur", "east": "east eastern ost este", "west": "west western ouest oeste", "europe": "europe european europa", "africa": "africa african afrika", "america": "america american", "asia": "asia asian", "germany": "germany german deutschland deutsche", "france": "france french francaise", "russia": "russia russian", "china": "china chinese", "japan": "japan japanese", "india": "india indian", "brazil": "brazil brasil"}
_NICKS = {"robert": "bob rob bobby", "william": "bill will billy", "elizabeth": "liz beth betty", "richard": "dick rick", "james": "jim jimmy", "john": "jack johnny", "michael": "mike", "thomas": "tom", "margaret": "meg peggy", "katherine": "kate kathy", "alexander": "alex sasha", "joseph": "joe", "edward": "ed ted", "anthony": "tony", "daniel": "dan", "benjamin": "ben", "samuel": "sam", "johannes": "hans", "josef": "sepp", "francisco": "paco"}
SYMBOLS = {x: f"ORG_CLASS:{x}" for x in _FORMS.split()} | {x: f"SYMBOL:{x}" for x in _WORDS.split() if x != "company"} | {w: f"LOCATION:{k}" for k, ws in _PLACES.items() for w in ws.split()} | {w: f"NICK:{k}" for k, ws in _NICKS.items() for w in ws.split()}
QIDS = {"jane": "Q4160311", "john": "Q4925477", "maria": "Q325872", "robert": "Q4927937", "william": "Q12344159", "anna": "Q666578"}


def symbols(cluster_rows: DataFrame) -> DataFrame:
    """Clusters with sorted symbols and qids of the parts of their names."""
    p = F.array_distinct(F.flatten(F.transform(all_names(cluster_rows), parts)))

    def look(table: dict[str, str]) -> Column:
        m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.array_sort(F.array_distinct(F.filter(F.transform(p, lambda x: m[x]), lambda x: x.isNotNull())))

    return cluster_rows.withColumn("symbols", look(SYMBOLS)).withColumn("qids", look(QIDS))


def with_symbols(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Clusters with any of the symbols."""
    return rows.where(F.arrays_overlap("symbols", F.array(*[F.lit(s) for s in wanted])))


def with_qid(rows: DataFrame, qid: str) -> DataFrame:
    """Clusters with this qid."""
    return rows.where(F.array_contains("qids", qid))


def caption(names: Column) -> Column:
    """The name with the least sum of edit distances to all names, the least of equals; null without names."""
    far = F.transform(names, lambda x: F.struct(F.aggregate(F.transform(names, lambda y: F.levenshtein(x, y)), F.lit(0), lambda a, b: a + b).alias("d"), x.alias("name")))
    return F.array_min(far)["name"]
