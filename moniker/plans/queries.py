"""The name library's queries by operator (ids of the survey's section 2), each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import keys, scan, text
from ..functions.lattice import common_schema
from ..functions.phonetic import metaphone_code
from ..functions.similarity import fuzzy_ratio
from ..operators import clusters as K
from ..operators import compare, extract, lookup, percolate
from ..sources import writers
from ..sources.readers import allowed, entities, names, spread
from . import gazetteer as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _flat(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return G.clusters_of(G.benchmark_entities(spark, sf))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return G.clusters_of(G.part_entities(spark, sf))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(G.read(spark, sf, "documents").select("doc_id", "text"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(_docs(spark, sf), extract.patterns(_clusters(spark, sf)))


def _percolated(spark: SparkSession, sf: str, slop: int) -> DataFrame:
    c = _clusters(spark, sf)
    return percolate.percolate(_docs(spark, sf), c, K.postings(c), slop)


@_query
def scan_names_filter(spark: SparkSession, sf: str) -> DataFrame:
    """S1, P1."""
    return allowed(G.part_entities(spark, sf)).select("id", "schema", F.col("properties")["name"][0].alias("name"))


@_query
def entity_unpack(spark: SparkSession, sf: str) -> DataFrame:
    """A1, P2 to P4, F12."""
    return K.unpack(G.benchmark_entities(spark, sf)).select("key", "schema", _flat("names"), _flat("aliases"), _flat("countries"))


@_query
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    return _docs(spark, sf).select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded_md5"))


@_query
def tokenize_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """F2 over all tokens."""
    return scan.tokens(_docs(spark, sf))


@_query
def token_forms(spark: SparkSession, sf: str) -> DataFrame:
    """F3, F4."""
    t = G.read(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.size(text.forms(F.col("text"))).cast("long").alias("n_forms"), F.md5(text.phrase(F.col("text"))).alias("phrase_md5"))


@_query
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """F5 of customers' and suppliers' names."""
    n = G.read(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(G.read(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return n.select("name", keys.name_key(F.col("name")).alias("key"))


@_query
def name_key_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """A3, F5."""
    return _parts(spark, sf).select("key", _flat("names"), _flat("aliases"), _flat("countries"), _flat("schemata"))


@_query
def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A2, K1."""
    return K.facts(K.unpack(allowed(G.part_entities(spark, sf))))


@_query
def cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    return K.count(K.facts(K.unpack(allowed(G.part_entities(spark, sf)))))


@_query
def cluster_point_get(spark: SparkSession, sf: str) -> DataFrame:
    """One cluster by its key."""
    return K.scan(_parts(spark, sf), "red ring").select("key", _flat("names"), _flat("schemata"))


@_query
def cluster_features_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A5, P11, L7."""
    return K.features(_parts(spark, sf)).select("key", _flat("tokens"))


@_query
def names_union(spark: SparkSession, sf: str) -> DataFrame:
    """U1."""
    c = _parts(spark, sf)
    return c.select("key", F.explode(K.all_names(c)).alias("name"))


@_query
def accumulate_loads(spark: SparkSession, sf: str) -> DataFrame:
    """U4: facts of both gazetteers, one loaded twice."""
    load = lambda e: K.facts(K.unpack(allowed(e)))
    return K.accumulate(load(G.part_entities(spark, sf)), load(G.benchmark_entities(spark, sf)), load(G.part_entities(spark, sf)))


@_query
def common_schemata(spark: SparkSession, sf: str) -> DataFrame:
    """A6."""
    return _parts(spark, sf).select("key", common_schema(F.col("schemata")).alias("schema"))


@_query
def pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    """J7, P10, Q7."""
    return extract.patterns(_clusters(spark, sf)).select("pattern", F.col("n_tokens").cast("long").alias("n_tokens"), "schema")


@_query
def extract_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """J4 before verification."""
    c = extract.candidates(_docs(spark, sf), extract.patterns(_clusters(spark, sf)))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), "pattern")


@_query
def extract_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """J4, I1, I3 to I5."""
    return _found(spark, sf)


@_query
def extract_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The same over conversations' turns."""
    turns = G.read(spark, sf, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    return extract.extract(turns, extract.patterns(_clusters(spark, sf)))


@_query
def span_surface_vs_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The surface beside the text's own slice."""
    m = extract.slices(_docs(spark, sf), extract.patterns(_clusters(spark, sf)))
    return m.select("doc_id", "start", "text", "slice")


@_query
def percolate_block_msm(spark: SparkSession, sf: str) -> DataFrame:
    """J5, P11, P13, R3."""
    return percolate.blocked(_docs(spark, sf), K.postings(_clusters(spark, sf)))


@_query
def percolate_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """L2."""
    best = percolate.ranked(percolate.blocked(_docs(spark, sf), K.postings(_clusters(spark, sf))), 5)
    return best.select("doc_id", "key", F.col("rank").cast("long").alias("rank"))


@_query
def percolate_slop0(spark: SparkSession, sf: str) -> DataFrame:
    """I2 to I5, Q7, Q8."""
    return _percolated(spark, sf, 0)


@_query
def percolate_slop1(spark: SparkSession, sf: str) -> DataFrame:
    return _percolated(spark, sf, 1)


@_query
def percolate_slop2(spark: SparkSession, sf: str) -> DataFrame:
    return _percolated(spark, sf, 2)


@_query
def extract_intersect_percolate(spark: SparkSession, sf: str) -> DataFrame:
    """U2."""
    return compare.both(_found(spark, sf), _percolated(spark, sf, 0))


@_query
def extract_minus_percolate(spark: SparkSession, sf: str) -> DataFrame:
    """U3."""
    return compare.only_first(_found(spark, sf), _percolated(spark, sf, 0))


@_query
def percolate_minus_extract(spark: SparkSession, sf: str) -> DataFrame:
    """U3."""
    return compare.only_first(_percolated(spark, sf, 0), _found(spark, sf))


@_query
def mention_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A9."""
    return compare.stats(_found(spark, sf))


@_query
def lookup_exact(spark: SparkSession, sf: str) -> DataFrame:
    """L3, F8, P5, P9 for names as they are."""
    q = G.read(spark, sf, "part").select(F.upper("p_name").alias("query")).distinct()
    return lookup.lookup(q, _parts(spark, sf), fallback=False).select("query", "key", "score")


@_query
def lookup_fuzzy_key(spark: SparkSession, sf: str) -> DataFrame:
    """J1, F10, R1, A8."""
    q = lookup.cleaned(G.typos(spark, sf), Settings())
    return lookup.fuzzy(q, _parts(spark, sf))


@_query
def lookup_topk(spark: SparkSession, sf: str) -> DataFrame:
    """L1."""
    best = lookup.ranked(G.typos(spark, sf), _parts(spark, sf))
    return best.select("query", "key", "score", F.col("rank").cast("long").alias("rank"))


@_query
def lookup_jaro_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    """L3, F8, P9."""
    return lookup.lookup(G.typos(spark, sf), _parts(spark, sf), threshold=0.9, fallback=False).select("query", "key", "score", "common_schema")


@_query
def lookup_schema_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates are all clusters of the schema."""
    return lookup.lookup(G.typos(spark, sf), _parts(spark, sf), threshold=0.9, schemata=["PublicBody"], fallback=False).select("query", "key", "score")


@_query
def lookup_rerank_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """L4, F9; no SQL, as the ratio isn't SQL's."""
    return lookup.lookup(G.typos(spark, sf), _parts(spark, sf), threshold=0.96).select("query", "key", "score", "caption")


@_query
def lookup_phonetic(spark: SparkSession, sf: str) -> DataFrame:
    """J2, R2, F6."""
    c = _parts(spark, sf)
    return lookup.phonetic(lookup.cleaned(G.typos(spark, sf), Settings()), K.phonetic_postings(c))


def _skeleton(part: Column) -> Column:
    """A code that SQL has, too: the first letter and the consonants after it."""
    return F.concat(F.substring(part, 1, 1), F.regexp_replace(F.substring(part, 2, 1 << 30), "[aeiou]", ""))


@_query
def lookup_codes(spark: SparkSession, sf: str) -> DataFrame:
    """As lookup_phonetic, with a code that SQL has."""
    return lookup.phonetic(lookup.cleaned(G.typos(spark, sf), Settings()), K.phonetic_postings(_parts(spark, sf), _skeleton), _skeleton)


@_query
def lookup_codes_topk(spark: SparkSession, sf: str) -> DataFrame:
    """J1 and J2 together, R1, R2, L1, with the same code."""
    c = _parts(spark, sf)
    best = lookup.ranked(G.typos(spark, sf), c, K.phonetic_postings(c, _skeleton), code=_skeleton)
    return best.select("query", "key", "score", F.col("rank").cast("long").alias("rank"))


@_query
def phonetic_codes(spark: SparkSession, sf: str) -> DataFrame:
    """F6."""
    return K.postings(_parts(spark, sf)).select("token").distinct().withColumn("code", metaphone_code("token"))


@_query
def facet_filter_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations named after nations, those that are banks or limited companies."""
    return K.with_symbols(K.symbols(G.clusters_of(G.nation_entities(spark, sf))), ["ORG_CLASS:ltd", "SYMBOL:bank"]).select("key", _flat("symbols"), _flat("qids"))


@_query
def facet_filter_qid(spark: SparkSession, sf: str) -> DataFrame:
    """Of the same table's persons those of one given name."""
    return K.with_qid(K.symbols(G.clusters_of(G.nation_entities(spark, sf))), K.QIDS["jane"]).select("key", _flat("symbols"), _flat("qids"))


@_query
def fuzzy_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """F9 of queries and the keys that L1 ranks for them; no SQL, as the ratio isn't SQL's."""
    return lookup.ranked(G.typos(spark, sf), _parts(spark, sf)).select("query", "key", F.round(fuzzy_ratio("clean_q", "key"), 4).alias("ratio"))


@_query
def scan_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """Entities written as newline-delimited JSON and scanned again."""
    at = writers.scratch(spark)
    writers.entities_json(G.part_entities(spark, sf), at)
    return entities(spark, at).select("id", "schema", F.col("properties")["name"][0].alias("name"))


@_query
def scan_name_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A list of names, one a line."""
    at = writers.scratch(spark)
    G.read(spark, sf, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("value")).write.text(at)
    return names(spark, at, "Company").select("id", "schema", F.col("properties")["name"][0].alias("name"))


@_query
def caption_pick(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return _clusters(spark, sf).select("key", K.caption(F.col("names")).alias("caption"))
