"""Secret scans by corpus-wide ownership frequency.

Candidates are what looks like a credential: well-known key forms, and long values that are assigned to names such as token, key, secret or
password, without full stops at their end. Each is hashed where it is found, and the whole corpus is aggregated by hash: in how many documents, repositories
and owners does it occur? A candidate that is low in variety or spells a placeholder is a dummy; one of many owners (EXAMPLE_OWNERS or more), or of several
(FEW_OWNERS) in many repositories (EXAMPLE_REPOS), is a widely copied example; what is left belongs to few and looks live. A scan
shuffles and writes only hashes, never texts or values; redact() shuffles the texts that it changes.

Defined results: null and empty texts have no candidates; all null owners are one owner, null repositories one repository. A candidate
that occurs repeatedly in a document, and a repeated row, count once for numbers of documents (by id), owners and repositories. A null
id is an id. Credentials may have any length. Other columns don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

EXAMPLE_OWNERS, FEW_OWNERS, EXAMPLE_REPOS, LEAST_VARIETY = 8, 4, 16, 6
# forms that need no name, those that stand apart from words, a named value; but for the look behind none uses what Java's and RE2's syntax differ in. Lengths have no upper bound where
# the form sets none: what is cut off a credential would be counted as another one and stay in the text
FORMS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}"
# web tokens and sk- keys don't begin within a word: else a text of nothing but beginnings would be searched to its end from each, and risk-adjusted-return-on-capital would have a key
APART = r"(?:eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|sk-[A-Za-z0-9_-]{20,})"
NAMED = r"(?i:token|secret|passwd|password|api_?key|access_?key|auth_?key|credential|private_?key)[\"']{0,1}[ \t]{0,3}[:=][ \t]{0,3}[\"']{0,1}([A-Za-z0-9+/=_.-]{15,}[A-Za-z0-9+/=_-])"
DUMMY = r"(?i)example|placeholder|changeme|your_|xxxx|0000000|1234567|abcdefg"
REDACTED = "[SECRET]"


def candidates(text: Column) -> Column:
    """Distinct candidates of a text, as an array. Plain searches for what every match must have spare most texts the patterns."""
    none = F.array().cast("array<string>")
    has = lambda *xs: reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in xs])
    forms = F.when(has("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza"), F.regexp_extract_all(text, F.lit(f"(?:{FORMS})"), F.lit(0))).otherwise(none)
    apart = F.when(has("eyJ", "sk-"), F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9_-]){APART}"), F.lit(0))).otherwise(none)
    named = F.when(has("=", ":"), F.regexp_extract_all(text, F.lit(NAMED), F.lit(1))).otherwise(none)
    return F.array_distinct(F.concat(forms, apart, named))


def _found(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo: Column | None) -> DataFrame:
    """id, owner, repo, secret_hash, n_chars, dummy, and a hash of the text, of each candidate in each row."""
    C.ready(docs.sparkSession)
    d = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), docs[f"`{owner_col}`"].alias("owner"), (docs[f"`{owner_col}`"] if repo is None else repo).alias("repo"))
    d = d.select("id", "owner", "repo", F.xxhash64("text").alias("of"), F.explode(candidates(F.col("text"))).alias("value"))
    dummy = F.col("value").rlike(DUMMY) | (F.size(F.array_distinct(F.split("value", ""))) < LEAST_VARIETY)
    return d.select("id", "owner", "repo", "of", F.md5("value").alias("secret_hash"), F.length("value").cast("long").alias("n_chars"), dummy.alias("dummy"))


def _judged(found: DataFrame) -> DataFrame:
    """A row a candidate, with its verdict."""
    present = lambda c: F.countDistinct(F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")))
    h = found.groupBy("secret_hash", "n_chars", "dummy").agg(present("id").alias("n_docs"), present("repo").alias("n_repos"), present("owner").alias("n_owners"))
    many = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_owners") >= FEW_OWNERS) & (F.col("n_repos") >= EXAMPLE_REPOS)
    return h.select("secret_hash", "n_chars", "n_docs", "n_repos", "n_owners", F.when(F.col("dummy"), "dummy").when(many, "example").otherwise("live").alias("verdict"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo: Column | None = None) -> DataFrame:
    """id_col, secret_hash, n_chars, n_docs, n_repos, n_owners and verdict of each candidate in each document (by id); the value itself is not shown."""
    found = C.cut(_found(docs, id_col, text_col, owner_col, repo))
    each = found.select("id", "secret_hash").distinct().join(_judged(found), "secret_hash")
    return each.select(F.col("id").alias(id_col), "secret_hash", "n_chars", "n_docs", "n_repos", "n_owners", "verdict")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo: Column | None = None) -> DataFrame:
    """The input with live-looking secrets replaced in the texts; other rows and columns stay as they are, repeated rows included.

    What is judged live depends on the whole corpus, so all texts are searched once for that. Then a Bloom filter of hashes of the texts with a live one lets the other rows
    pass as they are; only what is left is searched again, and joined with its own live values by the text's hash.
    """
    found = C.cut(_found(docs, id_col, text_col, owner_col, repo))
    live = C.cut(_judged(found).where("verdict = 'live'").select("secret_hash"))
    having = C.cut(found.join(live, "secret_hash", "left_semi").select("of").distinct())
    key, of, values = (C.free(docs, x) for x in ("secret_text", "secret_of", "secret_values"))
    text, columns = F.col(f"`{text_col}`"), [f"`{c}`" for c in docs.columns]
    may, others = C.sieve(docs.withColumn(key, F.xxhash64(text)), F.col(key), having)
    each = may.select(F.col(key).alias(of), F.explode(candidates(text)).alias("value")).distinct().withColumn("secret_hash", F.md5("value")).join(live, "secret_hash")
    per = each.groupBy(of).agg(F.collect_set("value").alias(values))
    # longer values first, so that none hides within another
    longest = F.reverse(F.array_sort(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    clean = F.aggregate(longest, text, lambda t, v: F.replace(t, v["v"], F.lit(REDACTED)))
    done = may.join(per, F.col(key) == F.col(of), "left")
    return others.select(columns).unionByName(done.select(*[clean.alias(x) if x == text_col else F.col(f"`{x}`") for x in docs.columns]))


_QUOTED = NAMED.replace("'", "''")
SQL = f"""
with found as (
  select distinct doc_id, source, lang, value from (
    select doc_id, source, lang, unnest(list_concat(regexp_extract_all(text, '(?:{FORMS})'), regexp_extract_all(text, '(?:^|[^A-Za-z0-9_-])({APART})', 1), regexp_extract_all(text, '{_QUOTED}', 1))) as value from documents)
), judged as (
  select value, count(distinct coalesce('1' || doc_id, '0')) as n_docs, count(distinct concat_ws('/', source, lang)) as n_repos, count(distinct coalesce('1' || source, '0')) as n_owners
  from found group by value)
select distinct doc_id, md5(value) as secret_hash, length(value) as n_chars, n_docs, n_repos, n_owners,
       case when regexp_matches(value, '{DUMMY}') or len(list_distinct(string_split(value, ''))) < {LEAST_VARIETY} then 'dummy'
            when n_owners >= {EXAMPLE_OWNERS} or n_owners >= {FEW_OWNERS} and n_repos >= {EXAMPLE_REPOS} then 'example' else 'live' end as verdict
from found join judged using (value)
"""
