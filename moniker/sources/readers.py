"""Sources of names, entities and texts."""

from __future__ import annotations

import gzip
import json
import os
import sys
import urllib.request
import zlib
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_SCHEMA, SCHEMATA
from ..functions.text import strip
from ..schema import ENTITY, PATTERNS

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is so small that its files' row groups would leave most of them idle: from 1 MB to 16 MB a core, so this shuffle is bounded."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and 1 << 20 <= size < cores * (16 << 20) else df


def lines(spark: SparkSession, uri: str) -> DataFrame:
    """Lines of what the URI names as `value`: "-" is standard input, http(s) is read by the driver, all else by Spark."""
    whole = _by_driver(uri)
    return spark.read.text(uri) if whole is None else spark.createDataFrame([(x,) for x in whole.splitlines()], "value string")


def _by_driver(uri: str) -> str | None:
    """All of standard input or of what http(s) gives, unpacked where it is compressed, every character as it is; None for other URIs."""
    if uri == "-":
        return sys.stdin.buffer.read().decode() if hasattr(sys.stdin, "buffer") else sys.stdin.read()
    if not uri.startswith(("http://", "https://")):
        return None
    asked = urllib.request.Request(uri, headers={"Accept-Encoding": "gzip, deflate"})  # noqa: S310
    with urllib.request.urlopen(asked) as f:  # noqa: S310
        body, how = f.read(), (f.headers.get("Content-Encoding") or "").lower()
    if how in ("gzip", "x-gzip") or uri.endswith(".gz") and body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    elif how == "deflate":
        body = zlib.decompress(body)
    return body.decode()


def allowed(entities: DataFrame) -> DataFrame:
    """Entities of the schemata that are loaded (P1); exactly these, not what descends from them."""
    return entities.where(F.col("schema").isin(*SCHEMATA))


def entities(spark: SparkSession, uri: str | list[str]) -> DataFrame:
    """A scan of newline-delimited JSON entities; those not allowed are dropped at the scan."""
    if isinstance(uri, str) and (uri == "-" or uri.startswith(("http://", "https://"))):
        found = lines(spark, uri).select(F.from_json("value", ENTITY).alias("e")).select("e.*")
    else:
        found = spark.read.schema(ENTITY).json(uri)
    return allowed(found)


def names(spark: SparkSession, uri: str, schema: str | None = None) -> DataFrame:
    """A scan of names, one a line (S2): entities with one name each, without regard to the schemata that are loaded."""
    value = strip(F.col("value"))
    n = lines(spark, uri).select(value.alias("value")).where("value <> ''")
    return n.select(F.concat(F.lit("name-"), F.md5("value")).alias("id"), F.lit(schema or DEFAULT_SCHEMA).alias("schema"), F.create_map(F.lit("name"), F.array("value")).alias("properties"))


def _json(spark: SparkSession, uri: str) -> dict:
    """A small description, read whole."""
    whole = _by_driver(uri)
    return json.loads(whole) if whole is not None else json.loads(spark.read.text(uri, wholetext=True).first()["value"])


def _beside(uri: str, base: str) -> str:
    return uri if "://" in uri or uri.startswith("/") else f"{base.rsplit('/', 1)[0]}/{uri}" if "/" in base else uri


def dataset(spark: SparkSession, uri: str) -> DataFrame:
    """Entities of all resources of a dataset's description (S3)."""
    found = _json(spark, uri)
    urls = [_beside(r["url"], uri) for r in found.get("resources") or [] if r.get("url") and ("entities" in (r.get("name") or r["url"]) or "ftm" in r["url"])]
    return entities(spark, urls) if urls else spark.createDataFrame([], ENTITY)


def catalog(spark: SparkSession, uri: str) -> DataFrame:
    """Entities of all datasets of a catalogue that have a uri."""
    out = spark.createDataFrame([], ENTITY)
    for d in _json(spark, uri).get("datasets") or []:
        if d.get("uri"):
            out = out.unionByName(dataset(spark, _beside(d["uri"], uri)))
    return out


def from_rows(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Single entities as a table."""
    return spark.createDataFrame([(r["id"], r["schema"], {k: list(v) for k, v in r["properties"].items()}) for r in rows], ENTITY)


def document(spark: SparkSession, uri: str) -> DataFrame:
    """The whole input as one document, doc_id 0 (S7), every character as it is, so that offsets are the input's."""
    whole = _by_driver(uri)
    if whole is not None:
        return spark.createDataFrame([(0, whole)], "doc_id long, text string")
    return spark.read.text(uri, wholetext=True).select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text"))


def patterns_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Patterns out of lines pattern TAB schema; lines without a tab are ignored."""
    pair = F.split("value", "\t", 2)
    found = spark.read.text(path).where(F.col("value").contains("\t")).select(pair[0].alias("pattern"), pair[1].alias("schema"))
    t = F.split("pattern", " ")
    return found.select("pattern", F.size(t).alias("n_tokens"), F.array_join(F.slice(t, 1, 2), " ").alias("first_bigram"), "schema").to(spark.createDataFrame([], PATTERNS).schema)
