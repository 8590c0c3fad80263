"""Comparison of two sets of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..timing import took


def texts(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.lower("text").alias("text")).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return texts(a).intersect(texts(b))


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    return texts(a).exceptAll(texts(b))


def stats(mentions: DataFrame) -> DataFrame:
    return mentions.agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct(F.lower("text")).alias("n_texts"), F.countDistinct("doc_id").alias("n_docs"))


def sample(found: DataFrame, most: int = 30) -> DataFrame:
    """The first `most` texts, a report."""
    return found.orderBy("text").limit(most)


def head(found: DataFrame, most: int = 30) -> str:
    """The first `most` texts, a line each, and how many more there are."""
    lines = [r["text"] for r in sample(found, most).collect()]
    more = found.count() - len(lines)
    return "\n".join([f"  {x}" for x in lines] + [f"  ... {more} more"] * (more > 0))


def report(extracted: DataFrame, percolated: DataFrame, most: int = 30) -> str:
    """Extraction and percolation side by side (K9): numbers, seconds, and the texts that either or both have."""
    part = []
    for title, m in (("extract", extracted), ("percolate", percolated)):
        with took(title) as t:
            s = stats(m).first()
        part.append(f"{title}: {s['n_mentions']} mentions, {s['n_texts']} texts, {t.seconds:.1f} s")
    for title, t in (("both", both(extracted, percolated)), ("extract only", only_first(extracted, percolated)), ("percolate only", only_first(percolated, extracted))):
        part.append(f"{title}: {t.count()}\n{head(t, most)}".rstrip())
    return "\n".join(part)
