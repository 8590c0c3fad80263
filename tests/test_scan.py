"""Documents are tokenized once, as text.py's columns do, and their texts are never moved."""

from __future__ import annotations

import random
import re
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moniker.config import Settings
from moniker.functions import scan, text
from moniker.operators import clusters as K
from moniker.operators import extract, percolate
from moniker.plans.queries import QUERIES

from .harness import DATA

# letters of Unicode versions after 13, that of Java 17, are no letters in the JVM
CODES = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def made(spark, texts):
    return spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))


def test_every_character_is_as_in_columns(spark):
    texts = [f"a{chr(c)}b {chr(c)}" for c in CODES]
    got = made(spark, texts).repartition(4).select("doc_id", text.fold(F.col("text")).alias("f"), text.raw_forms(F.col("text")).alias("r")).toArrow().sort_by("doc_id")
    for c, s, f, r in zip(CODES, texts, got["f"].to_pylist(), got["r"].to_pylist(), strict=True):
        assert len(scan.places(s)[0]) == len(scan.raw_forms(s)), hex(c)
        if (scan.fold(s), scan.raw_forms(s)) != (f, r):
            assert spark.range(1).select(F.expr(f"java_method('java.lang.Character', 'getType', {c})")).first()[0] == "0", hex(c)


def test_tokens_are_as_in_columns(spark):
    r = random.Random(3)
    texts = ["", " ", "-", "'-' --", "Smith-, 'Jr' - Élan", None, "İ ’s’ d’Arc", "한국 ガッコー", "ὈΔΥΣΣΕΎΣ ßen", *["".join(r.choice("ab'- é’ß한\U0001f600\n_9́Σ") for _ in range(r.randint(1, 60))) for _ in range(400)], "x " * 3000]
    df = made(spark, texts)
    want = text.tokens(df.where("text is not null")).select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.original", "t.form", "t.start", "t.end")
    assert sorted(map(tuple, scan.tokens(df).collect())) == sorted(map(tuple, want.collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = r"FileScan parquet \[doc_id#\d+L,text#\d+\]"


@pytest.mark.parametrize("name", ["percolate_slop0", "percolate_slop1", "percolate_slop2", "percolate_block_msm", "percolate_bm25_topk", "extract_mentions", "mention_stats", "span_surface_vs_slice", "tokenize_offsets"])
def test_texts_are_read_once_and_stay(spark, name):
    p = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert len(re.findall(TEXTS, p)) == 1
    at = p[: re.search(TEXTS, p).start()].splitlines()
    assert "MapInArrow" in "".join(at[-5:])  # nothing but filters and projections between
    assert "Exchange" not in p[p.rindex("MapInArrow", 0, re.search(TEXTS, p).start()) : re.search(TEXTS, p).start()]


@pytest.mark.parametrize("name", ["extract_intersect_percolate", "extract_minus_percolate", "percolate_minus_extract"])
def test_texts_are_read_once_by_either_side(spark, name):
    assert len(re.findall(TEXTS, plan(QUERIES[name](spark, f"{DATA}/sf0.001")))) == 2


def gazetteer(spark):
    names = [["aa bb"], ["aa bb cc"], ["bb cc aa aa"], ["cc cc"], ["dd aa"], ["aa-bb 'dd'", "bb aa"]]
    return spark.createDataFrame([(f"k{i}", n, [n[0].upper()], [], ["Person" if i % 2 else "Company"]) for i, n in enumerate(names)], "key string, names array<string>, aliases array<string>, countries array<string>, schemata array<string>")


def texts(spark, n=80):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["aa", "BB", "cc,", "dd", "-", "aa-bb"]) for _ in range(r.randint(0, 16)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (None, "aa bb cc"), (None, "dd aa")], "doc_id long, text string")


@pytest.mark.parametrize("limit", [2])
def test_limit_on_ranked_clusters(spark, limit):
    """With fewer ranked than there are clusters: only those that rank so high are found, and else the same as without a limit."""
    df, c = texts(spark).where("doc_id is not null"), gazetteer(spark)
    p, every = K.postings(c), Settings(percolate_min_should_match=1)
    rank = {(x["doc_id"], x["key"]): x["rank"] for x in percolate.ranked(percolate.blocked(df, p, every), 100).collect()}
    key, want = {}, set()
    for k in [x["key"] for x in c.collect()]:
        one = c.where(F.col("key") == k)
        for m in percolate.percolate(df, one, p, 1, every).collect():
            if rank[m["doc_id"], k] <= limit:
                at = (m["doc_id"], m["start"], m["end"])
                key[at] = min(key.get(at, (99, "")), (rank[m["doc_id"], k], m["schema"]))
    want = {(*at, schema) for at, (_, schema) in key.items()}
    got = percolate.percolate(df, c, p, 1, Settings(percolate_min_should_match=1, percolate_block_limit=limit)).collect()
    assert {(m["doc_id"], m["start"], m["end"], m["schema"]) for m in got} == want and len(got) == len(want) > 0


def test_documents_without_ids(spark):
    df, p = texts(spark), extract.patterns(gazetteer(spark), Settings(min_token_length=2))
    assert sorted((m["start"], m["text"]) for m in extract.extract(df, p).where("doc_id is null").collect()) == [(0, "aa bb cc"), (0, "dd aa")]


def test_slices_are_the_texts_own(spark):
    df = texts(spark).where("doc_id is not null")
    own = {x["doc_id"]: x["text"] for x in df.collect()}
    got = extract.slices(df, extract.patterns(gazetteer(spark), Settings(min_token_length=2))).collect()
    assert got and all(m["slice"] == own[m["doc_id"]][m["start"] : m["end"]] for m in got)


def test_tables_of_bits_lose_nothing(spark):
    keys = [f"w{i}" for i in range(5000)]
    table = scan.bits(spark.createDataFrame([(x,) for x in keys], "t string"), scan.hash_of(F.col("t")))
    assert scan.among(scan.hashes(keys), table).all()
    assert scan.among(scan.hashes([f"x{i}" for i in range(5000)]), table).mean() < 0.05
    assert not scan.among(scan.hashes(keys), scan.bits(spark.createDataFrame([], "t string"), scan.hash_of(F.col("t")))).any()


def test_many_texts_at_once():
    """The same tokens, offsets and hashes as one by one, with a number of calls in Python that doesn't grow with the tokens."""
    r = random.Random(5)
    one = [f"a{chr(c)}b {chr(c)}" for c in CODES if c < 0x11000]
    mixed = ["".join(r.choice("ab'- éß한\n_9ŉĳﬃİÆ") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    every, n = [*one, *mixed, "", "-", None, "a\U0001f600b d’Arc", "x" * 200_000, "end"], 0
    for which in scan.pieces(every):
        p = scan.Piece([every[i] for i in which])
        for d, i in enumerate(which):
            at = slice(p.first[d], p.first[d + 1])
            if d in p.hard:
                assert at.start == at.stop
                continue
            o, start, end = scan.places(every[i])
            want = [x for x in zip(scan.raw_forms(every[i]), o, start.tolist(), end.tolist(), strict=True) if x[0]]
            s, e = p.start[at], p.end[at]
            got = list(zip(p.forms(at), [p.text[a:b] for a, b in zip(s, e, strict=True)], (s - p.at[d]).tolist(), (e - p.at[d]).tolist(), strict=True))
            assert got == want and (p.hash[at] == scan.hashes([x[0] for x in want])).all(), every[i][:80]
            n += 1
    assert n > 50_000
    calls = []
    for size in (1000, 20_000):
        text, k = "Élan of the day, " * (size // 4), 0

        def called(*_: object) -> None:
            nonlocal k
            k += 1

        sys.setprofile(called)
        scan.Piece([text])
        sys.setprofile(None)
        calls.append(k)
    assert calls[1] <= calls[0] + 10


def test_hard_and_long_texts_beside_others(spark):
    """Texts that are searched one by one, in a batch with others, give what they give alone."""
    df = made(spark, ["aa bb cc", "x \U0001f600 aa-bb dd aa bb", None, "aa’ bb cc", "cc cc, " + "y " * 600_000 + "aa bb", "", "Àâ BB"])
    p = extract.patterns(gazetteer(spark), Settings(min_token_length=2))
    got = {(m["doc_id"], m["start"], m["text"]) for m in extract.extract(df, p).collect()}
    assert got == {(0, 0, "aa bb cc"), (1, 4, "aa-bb dd"), (3, 0, "aa bb cc"), (4, 0, "cc cc"), (4, 1_200_007, "aa bb"), (6, 0, "Àâ BB")}
