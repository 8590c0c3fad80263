"""Unit, golden and brute-force tests of the name library."""

from __future__ import annotations

import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moniker import cli
from moniker.config import Settings
from moniker.functions import keys, lattice, similarity, text
from moniker.functions.phonetic import metaphone
from moniker.operators import clusters as K
from moniker.operators import compare, extract, lookup, percolate
from moniker.sources import readers, writers
from moniker.store import Store
from moniker.streaming.mentions import extract_stream

ENTITIES = [
    ("e1", "PublicBody", {"name": ["European Parliament"], "country": ["eu"]}),
    ("e2", "PublicBody", {"name": ["European Council"], "alias": ["EU Council"]}),
    ("e3", "PublicBody", {"name": ["European Central Bank"]}),
    ("e4", "Person", {"name": ["Jane Doe"], "alias": ["jani"], "nationality": ["MT"]}),
    ("e5", "LegalEntity", {"name": ["Doe, Jane"]}),
    ("e6", "Organization", {"name": ["Al Qamar"]}),
    ("e7", "Organization", {"name": ["men so"]}),
    ("e8", "Person", {"name": ["Britta"]}),
    ("e9", "Person", {"name": ["Alice"]}),
    ("e10", "Company", {"name": ["Northern Bank Holding"], "previousName": ["Northern Bank"], "country": ["DE"]}),
    ("e11", "Vessel", {"name": ["Blue Star Vessel"]}),
    ("e12", "Person", {"alias": ["Only Alias"]}),
    ("e13", "Person", {"name": ["A Leeds"]}),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory) -> Store:
    at = tmp_path_factory.mktemp("store")
    (at / "in.json").write_text("".join(json.dumps({"id": i, "schema": s, "properties": p}) + "\n" for i, s, p in ENTITIES))
    s = Store(spark, str(at / "store"))
    s.load_entities(str(at / "in.json"), sync=True)
    return s


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "folded"), [("café", "cafe"), ("ﬁ", "fi"), ("Straße", "strasse"), ("Müller", "muller"), ("Élève", "eleve"), ("Łódź", "lodz"), ("GmbH", "gmbh"), ("Москва", "moskva"), ("Жанна Щукина", "zhanna shchukina"), ("Αθήνα", "athina"), ("é", "e")])
def test_fold(spark, given, folded):
    assert one(spark, text.fold(F.col("s")), s=given) == folded


def test_fold_null_and_tokens(spark):
    assert spark.sql("select cast(null as string) s").select(text.fold(F.col("s")).alias("x")).first()["x"] == ""
    t = text.tokens(spark.createDataFrame([("\U0001f600 Mr. Smith-, 'Jr' - Élan",)], "text string")).first()["tokens"]
    assert [(x["form"], x["start"], x["end"]) for x in t] == [("mr", 2, 4), ("smith", 6, 12), ("jr", 14, 18), ("elan", 21, 25)]
    assert one(spark, text.phrase(F.col("s")), s="Hello,  World's") == "hello world's"


def test_offsets_in_blocks(spark):
    """Offsets of a text of many blocks of tokens are those of its slices."""
    long = "".join(f"w{i}{' ' * (i % 5 + 1)}-é{i}'," for i in range(1500))
    got = text.tokens(spark.createDataFrame([(long,)], "text string")).first()["tokens"]
    assert len(got) == 3000 and all(long[x["start"] : x["end"]] == x["original"] for x in got)


def test_jaro_of_many_pairs():
    r = random.Random(4)
    a, b = ([("".join(r.choice("abcd é\U0001f600") for _ in range(r.randint(0, 14)))) for _ in range(2000)] for _ in range(2))
    b[:300] = a[:300]
    assert np.allclose(similarity.jaro_many(a, b), [similarity.jaro(x, y) for x, y in zip(a, b, strict=True)], atol=1e-12)


def test_subsequence_of_bits():
    r = random.Random(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda last, j, x=x, row=row: row[j] + 1 if x == b[j] else max(row[j + 1], last), initial=0))
        return row[-1]

    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert similarity._subsequence(a, b) == plain(a, b)


def test_keys(spark):
    names = ["Jane Doe", "Doe, Jane", "doe jane", "Jané Doe", "Mrs. Jane Doe"]
    rows = spark.createDataFrame([(n,) for n in names], ["n"]).select(keys.name_key(F.col("n")).alias("k")).distinct().collect()
    assert [r["k"] for r in rows] == ["doe jane"]
    assert one(spark, keys.name_key(F.col("n")), n="The Acme Limited") == "acme ltd"


def test_legal_forms_and_prefixes(spark):
    cases = {"Acme Public Limited Company": "acme plc", "Fiat S.p.A.": "fiat spa", "Muster GmbH & Co. KG": "gmbhcokg muster", "Muster G.m.b.H.": "gmbh muster", "Gesellschaft mit beschränkter Haftung Muster": "gmbh muster", "Общество с ограниченной ответственностью Ромашка": "ooo romashka", "Signora Maria Rossi": "maria rossi", "Prof. Dr. J. R. Smith": "j r smith", "Spam Ltd": "ltd spam", "Kraft Sp. z o.o.": "kraft spzoo", None: "", " - ": ""}
    rows = spark.createDataFrame([(n,) for n in cases], "n string").select("n", keys.name_key(F.col("n")).alias("k")).collect()
    assert {r["n"]: r["k"] for r in rows} == cases


def test_common_schema(spark):
    cases = [(["Person"], "Person"), (["Person", "Organization"], "LegalEntity"), (["Company", "Organization"], "Company"), (["Company", "Person"], "LegalEntity"), ([], "LegalEntity"), (["Company", "LegalEntity", "Organization"], "Company"), (["Address"], "Address")]
    for given, want in cases:
        assert lattice.common(given) == want
    rows = spark.createDataFrame(cases, "s array<string>, want string").select(lattice.common_schema(F.col("s")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_clusters(store):
    found = {r["key"]: r for r in store.clusters().collect()}
    assert store.count() == len(found) == 9
    jane = found["doe jane"]
    assert (jane["names"], jane["aliases"], jane["countries"], jane["schemata"]) == (["Doe, Jane", "Jane Doe"], ["jani"], ["mt"], ["LegalEntity", "Person"])
    assert store.get_doc("bank holding northern")["names"] == ["Northern Bank", "Northern Bank Holding"]
    assert store.get_doc("nobody") is None
    assert not {"alice", "blue star vessel", "alias only"} & set(found)


def test_loads_accumulate(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.count() == 0
    (tmp_path / "names.txt").write_text("Jane Doe\nAlice\n\n  Jane Doe \n")
    s.load_names(str(tmp_path / "names.txt"))
    s.load_names(str(tmp_path / "names.txt"), schema="Person")
    assert s.get_doc("doe jane")["schemata"] == ["LegalEntity", "Person"] and s.count() == 1


def test_dataset_and_catalog(spark, tmp_path):
    (tmp_path / "e.ftm.json").write_text(json.dumps({"id": "a", "schema": "Person", "properties": {"name": ["Jane Doe"]}}) + "\n")
    (tmp_path / "d.json").write_text(json.dumps({"name": "d", "resources": [{"name": "entities.ftm.json", "url": "e.ftm.json"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"datasets": [{"name": "d", "uri": "d.json"}, {"name": "without"}]}))
    assert readers.dataset(spark, str(tmp_path / "d.json")).count() == 1
    assert [r["id"] for r in readers.catalog(spark, str(tmp_path / "c.json")).collect()] == ["a"]


def test_lookup(store):
    hit = store.lookup("European Parliament")
    assert hit["score"] > 0.97 and hit["schemata"] == ["PublicBody"] and hit["caption"] == "European Parliament"
    assert store.lookup("european parliament") is not None
    assert store.lookup("European Parlament")["score"] < 1
    assert store.lookup("European Parlment") is None
    assert 0.5 < store.lookup("European Parlment", threshold=0.5)["score"] < 1
    assert store.lookup("xyzzyplugh gibberish") is None and store.lookup("ab") is None
    assert store.lookup("Jane Doe", threshold=1.0) is None


def test_lookup_schemata(store):
    assert store.lookup("Jane Doe", schemata=["Person"])["countries"] == ["mt"]
    assert store.lookup("Jane Doe", schemata=["Company"]) is None
    assert store.lookup("Jane Dae", threshold=0)["key"] == "doe jane"


def _texts(rows):
    return [(r["text"], r["start"], r["end"], r["schema"]) for r in rows]


def test_extract(store):
    t = "xxxx European Parliament is important. European Parliament!"
    got = store.extract(t)
    assert [t[r["start"] : r["end"]] for r in got] == ["European Parliament"] * 2 and got[0]["start"] == 5
    assert store.extract("We met Britta today.") == []
    assert _texts(store.extract("\U0001f600 The group Al Qamar was")) == [("Al Qamar", 12, 20, "Organization")]
    assert len(store.extract("European Parliament European Council")) == 1
    assert _texts(store.extract("the Northern Bank Holding")) == [("Northern Bank Holding", 4, 25, "Company")]
    assert store.extract("") == []


def test_percolate(store):
    t = "Jane M. Doe was here."
    assert store.percolate(t) == []
    got = store.percolate(t, slop=1)
    assert [(r["text"], t[r["start"] : r["end"]]) for r in got] == [("Jane M Doe", "Jane M. Doe")]
    t = 'foo bar men". So baz'
    assert [(r["text"], t[r["start"] : r["end"]]) for r in store.percolate(t)] == [("men So", 'men". So')]
    assert store.percolate("Parliament.") == [] and store.percolate("We met Britta today.") == []
    assert len(store.percolate("European Parliament European Council")) == 2
    assert [r["text"] for r in store.percolate("the Northern Bank Holding")] == ["Northern Bank", "Northern Bank Holding"]
    assert [(r["start"], r["end"]) for r in store.percolate("jane jane doe", slop=1)] == [(0, 13), (5, 13)]
    assert store.percolate("A Leeds went") == []


def test_percolate_equals_extract(store, spark):
    t = "The European Parliament met the European Council, then the European Central Bank."
    both = lambda rows: {(r["text"], r["start"]) for r in rows}
    assert both(store.extract(t)) == both(store.percolate(t)) and len(store.extract(t)) == 3
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    a, b = store.extract_all(docs), store.percolate_all(docs)
    assert compare.both(a, b).count() == 3 and compare.only_first(a, b).count() == 0 == compare.only_first(b, a).count()
    assert compare.stats(a).first()["n_mentions"] == 3 and compare.sample(compare.texts(a), 2).count() == 2


def test_selection_against_scan(spark):
    """Leftmost-longest selection, and ordered matches with gaps, against plain loops."""
    r = random.Random(5)
    docs, want_x, want_p = [], set(), {0: set(), 1: set(), 2: set()}
    pats = [["aa", "bb"], ["aa", "bb", "cc"], ["bb", "cc", "aa", "aa"], ["cc", "cc"], ["dd", "aa"]]
    for d in range(60):
        toks = [r.choice(["aa", "bb", "cc", "dd"]) for _ in range(r.randint(0, 14))]
        docs.append((d, " ".join(toks)))
        last = -2
        for i in range(len(toks)):
            fits = [p for p in pats if toks[i : i + len(p)] == p]
            if fits and i > last + 1:
                n = max(map(len, fits))
                want_x.add((d, i, i + n))
                last = i + n - 1
        for slop in want_p:
            for p in pats:
                for i, t in enumerate(toks):
                    if t != p[0]:
                        continue
                    k, e = 1, i
                    for j in range(i + 1, min(len(toks), i + len(p) + slop)):
                        if k < len(p) and toks[j] == p[k]:
                            k, e = k + 1, j
                    if k == len(p):
                        want_p[slop].add((d, i, e + 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    c = spark.createDataFrame([(" ".join(sorted(p)) + str(i), [" ".join(p)], [], [], ["Person"]) for i, p in enumerate(pats)], "key string, names array<string>, aliases array<string>, countries array<string>, schemata array<string>")
    spot = lambda rows: {(x["doc_id"], x["start"] // 3, (x["end"] + 1) // 3) for x in rows.collect()}
    assert spot(extract.extract(df, extract.patterns(c, Settings(min_token_length=2)))) == want_x
    for slop, want in want_p.items():
        assert spot(percolate.percolate(df, c, K.postings(c), slop, Settings(percolate_min_should_match=1))) == want


def test_fuzzy_candidates_are_complete(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(4, 8))) for _ in range(40)]
    c = spark.createDataFrame([(w, [w], [], [], ["Person"]) for w in sorted(set(words))], "key string, names array<string>, aliases array<string>, countries array<string>, schemata array<string>")
    q = spark.createDataFrame([(w,) for w in {"".join(r.choice("abc") for _ in range(r.randint(4, 8))) for _ in range(30)}], "clean_q string")
    got = {(x["clean_q"], x["key"]) for x in lookup.fuzzy(q, c).collect()}
    assert got == {(a["clean_q"], b) for a in q.collect() for b in set(words) if similarity.osa(a["clean_q"], b) <= 2}


def test_metrics():
    assert similarity.osa("ca", "abc") == 3 and similarity.osa("abcd", "abdc") == 1 and similarity.osa("a", "abcd") == 3
    assert round(similarity.jaro("european parlament", "european parliament"), 6) == 0.982456
    assert round(similarity.jaro("dae jane", "doe jane"), 6) == 0.916667
    assert similarity.weighted_ratio("jane doe", "doe jane") == 95 and similarity.weighted_ratio("", "a") == 0
    assert {w: metaphone(w) for w in ("Knight", "Phone", "Thomas", "School", "Wright", "Smith", "Xavier", "")} == {"Knight": "NT", "Phone": "FN", "Thomas": "0MS", "School": "SKL", "Wright": "RT", "Smith": "SM0", "Xavier": "SFR", "": ""}


def test_facets_and_files(store, spark, tmp_path):
    s = K.symbols(store.clusters())
    assert [r["key"] for r in K.with_qid(s, "Q4160311").collect()] == ["doe jane"]
    assert {r["key"] for r in K.with_symbols(s, ["SYMBOL:holding", "LOCATION:europe"]).collect()} == {"bank holding northern", "european parliament", "council european", "bank central european"}
    p = extract.patterns(store.clusters())
    writers.patterns_tsv(p, str(tmp_path / "p"))
    assert sorted(map(tuple, readers.patterns_tsv(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, p.collect()))
    writers.clusters_json(store.clusters(), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 9


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "n.txt").write_text("European Parliament\nJane Doe\n")
    (tmp_path / "t.txt").write_text("Jane Q Doe in the European Parliament")
    run = lambda *a: cli.main(["--uri", str(tmp_path / "s"), *a], spark)
    assert run("load-names", "-i", str(tmp_path / "n.txt")) == 0 and run("build") == 0
    run("lookup", "european parlament")
    run("lookup", "somebody else")
    run("extract", "-i", str(tmp_path / "t.txt"))
    run("percolate", "-i", str(tmp_path / "t.txt"), "--slop", "1")
    run("iterate")
    out = capsys.readouterr().out.splitlines()
    assert "European Parliament" in out[0] and out[1] == "not found" and json.loads(out[2])["text"] == "European Parliament" and len(out) == 7
    assert cli.main(["--version"]) == 0 and cli.main(["--settings"]) == 0


def test_settings_from_env(monkeypatch):
    monkeypatch.setenv("MONIKER_LIMIT", "3")
    monkeypatch.setenv("DEBUG", "true")
    assert Settings.from_env().limit == 3 and Settings.from_env().debug


def test_stream(store, spark, tmp_path):
    spark.createDataFrame([(1, "European Parliament"), (2, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = extract_stream(docs, extract.patterns(store.clusters()), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_store_lifecycle(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        assert s.facts().count() == 0
        s.put([{"id": "a", "schema": "Person", "properties": {"name": ["Jane Doe"]}}])
        s.build()
        first = s.warm().lookup("jane doe")
        assert first["key"] == "doe jane" and s.lookup("jane doe") is first and s.lookup("nobody at all") is None
        assert s.load_patterns(str(tmp_path / "none")) is False and [m["text"] for m in s.extract("A Jane Doe.")] == ["Jane Doe"]
        s.save_patterns(str(tmp_path / "patterns"))
        s.put([{"id": "b", "schema": "Person", "properties": {"name": ["John Smith"]}}])
        s.build()
        assert s.load_patterns(str(tmp_path / "patterns")) and s.extract("John Smith and Jane Doe")[0]["text"] == "Jane Doe" and s.lookup("john smith")["key"] == "john smith"
    assert [m["text"] for m in s.extract("John Smith and Jane Doe")] == ["John Smith", "Jane Doe"]
    (tmp_path / "s" / "facts" / "part-broken.parquet").write_text("not a table")
    with pytest.raises(Exception):  # noqa: B017
        s.build()
    assert s.clusters and Store(spark, s.uri).lookup("jane doe")["key"] == "doe jane"


def test_whole_input_keeps_offsets(spark, monkeypatch):
    import io

    text_in = "a\r\nJane\x0cDoe\n"
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text_in.encode()), newline=""))
    assert readers.document(spark, "-").first()["text"] == text_in


def test_report(spark):
    a = spark.createDataFrame([(1, f"Name {i}", 0, 5, "Person") for i in range(5)], "doc_id long, text string, start int, end int, schema string")
    got = compare.report(a, a.where("text < 'Name 3'"), most=2)
    assert "extract: 5 mentions, 5 texts" in got and "both: 3" in got and "  ... 1 more" in got and "extract only: 2" in got and "percolate only: 0" in got


def test_spread(spark):
    small, some = spark.range(10), spark.createDataFrame([(i, "x" * 1000) for i in range(3000)], "i long, t string")
    assert readers.spread(small).count() == 10 and Counter(x["i"] for x in readers.spread(some).collect()) == Counter(range(3000))


def test_long_strings_within_two_edits(spark):
    """Whatever two edits, swaps included, do to strings around the length of the prefix, they meet."""
    r = random.Random(17)
    rows = []
    for _ in range(1500):
        s = "".join(r.choice("abc ") for _ in range(r.choice([3, 6, 18, 19, 20, 21, 22, 23, 40])))
        t = list(s)
        for _ in range(r.randint(0, 2)):
            at, kind = r.randrange(len(t) + 1) if r.random() < 0.5 else min(len(t), r.choice([17, 18, 19, 20, 21])), r.randrange(4)
            if kind == 0:
                t.insert(at, r.choice("abc "))
            elif at < len(t) and kind == 1 and len(t) > 2:
                del t[at]
            elif at < len(t) and kind == 2:
                t[at] = r.choice("abc ")
            elif at + 1 < len(t):
                t[at], t[at + 1] = t[at + 1], t[at]
        if similarity.osa(s, "".join(t)) <= 2:
            rows.append((s, "".join(t)))
    df = spark.createDataFrame(rows, "s string, t string")
    assert len(rows) > 1300 and df.where(~F.arrays_overlap(lookup.deletions(F.col("s")), lookup.deletions(F.col("t")))).count() == 0
    assert df.select(F.max(F.size(lookup.deletions(F.col("s"))))).first()[0] <= 211
