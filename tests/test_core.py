import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.functions import refdata as R
from lodeshift.operators import duplicates as U
from lodeshift.operators import fairness as A
from lodeshift.operators import layout as L
from lodeshift.operators import scoring as S
from lodeshift.operators import titles as T
from lodeshift.operators import vectors as V
from lodeshift.plans.catalogue import queries
from lodeshift.plans.names import indel_ratio
from lodeshift.plans.statistics import parse_date, split_range
from lodeshift.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_worked_example(spark):
    values = dict(zip(X.WEIGHTS, (88.4, 60.0, 79.1, 92.0, 100.0, 100.0, 84.0, 96.3, 100.0, 100.0)))
    scores = spark.createDataFrame([("a", k, v) for k, v in values.items()] + [("b", k, None) for k in values], "candidate_id string, dimension string, value double")
    weights = spark.createDataFrame(list(X.WEIGHTS.items()), "dimension string, weight double")
    got = {r.candidate_id: r for r in S.penalised(S.composite(scores, weights), spark.createDataFrame([("b", "HIDDEN_TEXT"), ("b", "HIDDEN_TEXT")], "candidate_id string, code string")).collect()}
    assert got["a"].composite == 87.06 and got["a"].band == "exceptional"
    assert got["b"].base == 0 and got["b"].penalty == 25 and got["b"].composite == 0 and got["b"].band == "not_a_match"


def test_null_dimensions_give_their_weight_to_the_others(spark):
    weights = spark.createDataFrame([("S1", 30.0), ("S2", 10.0)], "dimension string, weight double")
    scores = spark.createDataFrame([("a", "S1", 50.0), ("a", "S2", None)], "candidate_id string, dimension string, value double")
    assert S.composite(scores, weights).first().base == 50.0


def test_ranks_are_total_and_stable(spark):
    r = random.Random(4)
    rows = [("j", f"c{i:03d}", float(r.randrange(5)), r.choice([None, 1.0, 2.0]), None, 0.5, bool(i % 3)) for i in range(90)]
    schema = "job_id string, candidate_id string, composite double, s1 double, s4 double, confidence double, eligible boolean"
    first = {x.candidate_id: x["rank"] for x in S.rank(spark.createDataFrame(rows, schema), 3.0).collect()}
    r.shuffle(rows)
    ranked = S.rank(spark.createDataFrame(rows, schema), 3.0, top=10).collect()
    assert first == {x.candidate_id: x["rank"] for x in ranked} and sorted(first.values()) == list(range(1, 91))
    assert all(x.selected == (x.eligible and x.composite >= 3 and x["rank"] <= 10) for x in ranked)


def test_factors(spark):
    r = one(
        spark, X.recency(F.lit(4.0), 4.0, 0.5).alias("half"), X.recency(F.lit(100.0), 4.0, 0.5).alias("floor"), X.recency(F.lit(1.0), 0.0, 0.5).alias("off"), X.embedding_match(F.lit(0.82)).alias("low"), X.embedding_match(F.lit(0.99)).alias("high"),
        X.years_score(F.lit(1.0), F.lit(2.0), F.lit(5.0)).alias("a"), X.years_score(F.lit(9.0), F.lit(2.0), F.lit(5.0)).alias("b"), X.years_score(F.lit(9.0), F.lit(2.0), F.lit(5.0), 15.0, 3.0).alias("c"), X.years_score(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("d"),
    )
    assert (r.half, r.floor, r.off, r.low, r.a, r.b, r.c, r.d) == (0.5, 0.5, 1.0, 0.6, 40.0, 100.0, 88.0, 70.0) and abs(r.high - 0.7275) < 1e-9


@pytest.mark.parametrize(("roles", "months"), [([(0, 11), (12, 23)], 24), ([(0, 11), (6, 17)], 18), ([(0, 11), (20, 5)], 12), ([], 0), ([(0, 30), (3, 5), (40, 41)], 33)])
def test_covered_months(spark, roles, months):
    df = spark.createDataFrame([("a", s, e) for s, e in roles] + [("a", None, 3)], "candidate_id string, x int, y int")
    date = lambda c: F.make_date(F.lit(2000) + F.floor(F.col(c) / 12).cast("int"), F.col(c) % 12 + 1, F.lit(1))
    got = S.covered_months(df.select("candidate_id", date("x").alias("s"), date("y").alias("e"))).collect()
    assert (got[0].months if got else 0) == months


@pytest.mark.parametrize(
    ("title", "family", "seniority"),
    [("Senior Data Engineer", "data_engineering", "senior"), ("Rockstar Developer", "software_engineering", "senior"), ("Data Analyst II", "analytics", "mid"), ("Ninja Director of ETL", "software_engineering", "director"), ("Beekeeper", None, None)],
)
def test_titles(spark, title, family, seniority):
    r = T.normalise_titles(spark.createDataFrame([(title,), (None,), ("  ",)], "title string")).collect()
    assert [(x.family, x.seniority) for x in r] == [(family, seniority)]


def test_similarity_is_symmetric(spark):
    f = spark.createDataFrame([(x,) for x in R.FAMILIES], "family string")
    got = {(r.family, r.other): r.similarity for r in T.title_similarity(f.crossJoin(f.withColumnRenamed("family", "other"))).collect()}
    assert all(got[a, b] == got[b, a] and (got[a, b] == 1.0) == (a == b) for a, b in got)


def test_group_statistics(spark):
    from math import comb

    t = spark.createDataFrame([("x", 8, 2, 1, 5), ("all", 3, 0, 4, 0), ("none", 0, 0, 4, 1), ("big", 60, 40, 80, 20)], "g string, a long, b long, c long, d long")
    got = {r.g: r.p_value for r in A.fisher_exact(t, ["g"]).collect()}

    def exact(a, b, c, d):
        p = lambda x: comb(a + b, x) * comb(c + d, a + c - x) / comb(a + b + c + d, a + c)
        return sum(p(x) for x in range(max(0, a - d), min(a + b, a + c) + 1) if p(x) <= p(a) * (1 + 1e-9))

    assert abs(got["x"] - exact(8, 2, 1, 5)) < 1e-9 and abs(got["big"] - exact(60, 40, 80, 20)) < 1e-9 and got["all"] == 1.0 and got["none"] is None
    low, high = A.ratio_interval(F.lit(0), F.lit(10), F.lit(5), F.lit(10))
    r = one(spark, low.alias("low"), high.alias("high"))
    assert 0 < r.low < r.high


def test_scrub(spark):
    names = F.array(F.struct(F.lit("Ann").alias("key"), F.lit("[A]").alias("value")), F.struct(F.lit("Ann Lee").alias("key"), F.lit("[B]").alias("value")), F.struct(F.lit("").alias("key"), F.lit("!").alias("value")))
    assert one(spark, A.scrub(F.lit("Ann Lee met Ann."), names).alias("t")).t == "[B] met [A]."


def test_near_pairs_match_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(62) for _ in range(60)]
    prints = base + [b ^ m for b in base[:30] for m in (1, 1 << 40 | 1, 7 << 20, 15)] + base[:10]
    rows = list(enumerate(prints)) + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, f long")
    expected = {(a, b) for a in set(prints) for b in set(prints) if a < b and bin(a ^ b).count("1") <= 3}
    assert {(x.a, x.b) for x in U.near_pairs(df, "id", "f").collect()} == expected
    classes = U.near_classes(df.where("f is not null"), "id", "f").collect()
    assert len(classes) == len(prints) and sum(x.links > 0 for x in classes) > 0


def test_near_documents_match_brute_force(spark, tmp_path):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        base = "".join(r.choice("abcdefgh ") for _ in range(4000))
        texts += [base, base, base[:200] + "zzzz" + base[204:], base[:2000] + "Q" + base[2001:], base + "tail"]
    texts += [None, "", "abc", None] + [f"template {k % 3} " * 300 for k in range(9)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    f = {x.key: x.fingerprint for x in U.simhash(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()}
    near = {a: {b for b in set(f.values()) if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3} for a in set(f.values())}
    expected = {}
    for key, a in f.items():
        seen, stack = {a}, [a]
        while stack:
            fresh = near[stack.pop()] - seen
            seen |= fresh
            stack += fresh
        expected[key] = (min(seen), len(near[a]))
    assert any(n for _, n in expected.values())
    rows = queries()["dup_near_documents"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and {x.key: (x.class_id, x.links) for x in rows} == expected


def test_simhash(spark):
    df = spark.createDataFrame([(1, "abcdefgh" * 50), (2, "abcdefgh" * 50), (3, ""), (4, None), (5, "abc")], "id long, t string")
    got = {r.key: r.fingerprint for r in U.simhash(df, "id", "t").collect()}
    assert got[1] == got[2] != 0 and got[3] == got[4] == got[5] == 0


def test_neighbours_match_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(V, "BLOCK", 16)
    x = np.random.default_rng(0).normal(size=(90, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 6)], "id long, v array<double>")
    got = {(r.query, r["rank"]): r.neighbour for r in V.top_neighbours(df.where("id % 10 = 0"), df, "id", "v", 4).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 90, 10):
        s = unit @ unit[q]
        s[q] = -2
        assert [got[q, k + 1] for k in range(4)] == np.argsort(-s)[:4].tolist()


def test_line_text(spark):
    g = spark.createDataFrame([(1, 0.0, 4.0, "a", 8.0), (1, 4.2, 8.0, "b", 8.0), (1, 12.0, 15.0, "c", 8.0)], "line int, x0 double, x1 double, text string, font double")
    assert L.line_text(g, ["line"]).first().text == "ab c"


@pytest.mark.parametrize(
    ("text", "value", "precision"),
    [("present", "2026-08-29", "present"), ("2020", "2020-01-01", "year"), ("06/2020", "2020-06-01", "month"), ("13/2020", None, None), ("Sept. 99", "1999-09-01", "month"), ("(Jan 2021)", "2021-01-01", "month"), ("30 Feb 2020", None, None), ("29 Feb 2020", "2020-02-29", "day"), ("soon", None, None)],
)
def test_parse_date(spark, text, value, precision):
    x = one(spark, parse_date(F.lit(text), "2026-08-29").alias("x")).x
    assert (x and x.value, x and x.precision) == (value, precision)


@pytest.mark.parametrize(("text", "start", "end"), [("Jan 2020 – Present", "Jan 2020", "Present"), ("06-2020 – 2021", "06", "2020 – 2021"), ("2019 to 2020", "2019", "2020"), ("2019", "2019", None)])
def test_split_range(spark, text, start, end):
    x = one(spark, split_range(F.lit(text)).alias("x")).x
    assert (x.start, x.end) == (start, end)


def test_indel_ratio():
    assert indel_ratio("abc", "abc") == 100 and indel_ratio("", "") == 100 and abs(indel_ratio("abcd", "abxd") - 75) < 1e-9


def test_html():
    page = "<title>T</title><style>x</style><p>a &amp; b<br>c</p><script>no()</script><ul><li>d</li></ul>"
    assert files.html_text(page) == "T\na & b\nc\nd" and files.html_text(None) is None and files.html_text("") == ""


def test_globs():
    import re

    ok = lambda g, p: re.search(files.glob_pattern(g), p) is not None
    assert ok("**/*.pdf", "a/b/c.pdf") and ok("**/*.pdf", "c.pdf") and not ok("*.pdf", "a/c.pdf") and ok("a?.txt", "ab.txt") and not ok("**/.*", "a/b.txt")


def test_manifest_and_readers(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    for name, data in {"a.txt": b"plain", "sub/b.html": b"<p>hi</p>", "c.docx": docx.getvalue(), "d.txt": b"", "e.pdf": b"%PDF-1.4", "f.exe": b"MZ", "g.txt": "é".encode("latin-1"), ".h.txt": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    good, bad = files.manifest(spark, str(tmp_path / "in"))
    assert {r.path for r in good.select("path").collect()} == {"a.txt", "sub/b.html", "c.docx", "e.pdf", "g.txt"}
    assert bad.count() == 0
    small = files.manifest(spark, str(tmp_path / "in"), most_bytes=4)[1]
    assert {(r.path, r.reason) for r in small.collect()} == {(p, "TOO_LARGE") for p in ("a.txt", "sub/b.html", "c.docx", "e.pdf")}
    text = {r.path: (r.text, r.code) for r in files.extract(good).collect()}
    assert text["a.txt"] == ("plain", None) and text["sub/b.html"] == ("hi", None) and text["c.docx"] == ("Hello\na | b", None) and text["g.txt"] == ("é", None) and text["e.pdf"][1] == "NO_READER"
    (tmp_path / "g.csv").write_text("candidate_id,group\na,x\n,\na,y\nb,z\n")
    assert {(r.candidate_id, r.group) for r in files.read_groups(spark, str(tmp_path / "g.csv")).collect()} == {("a", "y"), ("b", "z")}
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "1.json").write_text('{"job_id":"j","candidate_id":"c","composite":1.5}\n{broken\n')
    assert [r.candidate_id for r in files.read_cards(spark, str(tmp_path / "cards")).collect()] == ["c"]
    frame = spark.createDataFrame([("c", 1.5)], "candidate_id string, composite double")
    files.write_scores(frame, str(tmp_path / "scores"))
    files.write_audit(frame, str(tmp_path / "audit"), "abc")
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "scores")) and '"jobspec_sha256":"abc"' in spark.read.text(str(tmp_path / "audit")).first().value


def test_settings():
    got = files.settings({"A": {"x": 1, "on": True}, "b": "k"}, {"a": {"X": 2}}, {"LODESHIFT_A__ON": "no", "OTHER": "1"}, {"B": "z"})
    assert got == {"A": {"x": 2, "on": False}, "b": "z"}


def test_zip_risk(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"0" * 1_000_000)
    df = spark.createDataFrame([(1, bytearray(data.getvalue())), (2, bytearray(b"no"))], "i int, content binary").select("i", files.zip_risk("content").alias("r"))
    assert {r.i: r.r for r in df.collect()} == {1: "RATIO", 2: None}
