import random

import pytest
from pyspark.sql import functions as F

from lodeshift.functions.dates import typed_month
from lodeshift.operators.intervals import merge_intervals
from lodeshift.operators.packed import Splitter, split_packed

COLUMNS = "who string, s int, e int, kind string"


def brute(rows):
    out, by = set(), {}
    for who, s, e, _ in rows:
        if who is not None and s is not None and e is not None and s <= e:
            by.setdefault(who, set()).update(range(s, e + 1))
    for who, months in by.items():
        months = sorted(months)
        begin = prev = months[0]
        for m in months[1:]:
            if m > prev + 1:
                out |= {(who, "period", begin, prev), (who, "gap", prev + 1, m - 1)}
                begin = m
            prev = m
        out.add((who, "period", begin, prev))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intervals_match_brute_force_with_a_hot_entity(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(600):
        who = r.choice(["hot"] * 3 + ["a", "b", "c", "d", None, ""])
        s = r.choice([None] + [r.randrange(400) for _ in range(30)])
        rows.append((who, s, None if s is None else s + r.randrange(-3, 9), "x"))
    rows += rows[:50]
    got = merge_intervals(spark.createDataFrame(rows, COLUMNS), ["who"], "s", "e").collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute(rows)


def test_no_period_twice_where_partitions_end_with_an_entity(spark):
    rows = [(f"e{i:04d}", 10 * k, 10 * k + 3, "") for i in range(200) for k in range(1)]
    for width in ("3", "7", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got = merge_intervals(spark.createDataFrame(rows, COLUMNS), ["who"], "s", "e").collect()
        assert len(got) == 200 and {tuple(x) for x in got} == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_intervals_of_an_empty_table(spark):
    assert merge_intervals(spark.createDataFrame([], COLUMNS), ["who"], "s", "e").collect() == []


def test_intervals_only_overlapping(spark):
    df = spark.createDataFrame([("a", 1, 3, ""), ("a", 4, 6, ""), ("a", 6, 7, "")], COLUMNS)
    assert {tuple(x) for x in merge_intervals(df, ["who"], "s", "e", adjacent=0).collect()} == {("a", "period", 1, 3), ("a", "period", 4, 7)}


def test_typed_months(spark):
    cases = {
        "Apr 1992": 199204, "Sept. 2020": 202009, "04/2019": 201904, "4-2019": 201904, "2019": 201901, " JUNE  1999": 199906, "2003-03-09": 200303,
        "Mar 06": 200603, "May 67": 196705, "junio de 2021": 202106, "März 2026": 202603, "15 Feb 2020": 202002, "30 Feb 2020": None, "13/2020": None,
        "00/2017": None, "31.31.2015": None, "20XX": None, "heute": 202608, "till date": 202608, "": None, "n/a": None, "01.02.2015": 201502, "août 2014": 201408,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", typed_month(F.col("t"), 202608).alias("m"))
    for t, m in df.collect():
        expected = cases.get(t)
        assert m == (None if expected is None else expected // 100 * 12 + expected % 100 - 1), t


KNOWN = ["first aid", "data modelling", "search, and rescue", "r&d"]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a, b and c", ["a", "b", "c"]),
        ("Skills: first aid;; R&D;", ["first aid", "R&D"]),
        ('"x, y"; z', ["x, y", "z"]),
        ('"the ""b"" m";k', ['the "b" m', "k"]),
        ('["a", "the \\"b\\" c"]', ["a", 'the "b" c']),
        ("['a', 'b, c']", ["a", "b, c"]),
        ("(a; b)", ["a", "b"]),
        ("p (q, r), A/B testing / z", ["p (q, r)", "A/B testing", "z"]),
        ("• a\n• b - c", ["a", "b", "c"]),
        ("first aid and data modelling", ["first aid", "data modelling"]),
        ("this and that", ["this and that"]),
        ("Search, and rescue, a", ["Search, and rescue", "a"]),
        ("a, a", ["a", "a"]),
        (",,; |", []),
        ("", []),
    ],
)
def test_packed_values(text, values):
    assert Splitter(KNOWN).values(text) == values


def test_packed_rows(spark):
    df = spark.createDataFrame([(1, "a; b", 5), (2, None, 5), (3, "", 5), (4, " ", 5), (5, "x, " * 3000, 5), (None, "z", 5)], "id int, text string, row_key int")
    got = split_packed(df, "id", "text", KNOWN).collect()
    assert sorted((r.row_key or "", r.item_no, r.item) for r in got if r.row_key != "5") == [("", 1, "z"), ("1", 1, "a"), ("1", 2, "b")]
    assert sum(r.row_key == "5" for r in got) == 3000
    assert split_packed(df.limit(0), "id", "text", KNOWN).count() == 0


def test_packed_values_without_caps():
    long_known = ", ".join(f"part {i}" for i in range(20))  # a known value with 19 delimiters
    splitter = Splitter([*KNOWN, long_known])
    assert splitter.values(f"x, {long_known}, y") == ["x", long_known, "y"]
    many = " and ".join(f"a{i}" for i in range(30))
    assert splitter.values(many) == [many] and splitter.values(f"İ; first aid and data modelling; {long_known}") == ["İ", "first aid", "data modelling", long_known]
