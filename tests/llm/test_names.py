import pytest

from lodeshift.llm.names import Parser, crossed, resolve_names, strong_keys, variant_pairs, with_variants

ALIASES = [("brzq", "kelmo tarvin logistics"), ("old kelmo", "kelmo tarvin logistics"), ("fernis dorlat works", "kelmo tarvin logistics")]
SUFFIXES = ["gmbh", "g.m.b.h.", "ltd", "ltd.", "s.a."]


@pytest.mark.parametrize(
    ("name", "parsed"),
    [
        ("Kelmo Tarvin Logistics GmbH", (["kelmo", "tarvin"], "logistics")), ("Logistics, Kelmo Tarvin", (["kelmo", "tarvin"], "logistics")), ("Kelmo + Tarvin Log.", (["kelmo", "tarvin"], "logistics")),
        ("KelmoTarvin Logistcs s.a.", (["kelmo", "tarvin"], "logistics")), ("The Kelmo Tarvin Logistics Group", (["kelmo", "tarvin"], "logistics")), ("Kelmo Tarvin Logistics - Corvin", (["kelmo", "tarvin"], "logistics")),
        ("Kelmo Tarvin", (["kelmo", "tarvin"], None)), ("n/a", None), ("", None), (" - ", None), ("Self-employed", None),
    ],
)
def test_parse(name, parsed):
    assert Parser("employer", SUFFIXES).parse(name) == parsed


def test_resolution(spark):
    groups = {
        "a": ["Kelmo Tarvin Logistics", "kelmo tarvin log.", "Kelmo Travin Logistics GmbH", "Tarvin Kelmo Logistics", "Kelmo Tarvin Logistics (Corvin)", "BRZQ", "Old Kelmo", "Fernis Dorlat Works GmbH"],
        "b": ["Kelmo Tarvin Foods", "Foods, Kelmo Tarvin"],
        "c": ["Zoumeldan Parvester Retail Ltd", "Zoumeldan Parvester", "Zoumledan Pavester Rtl"],
        "d": ["Kelmo Tarvin"],  # two organisations have that name: belongs to neither
    }
    rows = [("employer", n) for g in groups.values() for n in g] * 2 + [("employer", x) for x in (None, "", "N/A", "x" * 40_000)] + [(None, "Kelmo")]
    rows += [("institution", n) for n in ("University of Orfel Nardin", "Orfel Nardin Univ", "Orfel Nardin College")]
    resolved = resolve_names(spark.createDataFrame(rows, "field string, name string"), ALIASES, SUFFIXES)
    got = {}
    for r in resolved.collect():
        got.setdefault((r.field, r.organisation), set()).add(r.name)
    found = sorted(map(sorted, (v for (f, _), v in got.items() if f == "employer")))
    assert found == sorted([*map(sorted, groups.values()), ["x" * 40_000]])
    assert sorted(map(sorted, (v for (f, _), v in got.items() if f == "institution"))) == [["Orfel Nardin College"], ["Orfel Nardin Univ", "University of Orfel Nardin"]]
    assert all(r.variants == len(got[r.field, r.organisation]) - 1 for r in with_variants(resolved).collect())
    pairs = {(r.name_a, r.name_b) for r in variant_pairs(resolved).where("field = 'employer'").collect()}
    assert pairs == {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_no_names(spark):
    empty = spark.createDataFrame([], "field string, name string")
    assert resolve_names(empty, [], []).count() == 0


def _groups(spark, names, aliases=(), field="employer"):
    resolved = resolve_names(spark.createDataFrame([(field, n) for n in names], "field string, name string"), list(aliases), SUFFIXES)
    got = {}
    for r in resolved.collect():
        got.setdefault(r.organisation, set()).add(r.name)
    return sorted(map(sorted, got.values()))


def test_merged_profiles_find_what_no_member_finds(spark):
    members = ["Alpha Beta Gamma Foods", "Alpha Betta Gamma Foods", "Alpha Beta Gammma Foods"]
    late = "Alfpha Betta Gammma Foods"  # two slips from each member, one from what they hold together
    assert not any(strong_keys(late.lower().split()[:3]) & strong_keys(m.lower().split()[:3]) for m in members)
    assert _groups(spark, [*members, late]) == [sorted([*members, late])]
    assert _groups(spark, [members[0], late]) == sorted([[members[0]], [late]])


def test_initials_and_acronyms(spark):
    group = ["Zilmar Tevonko Logistics", "Z. Tevonko Logistics", "Zilmar T. Logistics GmbH", "Z. T. Logistics", "ZTL", "Zilmar Tevnko Log."]
    other = ["Orbel Tarvin Foods", "Orfan Tarvin Foods", "O. Tarvin Foods", "OTF"]  # two organisations answer to the last two
    assert _groups(spark, group + other) == sorted([sorted(group), *([x] for x in other)])
    assert _groups(spark, ["Kestel Orvan University", "K. Orvan Univ", "KOU"], field="institution") == [["K. Orvan Univ", "KOU", "Kestel Orvan University"]]


@pytest.mark.parametrize(("cores", "new"), [([["alpha", "beta"], ["alpah", "betta"]], [["alpah", "beta"], ["alpha", "betta"]]), ([["alpha", "beta"]], []), ([["alpha"], ["omega"]], []), ([], [])])
def test_crossed(cores, new):
    assert crossed(cores) == sorted(new)


def test_a_resolution_takes_few_jobs(spark):
    names = ["Zilmar Tevonko Logistics", "Z. Tevonko Logistics", "Zilmar T. Logistics GmbH", "ZTL", "Zilmar Tevnko Log.", "Zilmar Tevonko", "Kelmo Tarvin Foods", "BRZQ"]
    spark.sparkContext.setJobGroup("names", "")
    try:
        assert len(_groups(spark, names, ALIASES)) == 3
        # 47; 132 when each step joined the owners anew. Each job costs the driver memory for its plan and threads.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("names")) <= 90
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
