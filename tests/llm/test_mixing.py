import numpy as np

from lodeshift.llm import mixing


def test_flight_keeps_the_balance():
    r = np.random.default_rng(3)
    sizes = r.integers(5, 3000, 2000)
    pi = np.full(2000, 0.37)
    x = np.column_stack([pi * sizes, pi])
    out = mixing.flight(pi, x, r)
    still = (out > 0) & (out < 1)
    assert still.sum() <= 2
    assert abs((out * sizes).sum() - (pi * sizes).sum()) < 1e-3 and abs(out.sum() - pi.sum()) < 1e-6
    landed = mixing.landing(out, r)
    assert set(landed) <= {0.0, 1.0} and np.array_equal(landed[~still], out[~still])


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 150)
    r = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else "small", int(r.integers(1, 500))) for i in range(2000)] + [(9000 + i, "tiny", 50) for i in range(20)]
    rows += [(9500, None, 9), (9501, "other", 9), (9502, "hot", 0), (9503, "hot", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.48, 2), ("tiny", 0.01, 4), ("none", 0.01, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.balanced_mix(docs, targets)
    got = mixed.collect()
    assert len({x.doc_id for x in got}) == len(got) and all(x.tokens > 0 for x in got)
    limits = {"hot": 1, "small": 2, "tiny": 4}
    assert all(1 <= x.copies <= limits[x.source] for x in got)
    share = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    assert share["none"].actual_share == 0 and share["none"].docs == 0
    for s, t in (("hot", 0.5), ("small", 0.48), ("tiny", 0.01)):
        assert abs(share[s].actual_share - t / 0.99) < 0.004, share
    assert [tuple(x) for x in mixing.balanced_mix(docs, targets).orderBy("doc_id").collect()] == [tuple(x) for x in mixed.orderBy("doc_id").collect()]


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.balanced_mix(docs, targets)
    assert mixed.count() == 0 and [x.actual_share for x in mixing.shares(mixed, targets).collect()] == [0.0]
