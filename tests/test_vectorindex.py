import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.operators import canonical as C, vectorindex as V

SCHEMA = "id long, vector array<float>, first int, last int"


def _unit(rng, n, d=16, centres=12, spread=0.06):
    middle = rng.normal(size=(centres, d))
    v = middle[rng.integers(centres, size=n)] / np.sqrt(d) + rng.normal(size=(n, d)) * spread
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[: n // 5] = v[0]  # a fifth are copies of one vector
    return v.astype(np.float32)


def _rows(v, spans=None):
    return [(i, [float(x) for x in row], *(spans[i] if spans else (0, 0))) for i, row in enumerate(v)]


@pytest.mark.parametrize(("tile", "floor"), [(2048, 0.6), (40, 0.6), (15, 0.9), (15, -0.2)])
def test_pairs_equal_one_matrix(spark, monkeypatch, tile, floor):
    monkeypatch.setattr(V, "TILE_ROWS", tile)
    v = _unit(np.random.default_rng(3), 150)
    dots = v.astype(np.float64) @ v.astype(np.float64).T
    df = spark.createDataFrame(_rows(v), SCHEMA).drop("first", "last")
    got = {(r.a, r.b): r.similarity for r in V.near_pairs_within(df, floor).collect()}
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if dots[a, b] >= floor}
    assert set(got) == want and all(abs(got[a, b] - dots[a, b]) < 1e-6 for a, b in want)
    both = V.near_pairs(df.filter("id % 3 = 0"), df, floor).collect()
    assert len(both) == len({(r.a, r.b) for r in both})
    assert {(r.a, r.b) for r in both} == {(a, b) for a in range(0, 150, 3) for b in range(150) if dots[a, b] >= floor}


def test_spans_keep_every_pair_whose_days_meet(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE_ROWS", 12)
    rng = np.random.default_rng(8)
    v = _unit(rng, 140)
    spans = [(int(a), int(a + w)) for a, w in zip(rng.integers(0, 300, 140), rng.integers(0, 30, 140))]
    df = spark.createDataFrame(_rows(v, spans), SCHEMA)
    got = {(r.a, r.b) for r in V.near_pairs(df, df, 0.7).collect()}
    dots = v.astype(np.float64) @ v.astype(np.float64).T
    near = {(a, b) for a in range(140) for b in range(140) if dots[a, b] >= 0.7}
    meet = {(a, b) for a, b in near if spans[a][0] <= spans[b][1] and spans[b][0] <= spans[a][1]}
    assert meet <= got <= near and len(got) < len(near)


def test_far_tiles_are_never_multiplied(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE_ROWS", 20)
    v = _unit(np.random.default_rng(4), 1500, d=32, centres=40, spread=0.02)
    df = spark.createDataFrame(_rows(v), SCHEMA).drop("first", "last")
    heads = V._heads(df)
    pivots = V.chosen_pivots(heads)
    index = V.indexed(df, heads, pivots)
    tiles = index.tiles.count()
    assert tiles > 60 and index.members.count() == 1500
    assert index.tiles.agg(F.max("n")).first()[0] <= 4 * V.TILE_ROWS
    pairs = V.tile_pairs(index, index, pivots, 0.8, halved=True).count()
    assert tiles <= pairs < tiles * (tiles + 1) / 2 / 6


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0], 0, 0), (2, None, 0, 0)], SCHEMA)
    assert V.near_pairs_within(empty, 0.5).count() == 0 == V.near_pairs(empty, some, 0.5).count() == V.near_pairs(some, empty, 0.5).count()
    assert [(r.a, r.b) for r in V.near_pairs(some, some, 0.5).collect()] == [(1, 1)]


def test_condition_pairs_are_judged_where_they_meet(spark, monkeypatch):
    """no pair is joined or shuffled after its product is known; a common vector spreads over tiles."""
    monkeypatch.setattr(V, "TILE_ROWS", 6)
    monkeypatch.setattr(V, "SQUARES", 4)
    monkeypatch.setattr(V, "CELLS", 10)
    monkeypatch.setattr(V, "OUT_ROWS", 3)
    v = _unit(np.random.default_rng(5), 90)
    article = lambda i: None if i % 17 == 0 else i // 3
    words = lambda i: None if i % 19 == 0 else [f"holder{i % 7}", "x"][: 1 + (i % 11 == 0)]
    rows = [(i, article(i), words(i), [float(x) for x in row]) for i, row in enumerate(v)]
    pairs = C.condition_pairs(spark.createDataFrame(rows, "id long, article_id long, words array<string>, vector array<float>"), 0.75)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]
    dots, want = v.astype(np.float64) @ v.astype(np.float64).T, {}
    for a in range(90):
        for b in range(a + 1, 90):
            both = None if words(a) is None or words(b) is None else sorted(set(words(a)) & set(words(b)))
            if None not in (article(a), article(b)) and article(a) != article(b) and (dots[a, b] >= 0.75 or (dots[a, b] >= 0.6 and both)):
                want[a, b] = both
    found = pairs.collect()
    assert len(found) == len(want) and {(r.a, r.b): r.shared for r in found} == want
    assert sum(1 for (a, b) in want if dots[a, b] < 0.75) > 0
