from datetime import date
from math import sqrt

from antecede.operators import candidates as N

SCHEMA = ("node long, kind string, best date, start date, end date, articles array<long>, actors array<string>, targets array<string>, "
          "locations array<string>, sentence string, vector array<double>")


def node(spark, *rows):
    def row(n, day, articles, actors, places, sentence, vector):
        when = date(2024, 1, day)
        return n, "event", when, when, when, articles, actors, [], places, sentence, vector

    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)


def test_every_pair_is_proposed_once_by_what_it_shares(spark):
    edge = 0.44997  # 0.45 once rounded
    nodes = node(
        spark, (1, 10, [7], ["Union Alpha"], ["Riverton"], "union alpha marched", [1.0, 0.0, 0.0]),
        (2, 8, [8], ["Other"], ["Elsewhere"], "nothing shared", [edge, sqrt(1 - edge ** 2), 0.0]),
        (3, 8, None, ["Alpha"], ["Riverton"], "alpha marched", [0.0, 0.0, 1.0]),
        (4, 8, [9], ["Else"], ["Nowhere"], "nothing", [0.0, 0.0, 1.0]),
        (5, 1, [7], ["Union Alpha"], ["Riverton"], "nothing", [0.0, 0.0, 1.0]))
    seeds = nodes.filter("node = 1")
    got = sorted((r.cause, r.same_article, r.actors, r.locations, r.shared_names, r.similarity)
                 for r in N.candidate_claims(seeds, nodes, 180).collect())
    assert got == [(2, 0, 0, 0, 0, 0.45), (3, 0, 1, 1, 1, 0.0), (5, 1, 2, 1, 2, 0.0)]
    edges = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    assert [r.cause for r in N.candidate_claims(seeds, nodes, 180, edges).collect()] == [5]


def test_missing_ids_are_counted_in_one_pass(spark):
    """no join keeps both sides; an id comes out once, a null id equals none."""
    from antecede.operators.review import missing_ids

    side = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    found = missing_ids(side([1, 1, 2, 3, None]), side([2, 4, 4, None, None]), "id")
    assert sorted((r.id or 0, r.problem) for r in found.collect()) == [
        (0, "missing"), (0, "unexpected"), (1, "missing"), (3, "missing"), (4, "unexpected")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert missing_ids(side([5, 6]), side([6, 5, 5]), "id").isEmpty()


def test_pairs_of_tiles_are_those_of_all_pairs(spark, monkeypatch):
    """Pairs come from products and postings of two tiles; none is listed for each of its words and weeks first."""
    import numpy as np
    from datetime import timedelta

    for name, value in (("SEED_TILE", 16), ("CAUSE_TILE", 24), ("LEAST_TILE", 8), ("CELLS", 64)):
        monkeypatch.setattr(N, name, value)
    draw = np.random.default_rng(5)
    some = lambda values, p=0.8: values[draw.integers(0, len(values))] if draw.random() < p else None
    days = [date(2024, 1, 1) + timedelta(i) for i in range(30)]
    vectors = draw.normal(size=(15, 3))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]

    def row(i):
        best = some(days, 0.95)
        kind = ["event", "event", "condition"][draw.integers(0, 3)]
        texts = lambda: [" ".join(draw.choice(words, 2))] if draw.random() < 0.5 else None
        return (i - i % 9 // 8, kind, best, some([best, days[0]]), some([best, days[-1]]), some([[int(draw.integers(0, 30))], [3, None, 3], []]),
                texts(), texts(), texts(), some([" ".join(draw.choice(words, 3))]), some(vectors.tolist()))

    nodes = spark.createDataFrame([row(i) for i in range(120)], SCHEMA)
    seeds = nodes.filter("node % 3 = 0")
    got = sorted(tuple(r) for r in N.candidate_claims(seeds, nodes, 12).select(
        "seed", "cause", "cause_kind", "same_article", "actors", "locations", "shared_names", "similarity").fillna(-9.0, ["similarity"]).collect())
    every = N.with_evidence(nodes).collect()
    expected = []
    for s in (r for r in every if r.node % 3 == 0):
        for c in every:
            if s.best is None or c.best is None or s.node == c.node:
                continue
            gap = (s.best - c.best).days
            holds = None not in (c.start, c.end) and c.start <= s.best <= c.end
            condition = c.kind == "condition"
            if gap < 0 or not (holds if condition else gap <= 12 or holds):
                continue
            both = lambda f, g: set(s[f] or []) & set(c[g] or [])  # noqa: E731, B023
            art, act, loc = (len(both(f, f)) for f in ("articles", "actor_words", "place_words"))
            names = len(both("name_words", "sentence_words") | both("sentence_words", "name_words"))
            alike = None if None in (s.vector, c.vector) else round(round(float(np.dot(s.vector, c.vector)), 9), 4)
            near = gap <= N.WINDOW_DAYS or holds
            listed = art > 0 or (act + loc + names > 0 and near and not condition)
            if condition:
                close = alike is not None and alike >= N.CONDITION_SIMILARITY
            else:
                close = alike is not None and (alike >= N.SIMILARITY_FLOOR if near else alike >= N.FAR_SIMILARITY and act + loc > 0)
            if (art > 0 if s.kind == "condition" else listed or close):
                expected.append((s.node, c.node, c.kind, art, act, loc, names, -9.0 if alike is None else alike))
    assert got == sorted(expected) and len(got) > 300
    assert "Generate" not in N.met_pairs(*N.coded(seeds, nodes), 12)._jdf.queryExecution().executedPlan().toString()
