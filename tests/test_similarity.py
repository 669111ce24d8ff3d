import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.operators import components, mentions as M, similarity as S
from antecede.operators.ordering import with_position, with_running_total
from antecede.operators.similarity import dot


def test_near_duplicate_groups_match_all_pairs(spark):
    """A third of the texts are copies or near copies of one text."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for i in range(90):
        if i % 3 == 0:
            t = list(base)
            for _ in range(i % 5):
                t[rng.randrange(60)] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        texts.append(" ".join(t))
    texts += texts[:20]

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["component"] for r in S.duplicate_groups(df, "id", "text", []).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_common_shingles_come_last_and_one_shuffle_finds_prefixes(spark, monkeypatch):
    """all shingles are not shuffled to be counted and sorted; any order of them finds every pair."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(14)]
    base = [rng.choice(words) for _ in range(45)]
    texts = []
    for i in range(70):
        t = list(base) if i % 4 == 0 else [rng.choice(words) for _ in range(rng.randrange(5, 45))]
        for _ in range(i % 3):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t[: len(t) - i % 5] + passage if i % 2 else t)
    grams = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    alike = {(a, b) for a in range(70) for b in range(a + 1, 70) if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    groups = components.connected_components(spark.createDataFrame(sorted(alike), "a long, b long"))
    want = {r.node: r.component for r in groups.collect()}
    for often, common in ((2, 1 << 18), (2, 3), (1000, 5)):
        monkeypatch.setattr(S, "OFTEN", often)
        monkeypatch.setattr(S, "COMMON", common)
        links = S.near_duplicate_links(df, "id", "text").collect()
        assert {(r.a, r.b) for r in links} <= alike | {(b, a) for a, b in alike}
        found = components.connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"))
        assert {r.node: r.component for r in found.collect()} == want
    sets = df.select("id", S.word_list(F.col("text")).alias("words")).select("id", F.array_sort(S.shingle_hashes("words")).alias("shingles"))
    plan = S._prefixes(sets.withColumn("size", F.size("shingles")), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_nodes_are_scored_where_their_tokens_lie(spark, monkeypatch):
    """no question and node meet in a shuffle; rows of one node still add up."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(40)]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(0, most)))
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else text(30), 1 + i % 3) for i in range(80)], "node long, text string, copies int")
    asked = spark.createDataFrame([(f"q{i}", text(8)) for i in range(12)] + [("none", "unheard")], "question_id string, question string")
    rows = lambda df: {(r.question_id, r.node): r.score for r in df.collect()}
    monkeypatch.setattr(S, "POSTINGS", 7)
    found = S.bm25_scores(docs, asked)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == len(rows(found)) > 200
    again = docs.unionByName(docs.filter("node = 5"))
    twice = rows(S.bm25_scores(again, asked))
    monkeypatch.setattr(S, "ASKED", 0)
    assert rows(found) == pytest.approx(rows(S.bm25_scores(docs, asked)), abs=2e-6)
    assert twice == rows(S.bm25_scores(again, asked))


def test_tiled_cosine_matches_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 7)  # many tiles per block
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(0 if i < 40 else 1, i, [float(x) for x in v[i]]) for i in range(50)]
    df = spark.createDataFrame(rows, "block int, id long, vector array<double>")
    got = {(r["a"], r["b"]) for r in S.cosine_pairs(df, 0.4).collect()}
    want = {(a, b) for a in range(50) for b in range(a + 1, 50)
            if (a < 40) == (b < 40) and v[a] @ v[b] >= 0.4}
    assert got == want


def test_positions_and_running_totals(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("v"))
    placed = with_position(df, [F.col("k")]).collect()
    assert all(r["position"] == r["k"] + 1 for r in placed)
    totals = {r["k"]: r["before"] for r in with_running_total(df, [F.col("k")], F.col("v")).collect()}
    values = {r["k"]: r["v"] for r in df.collect()}
    assert all(totals[k] == sum(values[j] for j in range(k)) for k in (0, 1, 17, 499))


def test_pairs_never_cross_article_status_type_or_time(spark):
    import datetime as dt

    day, far = dt.date(2024, 3, 21), dt.date(2024, 3, 31)

    def row(mid, article, kind="17", status="asserted", when=day):
        return (mid, article, kind, status, ["the ED"], [], [], "arrested", when, when, when, "high")

    rows = [row("1:1", "1"), row("1:2", "1"), row("2:1", "2"), row("3:1", "3", kind="14"),
            row("4:1", "4", status="announced"), row("5:1", "5", when=far), row("6:1", "6", kind=None)]
    df = spark.createDataFrame(rows, "mention_id string, article_id string, event_type string, status string, "
                               "actors array<string>, targets array<string>, locations array<string>, action string, "
                               "best date, start date, end date, confidence string")
    got = {(r["a"]["mention_id"], r["b"]["mention_id"]) for r in M.candidate_pairs(df).collect()}
    assert got == {("1:1", "2:1"), ("1:2", "2:1"), ("1:1", "6:1"), ("1:2", "6:1"), ("2:1", "6:1"), ("3:1", "6:1")}


def test_all_pairs_are_scored_without_a_common_word_too(spark):
    import datetime as dt

    import numpy as np

    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(12, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]

    def row(i):
        best = dt.date(2024, 3, 1) + dt.timedelta(int(draw.integers(0, 16)))
        pick = lambda name, n: [f"{name}{draw.integers(0, n)}"] if draw.random() < 0.7 else []
        return (i, i // 2, [None, "14", "17"][draw.integers(0, 3)], "asserted", pick("actor", 9), pick("target", 9), pick("place", 9),
                (pick("acted", 9) or [None])[0], best, best - dt.timedelta(int(draw.integers(0, 9))), best + dt.timedelta(int(draw.integers(0, 9))),
                ["high", "low"][draw.integers(0, 2)], vectors[draw.integers(0, 12)].tolist())

    rows = [row(i) for i in range(90)]
    df = spark.createDataFrame(rows, "mention_id long, article_id long, event_type string, status string, actors array<string>, "
                               "targets array<string>, locations array<string>, action string, best date, start date, end date, "
                               "confidence string, vector array<double>")
    found = M.scored_pairs(df, dot(F.col("a.vector"), F.col("b.vector")), "vector", 0.25)
    got = {(r.a, r.b): r.score for r in found.collect()}
    sets = {r.mention_id: r for r in M.with_words(df).collect()}
    a, b = (F.struct("*").alias(n) for n in "ab")
    every = df.transform(M.with_words).select(a).crossJoin(df.transform(M.with_words).select(b)).filter("a.mention_id < b.mention_id")
    scores = every.select("a.mention_id", F.col("b.mention_id").alias("other"), M.pair_score(F.round(F.round(
        dot(F.col("a.vector"), F.col("b.vector")), 9), 4)).alias("score")).collect()
    day = dt.timedelta(1)
    expected = {}
    for i, j, score in scores:
        x, y = sets[i], sets[j]
        fits = x.event_type is None or y.event_type is None or x.event_type == y.event_type
        if x.article_id != y.article_id and fits and x.start <= y.end + day and y.start <= x.end + day and (
                score >= 0.25 or set(x.words) & set(y.words)):
            expected[i, j] = score
    assert got == expected and any(not set(sets[i].words) & set(sets[j].words) for i, j in got)


def test_pairs_are_joined_without_being_shuffled(spark):
    df = spark.createDataFrame([], "mention_id long, article_id long, event_type string, status string, actors array<string>, "
                               "targets array<string>, locations array<string>, action string, best date, start date, end date, confidence string")
    plan = M.candidate_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


@pytest.mark.parametrize("held", [8, 1 << 20])
def test_thinned_edges_keep_the_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    edges = spark.range(4000).select((F.col("id") * 7919 % 120).alias("a"), (F.col("id") * 104729 % 131 + 60).alias("b"))
    few = components.thinned(edges)
    whole = lambda df: {tuple(r) for r in components.connected_components(df).collect()}
    assert whole(few) == whole(edges) and (held == 8 or few.count() <= 190 * edges.rdd.getNumPartitions())
