import random

import pytest

from antecede.llm import signature_trees as op

DOC = "doc_id long, text string, component_id string"


def _set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def _brute(rows, width, percent):
    ids = sorted({i for i, _ in rows})
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, _set(t, width)) for i, t in rows]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(x), find(i)) for i, x in sets}


def _texts(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    stems = [[rng.choice(words) for _ in range(rng.randrange(2, 90))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for i in range(n):
        text = list(rng.choice(stems[:2] if i % 3 == 0 else stems))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text + passage * (i % 5 == 0)) if i % 17 else ("" if i % 2 else None))
    return [*out, "one", "ONE", "one two", "tab\tand\nbreak of words here", "Tab and break OF words here", "long " * 5000 + "end"]


@pytest.mark.parametrize(("width", "percent", "block", "hot"), [(4, 85, 2048, 32), (4, 85, 16, 0), (5, 80, 24, 32)])
def test_classes_equal_all_pairs(spark, monkeypatch, width, percent, block, hot):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "HOT_LEAST", hot)
    rows = list(enumerate(_texts(block, 260)))
    rows += [(i, t) for i, t in rows[:5]]  # repeated rows
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOC)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op.classes(df, width, percent).collect()}
    assert got == _brute(rows, width, percent)


def test_empty_tables_and_null_ids(spark):
    df = spark.createDataFrame([], DOC)
    assert op.classes(df).collect() == []
    rows = [(None, "a b c d e", ""), (3, "a b c d e", ""), (2, None, "")]
    got = {r.doc_id: r.component_id for r in op.classes(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {None: 3, 3: 3, 2: 2}  # a null id names a class only where no other does
    lone = [(None, "a b c d e", ""), (None, "a b c d e f g h", "")]
    assert [r.component_id for r in op.classes(spark.createDataFrame(lone, DOC)).collect()] == [None, None]


def test_rows_without_an_id_or_with_a_shared_one_meet_by_their_texts_only(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    hot = [(None, a), (1, a), (2, a + " more"), (None, b), (None, b + " more")]
    for rows, kept in (([*hot, (4, c)], [(1, a), (4, c)]),
                       ([*hot, (4, c), (7, c), (7, d), (8, d + " more")], [(1, a), (4, c), (7, d)])):
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in op.classes(df).collect())
        # The class of text a holds a null id and is named by the smallest other.
        assert got[:5] == [(0, 27, 0), (0, 27, 1), (0, 28, 0), (1, 27, 1), (2, 28, 1)]
        assert got[5:] == ([(4, 27, 4)] if len(rows) == 6 else [(4, 27, 4), (7, 27, 4), (7, 27, 7), (8, 28, 7)])
        out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()]
        without_id = [t for i, t in out if i is None]
        assert sorted(x for x in out if x[0] is not None) == kept
        assert len(without_id) == 1 and without_id[0] in (b, b + " more")
