import random
import re
from collections import Counter

import pandas as pd

from antecede.llm import quality_model, quality_rules

DOC = "doc_id long, text string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_counting(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\n\nx\n x\n", "é # | à" * 3]
    texts += [" ".join(rng.choice(["a", "b", "cé", "d#", "e\n", "\t"]) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts += ["word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.measured(df).collect()}
    assert got == {i: _measures(t) for i, t in enumerate(texts)}


def test_the_verdict_does_not_depend_on_the_order_of_rules(spark):
    rng = random.Random(2)
    plain = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    texts = [plain, plain.upper(), plain.replace(" ", " ### "), "short", None, "\n".join(["one line that repeats often enough"] * 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    first = sorted((r.doc_id, r.kept) for r in quality_rules.cascade(df).collect())
    turned = sorted((r.doc_id, r.kept) for r in quality_rules.cascade(df, quality_rules.RULES[::-1]).collect())
    assert first == turned and [k for _, k in first[::2]] == [True, False, False, False, False, False]
    order = quality_rules.ordered_rules(df)
    gains = [share / cost for _, cost, share in order]
    assert gains == sorted(gains, reverse=True)
    assert quality_rules.cascade(df.limit(0)).collect() == []


def test_quality_model_separates_held_out_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, " ".join(rng.choice(words) + ("" if good else rng.choice(["%%", "&&"])) for _ in range(30)), int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9999, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 400], "doc_id long, quality int, toxic int")
    weights = quality_model.fitted(docs, labels)
    assert (weights == quality_model.fitted(docs, labels)).all()
    got = {r.doc_id: r.s for r in quality_model.scored(docs.drop("score"), weights).withColumnRenamed("score", "s").collect()}
    held = pd.Series({i: (got[i] >= 0.5) == bool(q) for i, _, q in rows if i >= 400})
    assert held.mean() > 0.97 and got[None] == got[9999] and all(0 <= s <= 1 for s in got.values())
    none = quality_model.fitted(docs, labels.limit(0))
    assert {r.score for r in quality_model.scored(docs.drop("score"), none).collect()} == {0.5}
