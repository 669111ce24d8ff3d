import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import language, pieces, toxicity


def test_toxic_texts_are_found_and_nothing_is_learned_without_labels(spark):
    rng = random.Random(4)
    words, bad = [f"w{i}" for i in range(300)], ["vile", "rotten"]
    rows = [(i, " ".join(rng.choice(words) if rng.random() > 0.05 * (i % 4 == 0) else rng.choice(bad) for _ in range(60)), int(i % 4 == 0))
            for i in range(900)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (5000, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    docs = docs.drop("toxic")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    right = [(got[i] >= 0.3) == bool(t) for i, x, t in rows if not t or any(b in x for b in bad)]
    assert sum(right) / len(right) > 0.95 and got[None] == got[5000] and len(got) == 902
    assert toxicity.fitted(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}


def _kneser_ney(train, text):
    """Toxic less ordinary log-likelihood of a text, from the definition."""
    split = lambda t: [w.strip(toxicity.STRIP.decode()) for w in t.lower().split()]
    pairs = {0: {}, 1: {}}
    for t, label in train:
        found = split(t)
        for v, w in zip(["<s>", *found], found):
            pairs[label][v, w] = pairs[label].get((v, w), 0) + 1
    every = pairs[0].keys() | pairs[1].keys()
    size, d = len({w for _, w in every}) + 1, toxicity.DISCOUNT

    def p_word(label, w):
        shared = (sum(x == w for _, x in every) + 0.5) / (len(every) + 0.5 * size)
        kinds = sum(x == w for _, x in pairs[label])
        return (max(kinds - d, 0) + d * len({x for _, x in pairs[label]}) * shared) / len(pairs[label])

    def p(label, v, w):
        seen = sum(n for (x, _), n in pairs[label].items() if x == v)
        back = d * sum(x == v for x, _ in pairs[label]) / seen if seen else 1.0
        return max(pairs[label].get((v, w), 0) - d, 0) / max(seen, 1) + back * p_word(label, w)

    found = split(text)
    return sum(math.log(p(1, v, w)) - math.log(p(0, v, w)) for v, w in zip(["<s>", *found], found))


@pytest.mark.parametrize("head", [400_000, 5, 0])
def test_ratios_equal_the_definition_whatever_is_broadcast(spark, monkeypatch, head, peaks=[]):  # noqa: B006 - compared over the heads
    monkeypatch.setattr(toxicity, "HEAD", head)
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", 0 if head == 5 else 1000)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(25)] + ["vile", "Rotten!"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert len(model.keys) <= head
    train = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    texts = ["vile", "vile rotten", "never seen words", "w1 w2 w3 vile w1 w2", rows[3][1], "", None, "w5 " * 3000]
    asked = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id long, text string")
    rows = toxicity._ratios(asked, model, ["id"]).collect()
    got = sorted((r.id, r.n, r.ratio) for r in rows)
    peaks.append(sorted((r.id, round(r.peak, 4)) for r in rows))
    assert all(p >= 0 for _, p in peaks[-1]) and len({str(p) for p in peaks}) == 1
    assert len(got) == len(texts) + 1
    for i, n, ratio in got:
        want = _kneser_ney(train, texts[i] or "")
        assert n == len((texts[i] or "").split()) and abs(ratio - want) < 1e-4 * (1 + abs(want))
    clash = asked.withColumns({"score": F.lit("old"), "text_hash": F.lit(1)})
    out = toxicity.scored(clash, model)
    assert set(out.columns) == {"id", "text", "text_hash", "score"} and out.count() == len(texts) + 1
    assert toxicity.without(clash, model, 0.5).count() == out.filter("score < 0.5").count()
    assert toxicity.without(clash, model, 0.5).columns == clash.columns


def _ppm_bits(text, counts, order=3, size=None):
    data, bits = b"\n" * 3 + text.encode(), 0.0
    for i in range(3, len(data)):
        scale = 1.0
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k:i], {})
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(scale * seen[data[i]] / (n + d))
                break
            if n:
                scale *= d / (n + d)
        else:
            bits -= math.log2(scale / size)
    return bits


def test_code_lengths_equal_the_plain_recursion(spark):
    train = {"xx": ["abra cadabra", "abba"], "yy": ["zig zag zoo", "ozzy"]}
    model = language.fitted(spark.createDataFrame([(t, k) for k, v in train.items() for t in v], "text string, lang string"))
    assert model.languages == ["xx", "yy"]
    texts = ["abra", "zag zoo", "cab zig", "q", ""]
    got = language.code_lengths(model, texts) / language.BITS
    for k, lang in enumerate(model.languages):
        counts = {}
        for t in train[lang]:
            data = b"\n" * 3 + t.encode()
            for i in range(3, len(data)):
                for n in range(4):
                    at = counts.setdefault(data[i - n:i], {})
                    at[data[i]] = at.get(data[i], 0) + 1
        for row, text in enumerate(texts):
            assert abs(got[row, k] - _ppm_bits(text, counts, size=256)) < 0.02 * max(1, len(text)), (lang, text)


def test_shards_code_as_one_table_does(spark, monkeypatch):
    rng = random.Random(2)
    letters = {"aa": "abcde fgh", "bb": "zyxw vuabé", "cc": "字符 文本ab"}
    rows = [("".join(rng.choice(letters[k]) for _ in range(90)), k) for k in letters for _ in range(60)]
    train = spark.createDataFrame(rows, "text string, lang string")
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, (t, _) in enumerate(rows[::7] + [("", ""), ("é", ""), ("new ünseen words", "")])]
                                 + [(None, None, "x", 2.5)], "doc_id long, text string, bits string, row double")
    shown = lambda: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9), r.bits, r.row) for r in language.identified(
        docs, language.fitted(train)).collect())
    whole = shown()
    right = [r[1] == k for r, (_, k) in zip(sorted(whole, key=lambda r: int(r[0]) if r[0] != "None" else 999), rows[::7])]
    assert all(right) and whole[-1][1] == "und"
    monkeypatch.setattr(language, "SHARD", 900)
    monkeypatch.setattr(language, "STEP", 50)
    assert language.fitted(train).shards > 3 and shown() == whole


def test_language_of_odd_texts(spark):
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.fitted(rows)
    docs = spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, None), (4, "12 34!"), (5, ""), (6, "the cat " * 30_000), (7, "² ½ Ⅷ ①")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs, model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["en", "fr", "und", "und", "und", "en", "und"] and got[3][1] == 0 and got[6][1] == 1
    assert language.fitted(rows.limit(0)) is None
    assert {r.lang_pred for r in language.identified(docs, None).collect()} == {"und"}


def _vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def test_sampling_follows_the_posterior_of_the_lattice():
    v = _vocabulary()
    v.weight = np.full(len(v.weight), -1.0)  # even weights, so that long segmentations occur
    word, n = "nation", 30_000
    ids = {b.decode(): i for i, b in enumerate(v.bytes_of) if b and i > 258}

    def ways(at):
        if at == len(word) + 1:
            yield ()
        for end in range(at + 1, len(word) + 2):
            if (" " + word)[at:end] in ids:
                for rest in ways(end):
                    yield (ids[(" " + word)[at:end]], *rest)

    weights = {w: math.exp(-len(w)) for w in ways(0)}
    total = sum(weights.values())
    counts = {}
    for s in pieces.encoded([word] * n, np.arange(n), v):
        counts[tuple(s.tolist())] = counts.get(tuple(s.tolist()), 0) + 1
    assert set(counts) <= set(weights) and len(weights) > 20
    assert all(abs(counts.get(w, 0) / n - p / total) < 5 * math.sqrt(p / total / n) + 1e-4 for w, p in weights.items())


def test_segmentation_is_lossless_and_independent_of_batches(spark):
    rng = random.Random(6)
    odd = ["", " ", "  a  b ", "line\nbreak\ttab", "▁mark ▁", "emoji 😀 é", "\u0000\u0001", "x" * 3000, None]
    texts = odd + ["".join(rng.choice("ab é\n▁字") for _ in range(rng.randrange(80))) for _ in range(60)] + ["word " * 20_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, "", "clash"), (None, "no key", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    one = {(r.doc_id, r.text): r for r in pieces.with_pieces(df.repartition(1)).collect()}
    many = {(r.doc_id, r.text): r for r in pieces.with_pieces(df.repartition(7)).collect()}
    assert all(r.decoded == r.text and r.piece_ids == many[k].piece_ids for k, r in one.items()) and len(one) == len(texts) + 1
    assert pieces.with_pieces(df.limit(0)).collect() == []


def test_collected_columns_follow_the_order_of_the_key(spark):
    rows = [(9, 0.5, 1), (-3, 1.5, 2), (4, 2.5, 3)]
    w, p, n = toxicity._columns(spark.createDataFrame(rows, "w long, p double, n long"), "w", ["p", "n"])
    assert list(zip(w, p, n)) == sorted(rows)
    assert all(len(x) == 0 for x in toxicity._columns(spark.createDataFrame([], "w long, p double"), "w", ["p"]))


def test_spent_tables_of_a_fit_are_deleted(spark, monkeypatch):
    made, store = {}, toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, name: made.setdefault(name, store(df, name)))
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} " + "vile" * (i % 2)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.fitted(docs, labels) is not None
    left = lambda name: spark._jvm.org.apache.hadoop.fs.Path(made[name].checkpoint_path).getFileSystem(
        spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(made[name].checkpoint_path))
    assert [left(n) for n in ("bigrams", "follows", "precedes", "entries")] == [False, False, False, True]
