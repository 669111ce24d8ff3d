import random

from antecede.llm import decontamination as op

ITEM = "A train leaves the northern station at 9 with 40 guests and Anna pays 40 euros for the long trip home"
SWAPPED = "A train leaves the northern station at 7 with 55 guests and Maria pays 55 euros for the long trip home"
BROKEN = "A train leaves the northern station at 7 with 55 guests and Maria pays 60 euros for the long trip home"
DOC = "doc_id long, text string, lang string, item_id string"
BENCH = "item_id long, text string, extra int"


def _flags(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame([(i, t, "en", "clash") for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], BENCH)
    return {(r.doc_id, r.contaminated, r.item_id, r.reparameterised) for r in op.flagged(d, b).collect()}


def test_copies_and_swapped_values_are_caught_and_inconsistent_slots_are_not(spark):
    docs = [(1, f"Something before. {ITEM}. Something after."), (2, f"intro words, {SWAPPED}"), (3, BROKEN),
            (4, "nothing of the kind is said in this short text about trains"), (5, None), (6, ""), (None, ITEM),
            (7, ITEM.upper()), (1, f"Something before. {ITEM}. Something after.")]
    assert _flags(spark, docs) == {
        (1, True, 1, False), (2, True, 1, True), (3, False, None, False), (4, False, None, False), (5, False, None, False),
        (6, False, None, False), (None, True, 1, False), (7, True, 1, False)}


def test_shouted_and_title_case_copies_are_caught(spark):
    other = "the quick meeting of old friends near Paris took 3 hours and cost each guest a small fortune in tea"
    docs = [(1, "Loud text. " + ITEM.upper() + " AND MORE OF IT"), (2, ITEM.title()), (3, "So it went: " + other.upper()), (4, other.title()),
            (5, "A PLAIN SHOUTED TEXT WITHOUT ANY OF THE ITEMS IN IT AT ALL"), (6, BROKEN.upper())]
    assert {(i, c, item) for i, c, item, _ in _flags(spark, docs, ((1, ITEM), (2, other)))} == {
        (1, True, 1), (2, True, 1), (3, True, 2), (4, True, 2), (5, False, None), (6, False, None)}


def test_clashing_columns_stay(spark):
    d = spark.createDataFrame([(1, ITEM, "x", 5), (2, "clean text", "y", 6)], "doc_id long, text string, _id string, _th int")
    b = spark.createDataFrame([(1, ITEM, 0)], BENCH)
    kept = op.clean(d, b)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", "y", 6)]


def _plain(text):
    """Lower-case words with digits only, as the brute-force search reads them."""
    return [w.strip(".,!?:;").lower() for w in (text or "").split()]


def test_documents_that_hold_thirteen_words_of_an_item_are_flagged(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("gar", "hel", "mon", "pit", "rus", "tav", "wol") for b in ("an", "em", "ik", "od", "ul", "yr")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice([14, 20, 30]))) for i in range(12)]
    docs = []
    for i in range(120):
        text = line(rng.randrange(0, 40))
        if i % 3 == 0:
            item = rng.choice(items)[1].split()
            at = rng.randrange(0, max(1, len(item) - 16))
            part = " ".join(item[at: at + rng.randrange(9, 20)])
            text += " " + rng.choice([str, str.upper, str.title])(part) + " " + line(5)
        docs.append((i, text))
    runs = {tuple(_plain(t)[k: k + 13]) for _, t in items for k in range(len(_plain(t)) - 12)}
    want = {i for i, t in docs if any(tuple(_plain(t)[k: k + 13]) in runs for k in range(len(_plain(t)) - 12))}
    got = {r[0] for r in _flags(spark, docs, items) if r[1]}
    assert want and got == want


def test_part_of_an_item_needs_enough_tokens(spark):
    words = ITEM.split()
    assert _flags(spark, [(1, " ".join(words[:12]))]) == {(1, False, None, False)}
    assert _flags(spark, [(1, " ".join(words[:13]))]) == {(1, True, 1, False)}


def test_short_equal_and_missing_items(spark):
    short = "only five plain words here"
    items = [(9, short), (4, short), (5, None), (6, ""), (7, "12 13")]
    assert _flags(spark, [(1, f"see {short} now"), (2, "12 13")], items) == {(1, True, 4, False), (2, False, None, False)}
    assert _flags(spark, [(1, ITEM)], []) == {(1, False, None, False)}
    assert _flags(spark, []) == set()


def test_shuffled_join_equals_the_broadcast_one_and_clean_keeps_columns(spark, monkeypatch):
    d = spark.createDataFrame([(1, ITEM, "en", "a"), (2, "clean text", "en", "b")], DOC)
    b = spark.createDataFrame([(1, ITEM, 0)], BENCH)
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", 0)
    kept = op.clean(d, b)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", "en", "b")]


def test_a_passage_in_a_third_of_a_very_long_table(spark):
    rows = [(i, (f"word{i} " * 50) + (ITEM if i % 3 == 0 else "")) for i in range(300)] + [(1000, "filler " * 50_000 + ITEM)]
    assert sum(r[1] for r in _flags(spark, rows)) == 101
