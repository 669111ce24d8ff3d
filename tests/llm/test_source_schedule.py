import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from antecede.llm import source_schedule as op

DOC = "doc_id long, source string, text string, size long, target double, slot long, block long, row long, place long"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 0.5, 1, 2, 3, 4) for r in rows], DOC)


def _targets(sizes):
    """Shares by weight; what passes three times a size is shared again until none does. Exact."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, open_ = {}, dict(weight)
    while open_:
        rest, sharing = sum(sizes.values()) - sum(full.values()), sum(open_.values())
        over = [s for s, w in open_.items() if Fraction(w * rest, sharing) >= 3 * sizes[s]]
        if not over:
            return full | {s: Fraction(w * rest, sharing) for s, w in open_.items()}
        for s in over:
            full[s] = 3 * sizes[s]
            del open_[s]
    return full


def _corpus(seed=3):
    rng = random.Random(seed)
    rows = [(i if i % 13 else None, rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None, ""]),
             rng.choice([None, "", " \n", "w " * rng.randrange(1, 60), "x\ty z"])) for i in range(300)]
    return rows + [(1, "tiny", "one"), (2, "huge", "v " * 9000), *[(k, "huge", "u " * k) for k in range(99, 140)], (5, "none", " ")] + [rows[4]] * 3


@pytest.mark.parametrize(("slots", "most", "small"), [(1 << 20, 4096, 100_000), (256, 4096, 100_000), (1 << 20, 4096, 2)])
def test_sources_come_near_their_targets(spark, monkeypatch, slots, most, small):
    monkeypatch.setattr(op, "SLOTS", slots)
    monkeypatch.setattr("antecede.llm.common.SMALL_ROWS", small)
    rows = _corpus()
    got = op.taken(_docs(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    words = {}
    for _, s, t in rows:
        words[s] = words.get(s, 0) + len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    want = _targets(words)
    total = sum(words.values())
    block = max(-(-total // slots), 1)
    assert abs(sum(want.values()) - total) < 1e-6
    by_size = {(w, round(float(want[s]), 6)): 0 for s, w in words.items()}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_size[r.source_size, round(r.target, 6)] += r.taken
    for (size, target), n in by_size.items():
        assert abs(n - target) < 2 * block + 1 and n <= 3 * size


def test_reruns_agree_whatever_the_partitions(spark):
    docs = _docs(spark, _corpus())
    first = sorted(map(str, op.taken(docs.repartition(5)).collect()))
    assert first == sorted(map(str, op.taken(docs.coalesce(1)).collect()))
    assert first != sorted(map(str, op.taken(docs, seed="other").collect()))


def test_schedule_spreads_every_source_and_visits_each_block_in_turn(spark):
    mix = op.planned(_docs(spark, _corpus(9)))
    slots = sorted(op.schedule(mix.sources).collect())
    sources = {r.place: r for r in mix.sources.collect()}
    total = sum(r.slots for r in sources.values())
    assert len(slots) == total == len({r.slot for r in slots})
    turns, bits = {}, (total - 1).bit_length()
    for k, r in enumerate(slots, 1):
        assert r.turn == turns.get(r.place, 0) and r.block == r.turn % sources[r.place].n_blocks
        turns[r.place] = r.turn + 1
        # The discrepancy of the points, twice over: those beyond the sources are left out.
        assert abs(turns[r.place] - k * sources[r.place].slots / total) <= 2 * (bits + 1)
    whole = op.pieces(mix).filter("size > 0").groupBy("place", "block").agg(F.sum("words").alias("n")).collect()
    assert all(r.n == mix.block for r in whole if r.block < sources[r.place].n_blocks - 1)
    assert sum(r.n for r in whole) == sum(r.source_size for r in sources.values())


@pytest.mark.parametrize("rows", [[], [(1, "a", None), (2, None, "")], [(1, None, "only words here")]])
def test_tables_with_little_in_them(spark, rows):
    got = op.taken(_docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == sorted(
        (i, n, n, float(n), n) for i, _, t in rows for n in [len((t or "").split())])
