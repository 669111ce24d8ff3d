import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from antecede.llm import merkle as op
from antecede.llm.audit_queries import tampered_proofs

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, row long, at long"


def _h(text):
    return sha256(text.encode()).hexdigest()


def _leaf(*values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _way(levels, at):
    for level in levels[:-1]:
        first = at - at % 8
        yield "".join(level[first:at]), "".join(level[at + 1:first + 8])
        at //= 8


def _brute(rows):
    trees = {}
    for i, text, lang, source, n, *_ in rows:
        leaf, seen = _leaf(i, source, lang, n, text), text
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
            seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf, _leaf(i, source, lang, n, seen), i))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {name: _levels([r[2] for r in sorted(trees[name])]) for name in names}
    top = _levels([made[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, (_, _, leaf, shown, i) in enumerate(sorted(trees[name])):
            way = [*_way(made[name], at), *_way(top, place)]
            for left, right in way:
                shown = _h(left + shown + right)
            root = top[-1][0]
            out.append((i, leaf, made[name][-1][0], root, _h("".join(a + b for a, b in way)), shown, shown == root))
    return sorted(map(str, out))


def _run(spark, rows, levels=op.LEVELS):
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOC).repartition(3)
    got = tampered_proofs(docs, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(str(tuple(r)) for r in got)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equals_plain_trees(spark, levels):
    rng = random.Random(levels)
    langs = [None, "", "en", "en", "en", "de", "é", "Z"] + [f"l{k}" for k in range(12)]
    rows = [(i if i % 17 else None, rng.choice([None, "", "Shout", "quiet", "É\tB"]) if i % 3 else f"Text {i}", rng.choice(langs),
             rng.choice([None, "s", "ß"]), i if i % 5 else None) for i in range(700)]
    rows += [rows[5]] * 9 + [(3, "again", "en", None, 1), (-4, "x", "en", "", 0), (9, "Long " * 40_000, "solo", "s", 5)]
    assert _run(spark, rows, levels) == _brute(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_sizes_around_a_run(spark, n):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    assert _run(spark, rows) == _brute(rows)


def test_layout_is_a_permutation_that_keeps_subtrees_together():
    for height, layout in op.LAYOUTS.items():
        places = [p for level in layout for p in level.tolist()]
        assert sorted(places) == list(range((8 ** height - 1) // 7)) and layout[0][0] == 0
        if height > 1:  # a bottom subtree lies in one stretch
            top = height // 2
            size = (8 ** (height - top) - 1) // 7
            for root in range(8 ** top):
                inside = [int(p) for d in range(top, height) for p in layout[d][root * 8 ** (d - top): (root + 1) * 8 ** (d - top)]]
                assert max(inside) - min(inside) == size - 1


def test_a_changed_digest_is_found(spark):
    leaves = spark.range(500).select(F.lit("t").alias("name"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("leaf"))
    shown = leaves.withColumn("shown", F.when(F.col("doc_id") == 77, F.unhex(F.lit("00" * 32))).otherwise(F.col("leaf")))
    wrong = op.proved(op.manifest(shown)).filter("folded_root <> root").collect()
    assert [r.doc_id for r in wrong] == [77]
