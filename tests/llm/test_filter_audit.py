import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import filter_audit as op

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, mask string"
LABEL = "doc_id long, quality int, toxic int"
SPACE = " \t\n\v\f\r"


def _words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _fails(text):
    ws = _words(text)
    return [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text)]


def _brute(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = [(lang or "", [*_fails(t or ""), i is not None and i > first[t or ""]], i in good and i is not None, i in toxic and i is not None)
            for i, t, lang, *_ in docs]
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations(range(5)):
            left = [r for r in rows if r[0] == part]
            seen = []
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in seen), sum(r[0] == part and r[1][f] and sum(r[1]) == 1 for r in rows),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                seen += gone
    return {k: (*v[:6], total[k[0], v[6]]) for k, v in out.items()}


def _audit(spark, docs, labels):
    checks = op.text_checks(F.col("text"))
    counts = op.repeats_counted(op.masked(spark.createDataFrame(docs, DOC), checks), spark.createDataFrame(labels, LABEL), 4)
    rows = op.audited(counts, "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in op.COUNTS) for r in rows}, rows


def test_equals_removing_one_filter_at_a_time(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["one", "TWO", "three$", "vier", f"w{k}"]) + str(rng.randrange(90)) for _ in range(rng.choice([5, 99, 100, 180])))
            for k in range(14)]
    base += [None, "", "A", " x", "LOUD\t" * 120, "same " * 400, "#", "x " * 30_000]
    docs = [(i if i % 11 else None, rng.choice(base), rng.choice(["en", "de", None, ""]), "s", 1, "clash", "clash") for i in range(160)]
    docs += [(3, base[0], "en", "s", 1, "p", "m")] * 4 + [docs[7]] * 3  # repeated ids and rows
    labels = [(i, i % 3 == 0, None if i % 5 else 1) for i in range(0, 170, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1)]
    labels = [(i, None if q is None else int(q), t) for i, q, t in labels]
    got, rows = _audit(spark, docs, labels)
    assert got == _brute(docs, labels)
    assert len(rows) == 3 * 600 and all(r.filter == r.filter_order[r.step - 1] for r in rows)


def test_empty_tables_give_no_rows(spark):
    assert _audit(spark, [], [])[0] == {}
    assert len(_audit(spark, [(1, None, None, None, None, None, None)], [])[0]) == 600


@pytest.mark.parametrize("k", [1, 3, 4])
def test_steps_are_the_first_failing_filters(k):
    fails = (np.arange(2 ** k)[:, None] >> np.arange(k) & 1).astype(bool)
    orders = list(permutations(range(k)))
    steps = op.removal_steps(fails, np.argsort(np.array(orders), 1) + 1)
    for m in range(2 ** k):
        for o, order in enumerate(orders):
            assert steps[m, o] == next((s for s, f in enumerate(order, 1) if fails[m, f]), k + 1)
