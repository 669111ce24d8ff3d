import random

from pyspark.sql import functions as F

from antecede.llm import line_dedup as op

SCHEMA = "doc_id long, text string, lang string, _id string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(rng, line, n):
    for _ in range(n):
        at, kind = rng.randrange(len(line) + 1), rng.randrange(3)
        line = line[:at] + rng.choice("abcé") * (kind < 2) + line[at + (kind > 0):]
    return line


def variants(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(18, 60))) for _ in range(12)]
    return sorted({edited(rng, rng.choice(stems), rng.randrange(6)) for _ in range(n)})


def test_edit_distance_equals_the_plain_recurrence(spark):
    rng = random.Random(3)
    rows = []
    for x in variants(1, 150):
        for y in (edited(rng, x, rng.randrange(5)) for _ in range(3)):
            a, b = sorted((x, y), key=len, reverse=True)
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", op.within_edits(F.col("a"), F.col("b")).alias("near")).collect()
    assert {r.near for r in got} == {True, False}
    assert all(r.near == (distance(r.a, r.b) <= op.TAU) for r in got)


def test_near_lines_are_those_of_all_pairs(spark, monkeypatch):
    lines = [x for x in variants(2, 260) if len(x) >= op.MIN_CHARS]
    expected = {frozenset((i, j)) for i, x in enumerate(lines) for j in range(i) if distance(x, y := lines[j]) <= op.TAU}
    assert expected
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    for hot in (64, 2):  # the second splits nearly every key by signature parts
        monkeypatch.setattr(op, "HOT_KEY", hot)
        assert {frozenset((r.a, r.b)) for r in op.near_lines(df).collect()} == expected


def test_lines_drop_after_their_first_occurrence(spark):
    line, near = "a line that is long enough to judge", "a line that is lung enough to judge"
    rows = [(1, f"{line}\nshort\nan own line that nobody else has", "en", "x"), (2, f"short\n{near}\n{line}", "en", "y"),
            (3, None, None, None), (4, "", "en", "z"), (2, f"short\n{near}\n{line}", "en", "y"),
            (None, f"{line}\n{line}", "en", "w")]
    got = op.deduplicated(spark.createDataFrame(rows, SCHEMA).drop("_id").withColumn("extra", F.lit(1))).collect()
    by = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str)
    assert by == sorted([(None, line, 2, 1), (1, "short\nan own line that nobody else has", 3, 1), (2, "short", 3, 2),
                         (2, "short", 3, 2), (3, None, 0, 0), (4, "", 1, 0)], key=str)
    assert got[0].extra == 1


def test_empty_and_very_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.deduplicated(empty).collect() == []
    long = "\n".join(f"the line number {i} of a long text" for i in range(3000))
    row = op.deduplicated(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row.n_lines == 3000 and row.n_dropped > 0


def test_exact_repeats_of_short_lines_go_in_op7_and_the_pipeline(spark, tmp_path):
    import corpus_pipeline
    from antecede.llm.native_queries import op7

    line = "a line that is long enough to judge"
    docs = [(1, f"Les.\n{line}\n  \nHaanth."), (2, f"Les.\n{line}\n  \nHaanth."), (3, f"Les.\n  \nmine\nmine, too"), (4, "Lez.")]
    spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in op7(spark, str(tmp_path)).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("  ", 3), 3: ("  \nmine\nmine, too", 1), 4: ("Lez.", 0)}
    kept = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
