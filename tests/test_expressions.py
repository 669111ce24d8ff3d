import datetime as dt

import pytest
from pyspark.sql import functions as F

from antecede.functions import quality as T, scores as S, timex, urls as U, words as W
from antecede.operators import actors as A, articles, evaluation as V
from antecede.plans.controls import GRADES, discrimination



def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, key", [
    ("https://Example.COM/a#top", "https://example.com/a"),
    ("http://example.com:80", "http://example.com/"),
    ("https://example.com:443/x?Q=1", "https://example.com/x?Q=1"),
    ("https://example.com:8443/x", "https://example.com:8443/x"),
    ("http://user:pw@Example.com/a", "http://user:pw@example.com/a"),
    ("http://[2001:DB8::1]:80/a", "http://[2001:db8::1]/a"),
    ("https://example.com:bad/a", ""), ("https://example.com:99999/a", ""),
    ("ftp://example.com/a", ""), ("https:///a", ""), ("  https://e.com/p?  ", "https://e.com/p"),
])
def test_url_keys(spark, url, key):
    assert one(spark, U.normalize_url(F.lit(url))) == key


REPORT = dt.date(2023, 11, 8)  # a Wednesday


@pytest.mark.parametrize("words, announced, expected", [
    ("opened on 29 february 2020", False, (dt.date(2020, 2, 29), "high")),  # leap day
    ("since dec 30", False, (dt.date(2022, 12, 30), "high")),  # told, so the year before
    ("from jan 2nd", True, (dt.date(2024, 1, 2), "high")),  # announced, so the year after
    ("the 5th of sept.", False, (dt.date(2023, 9, 5), "high")),
    ("all through october", False, (dt.date(2023, 10, 16), "low")),  # the middle of the month
    ("31 april", False, (dt.date(2023, 4, 15), "low")),  # no such day
    ("some time last week", False, (dt.date(2023, 11, 1), "low")),
    ("this morning", False, (REPORT, "medium")),
    ("late last night", False, (dt.date(2023, 11, 7), "medium")),
    ("friday", False, (dt.date(2023, 11, 3), "medium")),
    ("friday", True, (dt.date(2023, 11, 10), "medium")),
    ("soon", True, (REPORT, "low")),
    ("", False, (REPORT, "low")),
])
def test_time_words_of_a_report(spark, words, announced, expected):
    rows = spark.createDataFrame([(words, REPORT)], "said string, reported date")
    found = timex.with_resolved_time(rows, "said", "reported", F.lit(announced), "when").first()["when"]
    assert (found["best"], found["confidence"]) == expected


def test_every_form_of_a_month(spark):
    forms = [(f, i) for i, name in enumerate(timex.MONTHS, 1) for f in (name, name[:3])] + [("sept", 9), ("", None), ("ma", None), ("xyz", None)]
    got = spark.createDataFrame(forms, "word string, expected int").select("word", "expected", timex.month_number(F.col("word")).alias("n"))
    assert all(r.n == r.expected for r in got.collect())
    rows = spark.createDataFrame([(f"{f} 3, 2021", i) for f, i in forms if i], "said string, month int").withColumn("reported", F.lit(REPORT))
    dates = timex.with_resolved_time(rows, "said", "reported", F.lit(False), "when").select("month", "when.best").collect()
    assert all(r.best == dt.date(2021, r.month, 3) for r in dates)


def test_stated_condition_start(spark):
    rows = spark.createDataFrame([("since May 2024", None, "ongoing", dt.date(2024, 6, 1))],
                                 "since string, until string, status string, anchor date")
    v = timex.with_validity(rows, "since", "until", "status", "anchor", "v").first()["v"]
    assert v["start"] == dt.date(2024, 5, 1) and v["start_stated"] and not v["end_stated"]
    assert v["end"] == dt.date(2024, 7, 1)


def test_unknown_fields_are_not_mismatches(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    assert one(spark, W.known_jaccard(words("a"), words())) is None
    assert one(spark, W.known_jaccard(words("a", "b"), words("b"))) == 0.5


def test_name_tokens_drop_stop_words_and_marks(spark):
    tokens = one(spark, A.name_tokens(F.lit("The Al-Qaeda, Police"), F.lit(None).cast("string")))
    assert tokens == ["ALQAEDA"]


def test_token_matches_are_substrings(spark):
    names = spark.createDataFrame([("UNITED STATES",), ("united kingdom",)], "name string")
    tokens = spark.createDataFrame([("UNITED",), ("STATE",), ("KING",), ("NATION",)], "token string")
    got = {r["name"]: sorted(r["matched"]) for r in A.name_matches(names, tokens).collect()}
    assert got == {"UNITED STATES": ["STATE", "UNITED"], "united kingdom": ["KING", "UNITED"]}


def test_grade_rules(spark):
    def g(doc, cor, pri, con, act, suff, conf):
        return one(spark, S.grade(*[F.lit(float(x)) for x in (doc, cor, pri, con, act, suff, conf)]))

    assert g(1, .5, 0, 0, 0, 0, .5) == "confirmed"
    assert g(1, .49, 0, 0, 0, 0, .5) == "reported"
    assert g(0, 0, .45, .45, .45, .3, .01) == "pattern"
    assert g(0, 0, 0, 0, 0, 0, .08) == "weak"
    assert g(0, 0, 0, 0, 0, 0, .079) == "dropped"


def test_logistic_is_clamped(spark):
    assert one(spark, S.logistic(F.lit(-61.0))) == 0.0
    assert one(spark, S.logistic(F.lit(61.0))) == 1.0


@pytest.mark.parametrize("title, text, reason", [
    ("", "Please subscribe to continue reading", "paywall-cue"),
    ("", "Verify you are human", "blocked-page-cue"),
    ("404", "", "error-page-cue"),
    ("", "", "no-extracted-content"),
    ("", "Short.", "less-than-400-characters"),
    ("Water shortage deepens", "Lorem ipsum dolor sit amet. " * 20, "title-body-mismatch"),
    ("Water shortage deepens", "The water shortage deepens daily. " * 20, None),
])
def test_page_gate(spark, title, text, reason):
    gate = T.page_gate(F.lit(title), F.lit(text), F.lit(""), F.lit(None).cast("string"))
    assert one(spark, gate["reason"]) == reason


@pytest.mark.parametrize("html, text, language", [
    ('<html lang="en-IN"><body>', "नमस्ते", "en-in"),
    ("<html><body>", "नमस्ते दुनिया", "hi/mr/ne (devanagari)"),
    ("<html>", "plain words", "en"), ("<html>", "", "unknown"),
])
def test_language(spark, html, text, language):
    assert one(spark, T.language(F.lit(html), F.lit(text))) == language


def test_clean_text_cuts_sections_noise_and_repeats(spark):
    text = "| Home | News |\nListen\nWater shortage deepens\nFirst part.\nFIRST part.\nMore. Follow us on X\nlost"
    rows = spark.createDataFrame([(text, "Water shortage deepens")], "t string, title string")
    got = T.with_clean_text(rows, "t", "title", "out").first()["out"]
    assert got == "Home | News\n\nWater shortage deepens\n\nFirst part.\n\nMore."


def test_pages_are_extracted_with_entities(spark):
    body = "".join(f"<p>The water shortage in ward {i} deepens &amp; wells run dry again today.</p>" for i in range(12))
    html = f"<html><head><title>Water shortage deepens</title></head><nav><p>menu</p></nav><body>{body}</body></html>"
    pages = spark.createDataFrame([(1, "https://e.com/a", html)], "page_id int, url string, html string")
    row = articles.extracted_pages(pages).first()
    assert row["status"] == "extracted" and row["reason"] is None
    assert "deepens & wells" in row["text"] and "menu" not in row["text"]


def test_cue_spans_have_exact_offsets(spark):
    text = "A Protest met strikes; protesters left."
    spans = one(spark, articles.cue_spans(F.lit(text)))
    assert [s["text"] for s in spans] == ["Protest", "strikes", "protesters"]
    assert all(text[s["start"]:s["end"]] == s["text"] for s in spans)


def test_chance_floor(spark):
    assert one(spark, V.chance_top(F.lit(2), F.lit(2))) == 1.0
    assert abs(one(spark, V.chance_top(F.lit(1), F.lit(4))) - 0.75) < 1e-12


def test_discrimination_lists_every_grade_without_any_candidate(spark):
    none = spark.createDataFrame([], "arm string, " + ", ".join(f"{g} double" for g in GRADES))
    assert {tuple(r) for r in discrimination(none).collect()} == {(g, None) for g in GRADES}
    moved = spark.createDataFrame([("shuffled", 0.5, 0.5, 0.0, 0.0, 0.0)], none.schema)
    assert {r.grade: r.discrimination for r in discrimination(moved).collect()}["reported"] == 0.0


def test_plain_urls_are_their_own_keys(spark):
    """a URL is taken apart only where its key can differ; both ways give one key."""
    plain = ["http://a.b/", "https://src1.example/a/12", " https://a-b.c/x?q=1&r=2 ", "https://a/b\nc", "https://1.2.3.4//x@y:80/"]
    other = ["HTTP://a/x", "https://A.b/x", "https://a:443/x", "https://a:80/x", "http://u:p@a/x", "https://a", "https://a/x#f", "https://a/x?", "https://a/x?#f",
             "https://a/x?q#f", "https://[::1]/x", "https://a_b/x", "ftp://a/x", "https:///x", "", None, "https://a/x\n", "https://a/?\n", "https://a:99999/x", "https://é/x"]
    df = spark.createDataFrame([(u,) for u in plain + other], "u string")
    u = F.col("u")
    rows = df.select("u", U.normalize_url(u).alias("key"), U._rebuilt(u).alias("parts"), F.trim(u).rlike(U.PLAIN_URL).alias("plain")).collect()
    assert [r.key for r in rows] == [r.parts for r in rows]
    assert all(r.plain and r.key == r.u.strip(" ") for r in rows[: len(plain)])
    assert not any(r.plain for r in rows[len(plain):] if r.u not in ("https://a/x\n", "https://a/?\n"))
