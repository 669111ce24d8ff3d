import json

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from antecede.checks.review_checks import quotes_of
from antecede.operators import events as E
from antecede.operators.review import branching, deal
from antecede.operators.urlset import checked, status_summary
from antecede.sources import tables as T
from antecede.streaming import incremental as I


def coded(spark):
    rows = [(20240102, 2, "14", "IN"), (20240101, 1, "17", "US"), (20240101, 3, "18", "IN")]
    return spark.createDataFrame(rows, "day int, GlobalEventID long, EventRootCode string, ActionGeo_CountryCode string")


def test_partitioned_tables_are_pruned(spark, tmp_path):
    path = str(tmp_path / "events")
    df = coded(spark).selectExpr("*", "2024 AS year", "day % 2 + 1 AS month")
    df.write.partitionBy("year", "month").parquet(path)
    read = T.read_events(spark, path).filter("month = 1")
    assert read.count() == 1
    assert "PartitionFilters: [isnotnull(month" in read._jdf.queryExecution().executedPlan().toString()


def test_filtered_copy_keeps_columns_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "kept")
    kept = E.with_target_roots(E.in_country(coded(spark), "IN"))
    for _ in range(2):
        T.write_filtered(kept, path)
    back = spark.read.parquet(path)
    assert E.columns_preserved(coded(spark), back) and back.count() == 2


def test_ordered_write(spark, tmp_path):
    path = str(tmp_path / "ordered")
    T.write_ordered(coded(spark), path, files=1)
    assert [r["GlobalEventID"] for r in spark.read.parquet(path).collect()] == [1, 3, 2]


def test_strict_records(spark, tmp_path):
    lines = ['{"article_id":"a","v":1.5}', '{"article_id":"","v":1}', "[1]", "{bad", '{"article_id":"n","v":NaN}',
             '{"article_id":"d","v":1}', '{"article_id":"d","v":2}']
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(lines))
    schema = StructType([StructField("article_id", StringType()), StructField("v", DoubleType())])
    records, problems = T.read_records(spark, str(path), schema, "article_id")
    assert sorted(r["article_id"] for r in records.collect()) == ["a", "d", "d"]
    rules = sorted(r["rule"] for r in problems.collect())
    assert rules == ["duplicate-id", "empty-id", "invalid-json", "invalid-json", "invalid-json"]


def test_url_cache_accepts_old_entries(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({"u1": True, "u2": {"alive": False, "status": 404, "reason": "http"}, "u3": 5}))
    got = {r["url"]: (r["alive"], r["status"], r["reason"]) for r in T.read_url_cache(spark, str(path)).collect()}
    assert got == {"u1": (True, None, "legacy-cache"), "u2": (False, 404, "http")}


def test_codes_and_worksheet_and_graph(spark, tmp_path):
    codes = tmp_path / "codes.txt"
    codes.write_text("IN India\n# note\nus\n")
    assert {r["code"] for r in T.read_codes(spark, str(codes)).collect()} == {"IN", "US"}
    assert T.in_codes(coded(spark), T.read_codes(spark, str(codes)), "ActionGeo_CountryCode").count() == 3
    sheet = str(tmp_path / "sheet")
    T.write_worksheet(coded(spark), sheet)
    assert T.read_worksheet(spark, sheet, coded(spark).schema).count() == 3
    doc = tmp_path / "graph.json"
    doc.write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"id": "e", "source": "a", "target": "b"}]}))
    nodes, edges, version = T.read_graph(spark, str(doc))
    assert nodes.count() == 2 and edges.first()["target"] == "b" and len(version.first()["version"]) == 64


def test_reloading_a_batch_appends_nothing(spark):
    schema = "k string, v int"
    current = spark.createDataFrame([("a", 1), ("b", None)], schema)
    batch = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("a", 1)], schema)
    assert [r["k"] for r in I.new_rows(current, batch, ["k"]).collect()] == ["c"]
    changed = {(r["k"], r["supersedes"]) for r in I.changed_rows(
        current, spark.createDataFrame([("a", 2), ("b", None), ("c", 3)], schema), "k", ["v"]).collect()}
    assert changed == {("a", True), ("c", False)}
    assert I.new_rows(current.unionByName(I.new_rows(current, batch, ["k"])), batch, ["k"]).isEmpty()


def test_every_person_gets_second_readings(spark):
    claims = spark.range(64).selectExpr("format_string('c%03d', id) AS claim_id", "id AS effect_id", "0.5D AS machine_strength")
    dealt = deal(claims, ["ana", "ben", "chi", "dov"])
    assert {r["n"] for r in dealt.groupBy("primary_annotator").count().withColumnRenamed("count", "n").collect()} == {16}
    second = dealt.filter("review_annotator IS NOT NULL").groupBy("review_annotator").count().collect()
    assert sum(r["count"] for r in second) == 16 and len(second) == 4
    assert dealt.filter("primary_annotator = review_annotator").isEmpty()


def test_partly_judged_targets_do_not_count(spark):
    rows = [("t1", 1, "g", 4, "y"), ("t1", 1, "h", 2, "n"), ("t2", 1, "g", 1, "y"), ("t2", 1, "h", 1, ""),
            ("t3", 2, "", 0, "-")]
    df = spark.createDataFrame(rows, "target_id string, depth int, cand_group_id string, event_count int, accept string")
    total = branching(df)[1].first()
    assert (total["targets_judged"], total["targets_with_candidates"], total["branching_factor"]) == (2, 1, 0.5)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "plain")
    coded(spark).write.parquet(path)
    kept = E.with_target_roots(E.in_country(T.read_events(spark, path), "IN")).select("GlobalEventID")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ActionGeo_CountryCode)" in plan
    assert "ReadSchema: struct<GlobalEventID:bigint,EventRootCode:string,ActionGeo_CountryCode:string>" in plan


def test_repeated_urls_count_once_under_each_outcome(spark):
    log = spark.createDataFrame([(1, "u", 200), (2, "u", 404), (3, "u", 200), (4, "v", 200)], "page_id long, url string, status int")
    cache = checked(log).withColumn("reason", F.lit("timeout"))
    found = status_summary(log.withColumnRenamed("url", "SOURCEURL"), cache, "page_id")
    rows = {r.outcome: (r.urls, r.live_urls, r.input_rows, r.output_rows) for r in found.collect()}
    assert rows == {"200": (2, 2, 3, 3), "404": (1, 0, 1, 0)}


def test_texts_do_not_travel_with_their_quotes(spark):
    claims = spark.range(4).select(F.col("id").cast("string").alias("claim_id"), (F.col("id") + 3).alias("effect_id"), F.col("id").alias("cause_id"))
    articles = spark.range(5).select(F.col("id").alias("article_id"), F.repeat(F.lit("words "), 40).alias("text"))
    quotes = quotes_of(claims, articles, 5)
    plan = quotes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("AS first#") and quotes.count() == 12


def test_quotes_of_a_claim_move_in_one_row(spark):
    """a claim's quotes meet an article together, and what is found goes to the claim once, without the quotes' texts."""
    from antecede.operators import review as R

    articles = spark.createDataFrame([(1, "one two three", "x"), (2, "zero one two", "y"), (3, "three", None)], "article_id long, text string, outlet string")
    rows = [("a", ["two", "one", "lost"], [2, 1]), ("a", ["two", "three", ""], [3, 1]), ("b", ["three", None, "zero"], [3, 2]), ("c", ["lost", "", None], [1]), (None, ["one", "two", "two"], [1, 9])]
    lists = spark.createDataFrame(rows, "claim_id string, texts array<string>, article_ids array<long>").withColumn(
        "quotes", F.transform("texts", lambda q, i: F.struct(i.alias("place"), q.alias("quote")))).drop("texts")
    expected = [(None, 0, 1, "x", 0, 3), (None, 1, 1, "x", 4, 7), (None, 2, 1, "x", 4, 7), ("a", 0, 1, "x", 4, 7), ("a", 1, 1, "x", 0, 3),
                ("b", 0, 3, None, 0, 5), ("b", 2, 2, "y", 0, 4)]
    spans = R.quote_spans(lists, articles)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(spans.collect()) == order(expected)
    assert order(R.quote_spans(lists.select("claim_id", "article_ids", F.inline("quotes")), articles).collect()) == order(expected)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = R.claim_evidence(R.quote_spans(lists, articles))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(claim_id") == 1 and plan.count("Exchange ") == 3
