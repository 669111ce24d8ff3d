"""The driver contract, and registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
from tools.compare import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
# The slowest subjects run with ALL_CHECKS=1; these cover every module.
QUICK = (
    "a10_dataset_manifest", "b2_any_country_column", "b6_actor_search", "b14_code_labels",
    "e1_trailing_in_degree", "e2_removal_counts", "c3_precursor_links", "k3_causal_filter",
    "d3_e3_country_pairs", "d7_country_profiles", "c5_usual_causes", "f3_event_page",
    "d12_type_pair_matrix", "d10_candidate_groups", "h1_normalized_urls", "d19_fetch_summary",
    "c20_group_sources", "c10_supersede_on_change", "h4_tokenisers", "h25_page_gate",
    "h37_paragraphs", "i2_bm25_scores", "i4_cosine_pairs", "e12_dealt_claims",
    "d23_d24_agreement", "d21_branching_total", "h7_resolved_times", "c16_condition_pairs",
    "j7_j8_chains", "j14_search_statuses", "d28_d29_retrieval_report", "d31_span_audit",
)


def test_importing_the_contract_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_gives_one_row_per_event(spark):
    result = contract.entry(spark)
    assert set(result.columns) == {"GlobalEventID", "pair_key", "day", "causal_in_degree"}
    assert result.count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_every_comparison_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()) if os.environ.get("ALL_CHECKS") else QUICK)
def test_query_matches_its_sql(spark, tables, name):
    ok, detail, _, _ = compare(spark, tables, name, contract.queries()[name], contract.oracle_sql().get(name), FOLDER)
    assert ok, detail
