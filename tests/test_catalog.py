"""A query of every family against its SQL oracle, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from covenantry.fixtures import TABLES
from tests.oracle_check import check

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "A2_ingest_dedup", "A3_ingest_bulk", "A8_compliance_counters", "A9_export_obligations", "A9_csv_round_trip", "B1_normalize_text",
    "B8_split_into_chunks", "B13_format_quote", "C7_doc_type_gate", "C11_obligation_candidates", "C14_integrity_report", "C15_section_filter",
    "C16_section_label", "D3_export_lookups", "D5_contradiction_flags", "D6_contradiction_outputs", "E1_asset_rollup", "E3_weekly_metrics",
    "F3_keep_latest_run", "F7_group_chunks", "G1_anchor_exact", "G2_anchor_sentence", "G10_score_obligations", "G12_context_digest",
    "J1_apply_reviews", "J4_merge_chains", "J6_cascade_delete", "L1_process_stream", "L2_user_notifications", "L4_weekly_digest",
    "L7_stream_dedup", "N3_severity_agreement", "N5_curate_ground_truth",
]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_oracle(spark, engine, name):
    ok, note = check(spark, engine, name, entry_module.queries()[name], entry_module.oracle_sql()[name], FOLDER)
    assert ok, note


@pytest.mark.parametrize("name", ["B8_split_into_chunks", "C22_chunk_pages", "E10_diagnose_document"])
def test_any_white_space_at_the_ends_of_a_text_is_left_off(spark, tmp_path, name):
    con = duckdb.connect()
    for table in set(TABLES) - {"documents"}:
        (tmp_path / f"{table}.parquet").symlink_to(f"{FOLDER}/{table}.parquet")
    con.execute(f"""copy (select doc_id, chr(11) || repeat('some words of 1. Heading text ', 200) || chr(8232) || case when doc_id % 5 > 0 then '' end as text, lang, source, n_chars
      from '{FOLDER}/documents.parquet' order by doc_id limit 5) to '{tmp_path}/documents.parquet' (format parquet)""")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    ok, note = check(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], str(tmp_path))
    assert ok, note


def test_containment_takes_text_that_was_normalised_once(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""copy (select cast(1 as bigint) as doc_id, chr(64257) || chr(769) || chr(10) || 'fi' || chr(769) as text, 'en' as lang, 's' as source,
      cast(5 as bigint) as n_chars) to '{tmp_path}/documents.parquet' (format parquet)""")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    name = "D7_text_containment_join"
    ok, note = check(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], str(tmp_path))
    assert ok and note.startswith("1 rows"), note


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["asset_id", "name", "needs_review", "rejected", "points"] and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flow_invariants(spark):
    rows = entry_module.queries()["flow_scored_items"](spark, FOLDER).collect()
    assert rows and all(0 <= r.system_confidence <= 100 for r in rows)
    assert all((r.status == "needs_review") == (r.system_confidence >= 50) for r in rows)
    assert len({(r.kind, r.item_id) for r in rows}) == len(rows)
