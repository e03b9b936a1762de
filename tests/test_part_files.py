"""Tables that lie as folders of part files, and texts that are cut at headings, against the SQL oracles."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from covenantry.fixtures import TABLES
from tests.oracle_check import check

FOLDER = "/root/testdata/sf0.001"
STREAMS = ["L1_chain_items", "L1_process_stream", "L7_stream_dedup"]  # the other L1 queries read the same stream
CUT = [
    "A12_snapshot_state", "B8_split_into_chunks", "C15_section_filter", "C15_section_stats", "C16_section_label", "C19_relevance_score",
    "C22_chunk_pages", "D11_label_errors", "E10_diagnose_document", "E11_documents_overview", "E13_section_label_counts",
    "N6_section_filter_report",
]

FILL = "lorem ipsum dolor sit amet consectetur " * 30
HEADED = [
    FILL + "1. Payment terms of the parties " + FILL * 3 + "2) Delivery " + FILL * 4,
    "GENERAL TERMS " + FILL * 5 + "FINAL PROVISIONS " + FILL,
    "SCOPE OF WORK " * 400,
    FILL * 2 + "3. Alpha beta 4. Gamma delta " + "x" * 200 + " 5. Epsilon " + FILL * 3 + "CLOSING REMARKS",
    FILL * 2 + "٣.　Arabic digit and wide space " + FILL * 2 + " SPACED HEADING " + FILL * 2,
    FILL * 6, "ONLY AT THE START " + FILL * 4, FILL * 3 + "\x01 7. Marked \x0b" + FILL * 3, "short 1. Heading",
]


def folder_with(path, spark, documents):
    documents.repartition(3).write.parquet(f"{path}/documents.parquet")
    for table in TABLES:
        if table != "documents":
            os.symlink(f"{FOLDER}/{table}.parquet", f"{path}/{table}.parquet")
    con = duckdb.connect()
    for table in TABLES:
        files = f"{path}/{table}.parquet" + ("/*.parquet" if table == "documents" else "")
        con.execute(f"create view {table} as select * from '{files}'")
    return str(path), con


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    return folder_with(tmp_path_factory.mktemp("parts"), spark, spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60))


@pytest.fixture(scope="module")
def headed(spark, tmp_path_factory):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(HEADED)], given.schema)
    return folder_with(tmp_path_factory.mktemp("headed"), spark, rows)


@pytest.mark.parametrize("name", STREAMS)
def test_stream_reads_part_files(spark, parts, name):
    folder, engine = parts
    ok, note = check(spark, engine, name, entry_module.queries()[name], entry_module.oracle_sql()[name], folder)
    assert ok, note


@pytest.mark.parametrize("name", CUT)
def test_oracle_cuts_at_headings(spark, headed, name):
    folder, engine = headed
    ok, note = check(spark, engine, name, entry_module.queries()[name], entry_module.oracle_sql()[name], folder)
    assert ok, note


@pytest.mark.parametrize("name", ["L1_process_stream"])
def test_stream_cuts_at_headings(spark, headed, name):
    folder, engine = headed
    ok, note = check(spark, engine, name, entry_module.queries()[name], entry_module.oracle_sql()[name], folder)
    assert ok, note


LETTERS = "".join(chr(0x4E00 + k) for k in range(1600))
LAST = {  # what follows a first piece of 4,000 characters, and whether it is news beside it
    "a part of it": (FILL * 4)[:4000] + (FILL * 4)[:2500], "too small a part": (FILL * 4)[:4000] + (FILL * 4)[:1500],
    "nearly equal": (LETTERS * 3)[:4000] + (LETTERS * 3)[:1700] + "#" + (LETTERS * 3)[1700:3900],
    "alike in another order": (LETTERS * 3)[:4000] + LETTERS[800:] + "#" * 300 + LETTERS[:800] + LETTERS,
    "unlike": LETTERS[:1500] + "x" * 2500 + LETTERS[::-1] * 2 + "y" * 500,
    "letter before a word": "z" * 4000 + " \u00e9by " + "q" * 400, "word": "z" * 4000 + " \u00e9 by " + "q" * 400,
    "type by a phrase": "z" * 3000 + " a Tenant " + "z" * 2000,
}


def test_chain_items_tell_resembling_finds(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [*LAST.values(), *HEADED]
    rows = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts, 12)], given.schema)
    folder, engine = folder_with(tmp_path, spark, rows)
    ok, note = check(spark, engine, "L1_chain_items", entry_module.queries()["L1_chain_items"], entry_module.oracle_sql()["L1_chain_items"], folder)
    assert ok, note
