"""Registered queries against their SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import catalog

SMALL = pathlib.Path("/root/testdata/sf0.001")
CHECKED = [
    "visible_messages", "message_key", "active_path", "segments", "manifest", "statements", "fragments", "near_dup_pairs",
    "working_view", "topic_boundaries", "topk", "retrieve", "hydrate", "lineage", "delete_extracts", "job_state", "reimport_exports", "ingest_tables", "stream_messages", "stream_late_messages", "force_rerun_cascade",
    "segment_machine", "job_machine", "stored_upsert", "model_fragments", "model_summaries", "embed_idf", "search_ivf",
]
ROWS_ONLY = {"fingerprint_files", "describe_blocks", "search_approx"}


def test_every_query_has_sql_but_a_few():
    queries, oracles = catalog.QUERIES, catalog.ORACLES
    assert set(oracles) <= set(queries)
    assert set(queries) - set(oracles) == ROWS_ONLY
    assert set(queries) <= set(entry.queries()) and set(oracles) <= set(entry.oracle_sql())


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in SMALL.glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    want = con.sql(entry.oracle_sql()[name])
    frame = entry.queries()[name](spark, str(SMALL))
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)

    def normal(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    quoted = ", ".join(f'"{c}"' for c in columns)
    assert normal(frame.select(*[f"`{c}`" for c in columns]).collect()) == normal(want.project(quoted).fetchall())
