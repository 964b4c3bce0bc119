"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from scorelens.plans import catalog
from verify import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
# one or two per family; SCORELENS_ALL=1 runs every query
SOME = [
    "a1_json_texts", "a7_csv_map_columns", "b3_any_metric_threshold", "b9_distinct_first", "c5_label_normalisation", "d4_score_once",
    "e3_wide_to_long", "f2_baseline_join", "f4_seeded_split", "g7_summary_table", "g8_label_map_summary", "h2_improvement_stats", "h9_model_summary",
    "i2_wilcoxon_test", "i8_significance_table", "j10_evaluation_row", "k4_leaderboard", "l8_metric_history", "m1_best_improvements",
    "n4_consistent_improvers_per_set", "p1_score_histogram", "s1_reward_monitor",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("SCORELENS_ALL") else SOME)
def test_equal_to_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


def test_every_survey_operator_has_a_query():
    sizes = {"a": 14, "b": 14, "c": 20, "d": 7, "e": 10, "f": 11, "g": 20, "h": 19, "i": 9, "r": 1, "j": 12, "k": 7, "l": 8, "m": 8, "n": 7, "p": 11, "s": 2}
    names = {q.split("_")[0] for q in catalog.QUERIES}
    assert names == {f"{letter}{i}" for letter, size in sizes.items() for i in range(1, size + 1)}
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 15 and [r["mean"] for r in rows] == sorted((r["mean"] for r in rows), reverse=True)
