"""Work that is done once: no second scan, no lambda per row, few sorted rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens import storage
from scorelens.operators import describe, metrics, quantiles, ranks
from scorelens.plans import catalog
from scorelens.plans import scenario as sc
from scorelens.sources import readers, writers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.range(120).select(F.expr("if(id = 7, null, id div 2)").alias("doc_id"), F.lit("x").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_best_members_read_the_deltas_once(spark, folder):
    best = catalog.QUERIES["h9_best_members"](spark, folder)
    assert "md5" not in plan(best) and "SortMergeJoin" not in plan(best)
    assert {r.family for r in best.collect()} == {"model", "label"}


@pytest.mark.parametrize("options", [{}, {"accuracy": 20, "keep_rows": 2, "grid": 8}])
def test_percentiles_leave_no_scan_to_their_result(spark, tmp_path, options):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 150}", float(x)) for i, x in enumerate(rng.normal(size=6000))]
    path = f"{tmp_path}/values_of_the_test"
    spark.createDataFrame(rows, "g string, x double").write.parquet(path)
    found = quantiles.profile(spark.read.parquet(path), ["g"], "x", [F.count("x").alias("n")], {"p50": 0.5, "p90": 0.9}, **options)
    assert "values_of_the_test" not in plan(found)
    got = {r.g: r for r in found.collect()}
    assert len(got) == 150
    for g in ("g0", "g77", "g149"):
        xs = [x for k, x in rows if k == g]
        assert got[g].n == len(xs) and [got[g].p50, got[g].p90] == pytest.approx(list(np.quantile(xs, [0.5, 0.9])))


def test_hashed_groups_hold_for_a_while_and_lower_nothing(spark):
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, "128")
    with storage.hashed_groups(spark, 256):
        assert spark.conf.get(name) == "256"
        with storage.hashed_groups(spark, 3):
            assert spark.conf.get(name) == "256"
    assert spark.conf.get(name) == before


def test_label_maps_are_counted_without_lambdas(spark):
    rows = [("m", {"a": 0.5, "b": None}), ("m", {"a": 1.0}), ("m", {}), ("m", None), (None, {"b": 0.25}), (None, {"b": 0.75, "a": None})]
    summary = describe.label_map_summary(spark.createDataFrame(rows, "model string, labels map<string,double>"), ["model"])
    assert "lambda" not in plan(summary)
    got = {(r.model, r.label): (r.n, r.mean, r.min, r.max) for r in summary.collect()}
    assert got[("m", "a")] == (2, 0.75, 0.5, 1.0) and got[(None, "b")] == (2, 0.5, 0.25, 0.75)
    assert got[("m", "b")][0] == 2 and got[(None, "a")][0] == 2


def test_classifications_are_plain_expressions(spark, folder):
    rows = sc.classifications(spark, folder)
    assert "lambda" not in plan(rows)
    scores = {tuple(r)[:1] + (r.model, r.text_type, r.classifier, r.label): r.score for r in sc.scores(spark, folder).collect()}
    found = rows.collect()
    assert len(found) == 120 * 6 * 3 * 3
    for r in found:
        labels = [] if r.prompt_id is None or r.prompt_id % 11 == 0 else [
            x for x in sc.CLASSIFIER_LABELS[r.classifier] if not (r.prompt_id % 5 == 0 and x == "threat")
        ]
        assert sorted(r.labels) == sorted(labels)
        assert all(s == scores[r.prompt_id, r.model, r.text_type, r.classifier, x] for x, s in r.labels.items())
    few = sc.classifications(spark, folder, text_types=["output"]).collect()
    assert sorted(map(str, few)) == sorted(str(r) for r in found if r.text_type == "output")


def test_folder_values_take_no_regular_expression(spark, tmp_path):
    rows = [(1, "base"), (2, "50% a+b/c"), (3, "a+b"), (4, None)]
    writers.write_csv(spark.createDataFrame(rows, "k long, model string"), f"{tmp_path}/csv", partition_by=["model"])
    read = readers.read_results_csv(spark, f"{tmp_path}/csv", "k long, model string")
    assert "regexp_extract" not in plan(read)
    assert sorted(map(tuple, read.collect())) == rows


def test_ranges_that_arrive_in_small_batches(spark, tmp_path):
    """Records go on over batches as over ranges."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    records = ['1,"a\nb\n\nc"', "2,plain", '3,"say ""no"""', "", '4,"x\n"', "5,y"]
    (tmp_path / "a.csv").write_text("k,t\n" + "\n".join(records) + '\n6,"open\nend')
    try:
        for size in ("1", "2", "3", "1000"):
            spark.conf.set(name, size)
            got = readers.quoted_records(spark, str(tmp_path)).collect()
            assert [r.record for r in got if r.first] == ["k,t"]
            assert sorted(r.record for r in got if not r.first) == sorted([*filter(None, records), '6,"open\nend'])
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_crossings_equal_all_pairs(spark, batch):
    """Groups of one row, short and long segments, hot ranks, over many partitions and batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rng = np.random.default_rng(11)
    rows = [("long", i, int(r), int(w)) for i, (r, w) in enumerate(zip(rng.integers(0, 9000, 1500), rng.integers(1, 4, 1500)))]
    rows += [("hot", i, int(r), 1) for i, r in enumerate(rng.choice([3, 64, 65, 4096], 900, p=[0.8, 0.1, 0.05, 0.05]))]
    rows += [(f"s{i % 90}", i, int(r), 2) for i, r in enumerate(rng.integers(0, 200, 500))]
    rows += [(None, 0, 5, 1), (None, 1, 4, 3), ("up", 0, 1, 1), ("up", 1, 2, 1)]
    df = spark.createDataFrame(rows, "g string, x long, r long, w long")
    spark.conf.set(name, batch)
    try:
        found = {r.g: r.crossings for r in ranks.ordered_crossings(df, ["g"], ["x"], "r", "w", 9000).collect()}
    finally:
        spark.conf.set(name, before)
    for g, part in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        part = list(part)
        r, w = np.array([p[2] for p in part]), np.array([p[3] for p in part])
        expected = float((np.triu(r[:, None] > r[None, :], 1) * w[:, None] * w[None, :]).sum())
        assert found.get(g, 0.0) == expected, g


def test_kendall_of_groups_without_crossings(spark):
    rows = [("up", 1.0, 1.0), ("up", 2.0, 2.0), ("one", 1.0, 1.0), (None, 1.0, 2.0), (None, 2.0, 1.0)]
    got = {r.g: r.kendall for r in metrics.kendall(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got == {"up": 1.0, "one": None, None: -1.0}
