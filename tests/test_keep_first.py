"""Keep-first deduplication against sorting."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, difference
from voltweave import runtime
from voltweave.operators import network
from voltweave.plans import bindings, panel_queries


def test_first_row_of_every_key(spark):
    r = random.Random(4)
    big = 2**63 - 1
    rows = []
    for k in range(3000):
        order = [r.choice([None, 0, 1, 5, big]), r.choice([None, 0, 3, 2**31 - 1]), r.choice([0, 1, big]), r.choice([None, 0, 1, 2, big])]
        rows.append((f"k{r.randrange(200)}", r.randrange(3), *order, hash(tuple(order)) % 1000 / 7, None if order[3] == 2 else k % 2 == 0))
    rows += [(*x[:6], r.choice([None, -1.0, 7.5]), r.choice([None, True, False])) for x in rows[::3]]  # ties in the order
    df = spark.createDataFrame(rows, "a string, b int, o0 long, o1 int, o2 long, o3 long, v double, w boolean").repartition(7)
    best = {}
    for x in rows:
        rank = (*[-1 if o is None else o for o in x[2:6]], x[6] if x[6] is not None else float("-inf"), -1 if x[7] is None else x[7])
        if x[:2] not in best or rank < best[x[:2]][0]:
            best[x[:2]] = (rank, x)
    for order in (["o0", "o1", "o2", "o3"], ["o0", "o1", "o2"], ["o0"]):
        got = network.first_per_key(df, ["a", "b"], order)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHash" not in plan
        found = {x[:2]: x for x in map(tuple, got.select(*df.columns).collect())}
        assert set(found) == set(best)
        for key, x in found.items():
            n = len(order)
            assert tuple(-1 if o is None else o for o in x[2: 2 + n]) == best[key][0][:n]
            if n == 4:
                assert x == best[key][1]


def test_text_columns_are_compared_as_a_struct(spark):
    df = spark.createDataFrame([(1, "b", 1, "x"), (1, "a", 2, "y"), (2, "a", 1, None)], "k int, file string, row int, name string")
    got = sorted(map(tuple, network.first_per_key(df, ["k"], ["file", "row"]).collect()))
    assert got == [(1, "a", 2, "y"), (2, "a", 1, None)]
    assert network.first_per_key(df.limit(0), ["k"], ["row"]).collect() == []


def test_orders_below_zero(spark):
    df = spark.createDataFrame([(1, -5, 2.0), (1, -7, 3.0), (1, 0, 1.0)], "k int, o long, v double")
    assert [tuple(r) for r in network.first_per_key(df, ["k"], ["o"]).collect()] == [(1, -7, 3.0)]


def test_no_table_of_all_rows_in_a_task(spark):
    """A key of all rows: one row for each task is shuffled, and no hash aggregate holds rows."""
    df = spark.range(20_000, numPartitions=4).selectExpr("id % 2 AS k", "20000 - id AS o", "id * 0.5D AS v")
    got = network.first_per_key(df, ["k"], ["o"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Aggregate" not in plan
    assert sorted((r.k, r.o) for r in got.collect()) == [(0, 2), (1, 1)]


def test_tasks_of_the_transfers_follow_the_line_items(spark, monkeypatch):
    """60 000 line items in tasks of about 1000, whatever the session's number of partitions."""
    monkeypatch.setattr(bindings, "TASK_ITEMS", 1000)
    rows = bindings.transfer_codes(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert len(sizes) >= 50 and max(sizes) < 2000


def test_a_table_cut_in_given_tasks(spark):
    """The session has 8 partitions, which are merged for so few rows; its settings come back, after a failure too."""
    names = [runtime.CLEANUP, "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.minPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    df = spark.range(20_000, numPartitions=4).selectExpr("id % 5000 AS k", "20000 - id AS o", "id * 0.5D AS v")
    got = runtime.cut(network.first_per_key(df, ["k"], ["o"]), 40)
    assert len(got.inputFiles()) == 40
    assert sorted((r.k, r.o) for r in got.collect()) == [(k, 5000 - k) for k in range(5000)]
    with pytest.raises(Exception, match="stopped here"):
        runtime.cut(df.select(F.raise_error(F.lit("stopped here")).cast("int").alias("x")), 40)
    assert [spark.conf.get(n, None) for n in names] == before


def test_scans_behind_a_table_cut_in_given_tasks(spark, tmp_path):
    """16 small files, which 8 tasks read in a scan of the session."""
    spark.range(1600, numPartitions=16).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.rdd.getNumPartitions() == 8
    got = runtime.cut(rows, 16)
    assert len(got.inputFiles()) == 16 and got.count() == 1600


def test_tasks_of_keep_first_follow_the_line_items(spark, monkeypatch):
    """60 000 line items in tasks of about 1000, whatever the session's number of partitions."""
    monkeypatch.setattr(bindings, "TASK_ITEMS", 1000)
    files = [f for f in panel_queries._clean(spark, "/root/testdata/sf0.01").inputFiles() if "/cut-" in f]
    sizes = [spark.read.parquet(f).count() for f in files]
    assert len(sizes) == 60 and max(sizes) < 2000


@pytest.mark.parametrize("name", [
    "a9_capacity_max", "a9_capacity_mean", "a9_capacity_median", "a10_monthly_counts", "f9_binarise", "g11_expanded_mask",
    "j7_node_universe", "j9_dense_matrix", "j16_first_per_key", "k4_filtered_network", "k6_report_folder", "p17_dropped_nodes",
    "p17_submatrix", "p4_endpoint_filter", "p4_excluded_codes"])
def test_queries_on_many_tasks(spark, monkeypatch, name):
    """Every query behind keep-first, with 60 tasks for the 6000 line items of sf0.001, against its SQL."""
    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(bindings, "TASK_ITEMS", 100)
    monkeypatch.setattr(panel_queries, "cut", lambda df, tasks=None: asked.append(tasks) or runtime.cut(df, tasks))
    assert not difference(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name])
    assert [t for t in asked if t] == [60]
