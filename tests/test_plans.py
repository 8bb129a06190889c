"""Shape of the physical plans: shuffles, broadcasts, pushdown, Python stages."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check import TABLES, canonical
from tickscope.functions.sql import FUNCTIONS, register_functions
from tickscope.operators import baselines as B
from tickscope.operators import context as C
from tickscope.operators import dedup as D
from tickscope.operators.joins import lookup
from tickscope.plans import catalog
from tickscope.plans.fixtures import SPLIT, view
from tickscope.session import at_most, stored

DATA = "/root/testdata/sf0.001"
HISTORY = "item_id BIGINT, sale_date TIMESTAMP, median_price_cents BIGINT, volume_sold BIGINT"
TICKS = "market_hash_name STRING, timestamp BIGINT, id BIGINT, price_cents BIGINT, marketplace_source STRING, item_id BIGINT"


def plan(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def shuffles(text):
    return text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning")


@pytest.fixture
def table(spark, tmp_path):
    def write(rows, schema):
        path = str(tmp_path / "t")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_macro_cuts_before_the_shuffle(table, no_auto_broadcast):
    history = table([(i % 3, None, i, 1) for i in range(200)], HISTORY)
    text = plan(B.macro_baselines(history), run=True)
    assert text.count("row_number(), 90, Partial") == 2
    assert text.count("ReusedExchange") == 1  # the price counts are scanned and shuffled once
    assert "Python" not in text and "Arrow" not in text


def test_rolling_needs_one_shuffle_and_one_sort(table):
    history = table([(1, None, 5, 1)], HISTORY)
    text = plan(B.rolling_averages(history))
    assert shuffles(text) == 1 and text.count("Sort [") == 1


def test_suppression_and_windows_share_one_shuffle(table):
    ticks = table([("a", 1, 1, 1, "s", 1)], TICKS)
    text = plan(D.accepted_windows(ticks))
    assert shuffles(text) == 1 and text.count("Sort [") == 1
    assert text.count("MapInArrow") == 1


def test_small_lookup_does_not_shuffle_the_facts(spark, table, no_auto_broadcast):
    ticks = table([("a", 1, 1, 1, "s", 1)], TICKS)
    small = spark.createDataFrame([("a", 1)], "market_hash_name STRING, v INT")
    text = plan(lookup(ticks, small, "market_hash_name"))
    assert "BroadcastHashJoin" in text and shuffles(text) == 0
    large = plan(lookup(ticks, small, "market_hash_name", rows=0))
    assert "SortMergeJoin" in large


def test_source_filter_reaches_the_scan(table):
    ticks = table([("a", 1, 1, 1, "s", 1)], TICKS)
    text = C.source_baseline(ticks, "s")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(marketplace_source,s)" in text
    assert "ReadSchema: struct<price_cents:bigint,marketplace_source:string,item_id:bigint>" in text
    assert "partial_avg" in text


def test_at_most(spark):
    assert at_most(spark.range(3), 3) and not at_most(spark.range(4), 3)


def test_stored_table_reads_back(spark):
    df = spark.range(5).select("id", F.struct(F.col("id").alias("x")).alias("s"), F.lit(None).cast("string").alias("n"))
    kept = stored(df)
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "FileScan parquet" in plan(kept)


def test_sql_functions_are_inlined(spark):
    names = register_functions(spark)
    assert len(names) == len(FUNCTIONS)
    df = spark.sql("SELECT ts_item_type(name) AS t, ts_to_cents(usd) AS c FROM VALUES ('★ X', 0.125D), ('Clutch Case', 1D) AS v(name, usd)")
    assert [tuple(r) for r in df.collect()] == [("Knife", 12), ("Container/Collectible", 100)]
    assert "Python" not in plan(df)
    row = spark.sql("SELECT ts_opportunity(1000, true, 1500, 1600, NULL, NULL, 0) AS o, ts_verdict(70) AS v").first()
    assert (row.o.approved, row.v) == (True, "APPROVED")


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert len(catalog.QUERIES) > 70
    assert set(catalog.QUERIES) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["macro_baselines", "detect_anomalies", "market_context", "ingest_tick_batches"])
def test_query_equals_its_twin(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours = canonical(entry_points.queries()[name](spark, DATA).toArrow())
    assert ours == canonical(duck.sql(entry_points.oracle_sql()[name]).to_arrow_table())


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_entry(spark):
    assert entry_points.entry(spark).columns[:2] == ["id", "market_hash_name"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_sales_are_all_ticks_before_the_live_period(spark):
    ticks = view(spark, DATA, "fx_named_ticks").filter("price_cents > 0")
    earlier = ticks.filter(F.col("inserted_at") < F.expr(SPLIT))
    sold, live = view(spark, DATA, "fx_sales"), view(spark, DATA, "fx_live_ticks")
    assert earlier.select("marketplace_source").distinct().count() > 1
    assert sorted(r.id for r in sold.select("id").collect()) == sorted(r.id for r in earlier.select("id").collect())
    assert sold.count() + live.count() == ticks.count()
