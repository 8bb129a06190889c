from pyspark.sql import functions as F

from tickscope.operators import colocated as C


def tables(spark):
    # half of all rows have one key, a tenth have none
    facts = spark.range(4000, numPartitions=4).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 10 == 3, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 90).alias("item_id"))
    table = spark.range(0, 80).select(F.col("id").alias("item_id"), (F.col("id") * 3).alias("price"))
    prices = spark.range(0, 50).select(F.col("id").alias("item_id"), F.concat(F.lit("n"), "id").alias("name"))
    return facts, table, prices


def test_joins_without_an_exchange_and_with_a_spread_hot_key(spark):
    facts, table, names = tables(spark)
    layout = C.layout_for(facts, "item_id", bucket_rows=250)
    assert [(r.item_id, r._parts) for r in layout.hot.collect()] == [(7, 33)]
    assert layout.buckets == 15
    rows = C.bucketed_facts(facts, layout)
    joined = C.colocated(C.colocated(rows, C.bucketed_lookup(table, layout), layout), C.bucketed_lookup(names, layout), layout)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    expected = facts.join(table, "item_id", "left").join(names, "item_id", "left").select("row", "item_id", "price", "name")
    assert sorted(map(str, joined.select(expected.columns).collect())) == sorted(map(str, expected.collect()))
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 900  # the hot key alone has 2000 rows


def test_inner_join_and_empty_tables(spark):
    facts, table, _ = tables(spark)
    layout = C.layout_for(facts, "item_id")
    assert layout.hot.count() == 0 and layout.buckets == C.LEAST_BUCKETS
    lookup = C.bucketed_lookup(table, layout)
    assert C.colocated(C.bucketed_facts(facts, layout), lookup, layout, "inner").count() == facts.join(table, "item_id").count()
    none = facts.limit(0)
    empty = C.layout_for(none, "item_id")
    assert C.colocated(C.bucketed_facts(none, empty), C.bucketed_lookup(table, empty), empty).count() == 0
    assert C.colocated(C.bucketed_facts(facts, layout), C.bucketed_lookup(table.limit(0), layout), layout).count() == 4000
