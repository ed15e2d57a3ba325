"""Queries against their SQL on rows that the given tables have too few of."""

import duckdb
import pytest
from pyspark.sql import functions as F

from labelwright import queries
from labelwright.operators import additives, passes
from labelwright.sources import dimensions, tables


def differing(spark, folder, name, **tables):
    """Rows that only the query or only its SQL has; tables: (rows, schema) by name."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    got = sorted(map(repr, map(tuple, found.collect())))
    want = sorted(map(repr, db.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()))
    assert got
    return [x for x in got if x not in want] + [x for x in want if x not in got]


PART, SUPPLIER = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
#: Without maker, licence, contact and country the first label's digits are fourteen as it was written, the second's cleaned.
PARTS = [(k, "large ring", "Brand#7", "LARGE", size, 921.7) for k, size in ((1062217, 8), (686857, 18), (9, 8), (4, 8))]


@pytest.mark.parametrize("name", ["compliance_scores", "extracted_fields", "report_checklist", "report_declarations", "rule_results", "engine_consensus", "zone_boxes"])
def test_licences_read_off_a_whole_label(spark, tmp_path, name):
    assert not differing(spark, tmp_path, name, part=(PARTS, PART), supplier=([(0, "Supplier#000000000", 2, 1.0)], SUPPLIER))


def test_scores_between_two_tenths(spark, tmp_path):
    # 26.349999999999998 and 15.549999999999999, which become 26.35 and 15.55 when they are multiplied by ten.
    rows = [(31250, 76.75), (36072, 18.32), (50204, 25.18), (1, 50.0)]
    assert not differing(spark, tmp_path, "quality_decisions", events=(rows, "event_id long, value double"))


def test_what_labels_are_made_of_is_not_broadcast(spark, monkeypatch):
    labels = spark.createDataFrame([(i, "Ingredients: Sugar, Guar Gum, Emulsifier (INS 471).") for i in range(4)], "product_id long, text string")
    found = {}
    for small in (additives.SMALL, 0):
        monkeypatch.setattr(additives, "SMALL", small)
        rows = additives.profiles(labels, dimensions.additives(spark), "product_id")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == plan.count("BuildRight") == (2 if small else 0)
        found[small] = sorted((r["product_id"], *(a["identifier"] for a in r["additives"])) for r in rows.collect())
    assert found[0] == found[4096] == [(i, "INS 471", "INS 412") for i in range(4)]


@pytest.mark.parametrize("name", ["fallback_fields", "picture_metrics", "reading_consensus", "seeded_totals", "text_regions", "text_similarity", "validated_tokens"])
def test_costly_rows_are_dealt_over_all_cores(spark, tmp_path, name):
    spark.createDataFrame([(i, "large ring", "Brand#7", "LARGE", 8, 921.7) for i in range(8)], PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, "Supplier", 2, 1.0) for i in range(8)], SUPPLIER).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, "Customer", "BUILDING") for i in range(8)], "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_joins_are_dealt_by_the_number_of_rows(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 50)
    assert tables.dealt(rows, 100, "k").rdd.getNumPartitions() == 4
    found = tables.dealt(rows, 100, "k", most=10)
    assert found.rdd.getNumPartitions() == 10
    assert found.select("k", F.spark_partition_id()).distinct().count() == 50


@pytest.mark.parametrize("name", ["evidence_views", "published_findings"])
def test_both_sides_of_such_joins_are_dealt(spark, tmp_path, name):
    spark.createDataFrame([(i, 1, "F", "1-URGENT", "x") for i in range(8)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 8, i // 8, "R", i) for i in range(32)], "l_orderkey long, l_linenumber int, l_returnflag string, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("REPARTITION_BY_NUM") == 2


def test_rounds_of_readings_deal_labels_out_once(spark, tmp_path, monkeypatch):
    plans, table = [], passes._table

    def seen(df, *how):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
        return table(df, *how)

    monkeypatch.setattr(passes, "_table", seen)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not differing(spark, tmp_path, "staged_readings", events=([(i * i,) for i in range(300)], "event_id long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [p.count("Exchange") for p in plans] == [1] + [0] * len(passes.PASSES)
    assert all(p.count("SortMergeJoin") == 2 for p in plans[1:])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("labelwright_")]


def test_buckets_follow_the_number_of_labels(spark):
    assert passes.bucket_count(spark.range(100)) == 4
    assert passes.bucket_count(spark.range(101), most=10) == 11
