"""The two-table sink, the exact split and the alias index."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from labelwright.functions import profile
from labelwright.operators import additives, training
from labelwright.sources import dimensions, published


def tables(spark, ids):
    return spark.createDataFrame([(i, f"s{i % 3}") for i in ids], "id long, overall_status string"), spark.createDataFrame([(i, f"LM-0{r}") for i in ids for r in range(1, 8)], "inspection_id long, rule_code string")


def read(spark, base):
    one = published.read_published(spark, base, "inspections", "id long, overall_status string").collect()
    many = published.read_published(spark, base, "findings", "inspection_id long, rule_code string").collect()
    return sorted(r["id"] for r in one), sorted((r["inspection_id"], r["rule_code"]) for r in many)


def test_a_batch_is_published_whole_and_once(spark, tmp_path):
    base = f"file://{tmp_path}/p"

    class Killed(Exception):
        pass

    def die():
        raise Killed

    assert published.publish(*tables(spark, range(4)), base, 0)
    with pytest.raises(Killed):
        published.publish(*tables(spark, range(4, 8)), base, 1, between=die)
    # The dead attempt has left files, and nothing that is seen.
    assert len(os.listdir(tmp_path / "p" / "inspections" / "batch=1")) == 1
    assert read(spark, base) == (list(range(4)), sorted((i, f"LM-0{r}") for i in range(4) for r in range(1, 8)))
    assert published.publish(*tables(spark, range(4, 8)), base, 1)
    assert not published.publish(*tables(spark, range(4, 8)), base, 1) and not published.publish(*tables(spark, range(100)), base, 0)
    assert read(spark, base) == (list(range(8)), sorted((i, f"LM-0{r}") for i in range(8) for r in range(1, 8)))
    assert sorted((r["batch"], r["inspections"], r["findings"]) for r in published.read_manifests(spark, base).collect()) == [(0, 4, 28), (1, 4, 28)]
    assert published.sweep(spark, base) == 1 and published.sweep(spark, base) == 0 and len(read(spark, base)[0]) == 8


def test_an_attempt_that_is_overtaken_leaves_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/p"
    assert not published.publish(*tables(spark, range(3)), base, 5, between=lambda: published.publish(*tables(spark, range(3)), base, 5))
    assert read(spark, base)[0] == [0, 1, 2]
    assert all(len(os.listdir(tmp_path / "p" / part / "batch=5")) == 1 for part in published.PARTS)


def test_only_published_partitions_are_read(spark, tmp_path):
    base = f"file://{tmp_path}/p"
    published.publish(*tables(spark, range(3)), base, 0)
    plan = published.read_published(spark, base, "findings", "inspection_id long, rule_code string")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_a_replayed_stream_publishes_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(10 * i + k, "s") for k in range(5)], "id long, overall_status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    base = f"file://{tmp_path}/p"
    split = lambda df: (df, df.select(F.col("id").alias("inspection_id"), F.explode(F.array(F.lit("LM-01"), F.lit("LM-02"))).alias("rule_code")))

    def run(checkpoint):
        stream = spark.readStream.schema("id long, overall_status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(published.publisher(base, split)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    run("a")
    first = read(spark, base)
    assert len(first[0]) == 15 and len(first[1]) == 30
    run("b")  # A lost checkpoint: every batch comes again.
    assert read(spark, base) == first


@pytest.mark.parametrize("n", [1, 2, 6, 7, 100, 5000])
def test_split_is_exact(spark, n):
    keys = [f"k{i}" for i in range(n)]
    df = spark.createDataFrame([(k, i) for k in keys for i in range(1 + len(k) % 2)] + [(None, 1)], "key string, i int")
    got = training.exact_split(df.repartition(3), "key")
    wanted = sorted(keys, key=lambda k: hashlib.md5(f"{k}/42".encode()).hexdigest())[: max(1, int(n * 0.15))]
    assert {r["key"] for r in got.filter("is_validation").collect()} == set(wanted) and got.count() == df.count()
    assert sorted(got.collect(), key=str) == sorted(training.exact_split(df.repartition(7, "i"), "key").collect(), key=str)


def test_split_of_nothing(spark):
    df = spark.createDataFrame([], "key string")
    assert training.exact_split(df, "key").count() == 0
    assert training.exact_split(spark.createDataFrame([(None,)], "key string"), "key").filter("is_validation").count() == 0


LABELS = [
    "Ingredients: Refined Wheat Flour, Emulsifier (INS 322 - Soy Lecithin), Acidity Regulator (INS-330), Colour (E102, INS 102), INS 999, ins 322(i), INS 500(ii).\nNet",
    "Ingredients: sunflower lecithins, Guar Gum and Citric  Acid, Citric Acid.\nNet Quantity 5 g",
    "Ingredients: Carrageenan extract, E-407, INS   150D, ins.621, e 12345, INS 4070.\nBest Before",
    "E211 INS 211a INS 2021 ins 955(x)",
    "",
    None,
]


@pytest.mark.parametrize("strict", [False, True])
def test_decoding_by_index_is_that_of_the_row(spark, strict):
    df = spark.createDataFrame(list(enumerate(LABELS)), "product_id long, text string")
    plain = {r["product_id"]: r for r in profile.profile(df, strict=strict).collect()}
    known = dimensions.additives(spark).withColumn("typical_use", F.concat(F.lit("use of "), "identifier"))
    got = {r["product_id"]: r for r in additives.profiles(df, known, "product_id", strict=strict).collect()}
    assert got.keys() == plain.keys()
    for k, r in plain.items():
        assert [tuple(a) for a in got[k]["additives"]] == [tuple(a) for a in r["additives"]], k
        assert all(got[k][c] == r[c] for c in ("ingredients", "allergens", "nutrition", "risks", "evidence_confidence"))
    rows = additives.decode(df, known, "product_id", strict=strict).collect()
    assert all((r["typical_use"] == f"use of {r['identifier']}") == r["recognized"] for r in rows) and any(not r["recognized"] for r in rows)


def test_names_are_found_by_grams(spark):
    known = spark.createDataFrame([(i, f"INS {i}", [], n, "", "green") for i, n in enumerate(["MSG", "Citric Acid", "acid", "A", "aaaa", "", "Ring (x)"])], dimensions.additives(spark).schema)
    names = ["msg", "xCITRIC ACIDy", "aaaaa", "b", "", "ring (x) 5", "Zinc"]
    got = {(r["name"], r["ordinal"]) for r in additives.resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), known).collect()}
    lower = [r["common_name"].lower() for r in sorted(known.collect(), key=lambda r: r["ordinal"])]
    assert got == {(n, i) for n in names for i, k in enumerate(lower) if k and k in n.lower()}


def test_database_table_is_read_in_ranges(spark):
    from labelwright.sources import tables as source

    url = "jdbc:derby:memory:labels;create=true"
    held = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, name string")
    held.write.format("jdbc").option("url", url).option("dbtable", "parts").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    whole = source.jdbc_table(spark, url, "parts")
    parts = source.jdbc_table(spark, url, "parts", key="id", lower=0, upper=20, partitions=4)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(whole) == rows(parts) == rows(held) and parts.rdd.getNumPartitions() == 4 and whole.rdd.getNumPartitions() == 1


def test_advice_follows_the_rating(spark):
    from labelwright.functions import text

    df = spark.createDataFrame([(0.9,), (0.70,), (0.5,), (0.40,), (0.1,)], "c double")
    assert [r[0].split()[2] for r in df.select(text.advice(F.col("c"))).collect()] == ["clear.", "clear.", "be", "be", "unclear;"]
