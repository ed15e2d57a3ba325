from pyspark.sql import functions as F

import corpus_pipeline as cp

BASE = " ".join(f"w{i}" for i in range(60))


def test_stages(spark, tmp_path):
    other = [" ".join(f"c{i}x{j}" for j in range(40)) for i in range(20)]
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, f"menu\n{t}", "en", f"s{i % 12}", 1) for i, t in enumerate(other)]
    rows += [(100, BASE, "en", "s1", 1), (101, BASE.replace("w30", "v"), "en", "s2", 1), (102, "too short", "en", "s3", 1), (103, f"{other[0].replace('c0x', 'd')} {item}", "en", "s4", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [{100, 101, 103, *range(20)}, {100, 101, 103, *range(20)}, {100, 103, *range(20)}, {100, *range(20)}]
    now = docs
    for (_, stage), ids in zip(cp.STAGES[:-1], left, strict=True):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and {r["doc_id"] for r in now.select("doc_id").collect()} == ids and now.count() == len(ids)
    assert {r["text"].split("\n")[0] for r in now.filter("doc_id < 20").collect()} == set(other)
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == left[-1]


def test_boilerplate_goes_whatever_its_share(spark, tmp_path):
    menu = " ".join(f"menu{j}" for j in range(20))
    rows = [(i, f"{menu}\nown{i} line", "en", f"s{i}", 1) for i in range(12)] + [(50, f"{menu}\n", "en", "s1", 1), (60, menu, "en", "s2", 1), (61, menu, "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert got == {i: (f"own{i} line", len(f"own{i} line")) for i in range(12)} | {50: ("", 0), 60: (menu, 1), 61: (menu, 1)}  # A text of boilerplate keeps it only if it stands twice.


def test_null_ids_are_judged_by_their_texts(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    alone = " ".join(f"a{i}" for i in range(40))
    rows = [(1, BASE, "s"), (None, BASE, "s"), (None, BASE.replace("w30", "v"), "s"), (None, alone, "s"), (None, alone, "t"), (None, alone.replace("a0 ", "b "), "s"), (None, None, "s"), (None, " ", "s"), (None, " ", "s"), (None, f"{item} x", "s"), (2, "one two three four", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = cp.near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert sum(bool(t and ("a1 " in t)) for _, t in got) == 1 and got.count((None, " ")) == 2 and got.count((None, None)) == 1
    assert (1, BASE) in got and (2, "one two three four") in got and len(got) == 7
    left = cp.benchmark_decontamination(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and left.count() == len(rows) - 1 and not left.filter(left.text.contains("q5")).count()


EDGES = [(1, BASE, "en", "s", 1), (1, BASE, "en", "s", 1), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0), (4, " \n ", "en", "s", 3), (None, BASE, None, None, 9)]
EDGES += [(5, "x " + " ".join(f"z{i}" for i in range(20_000)), "en", "s", 1), (6, " ".join(f"y{i}" for i in range(30)), "en", "s", 1), (6, " ".join(f"y{i}" for i in range(30)), "en", "t", 1)]
CLASH = ("count", "host", "kept", "digest", "sid", "path", "start", "item_id", "line_removed", "wholly_spread", "draw", "copies", "group_id")


def test_stages_with_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit("own").alias(c) for c in CLASH))
    spark.createDataFrame([(0, " ".join(f"y{i}" for i in range(5, 25))), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"quality_rules": [1, 1, 5, 6, 6], "line_dedup": [None, None, 1, 1, 2, 3, 4, 5, 6, 6], "near_duplicates": [None, 1, 2, 3, 4, 5, 6], "benchmark_decontamination": [None, None, 1, 1, 2, 3, 4, 5]}
    key = lambda x: (x is not None, x)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted((r["doc_id"] for r in rows), key=key) == kept[name], name
        assert all(r[c] == "own" for r in rows for c in CLASH)
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0
    pieces = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in whole} == {None, 1, 2, 3, 4, 5, 6} and next(r["n"] for r in whole if r["doc_id"] == 2) == 1
    assert cp.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
