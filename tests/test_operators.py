import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright import queries
from labelwright.operators import boxes, consensus, dashboards, frames, images, training
from labelwright.plans import dashboard
from labelwright.sources import sinks, tables
from labelwright.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_frames_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(v, n, 50.0 + n, 100.0, 30.0, 0.05, (base := np.repeat(rng.random(4), 8) + rng.random(32) * 0.2).tolist()) for v in range(3) for n in range(15)]
    rows.append((9, 0, 1.0, 100.0, 30.0, 0.05, base.tolist()))
    df = spark.createDataFrame(rows, "video_id long, frame_num long, sharpness double, brightness double, contrast double, edge_density double, histogram array<double>")
    got = {r["video_id"]: r for r in frames.keyframes(df).collect()}
    for v in range(3):
        kept = []
        for r in (x for x in rows if x[0] == v):
            if all(np.corrcoef(r[6], k[6])[0, 1] <= 0.94 for k in kept):
                kept.append(r)
        n = len(kept)
        chosen = [kept[int(i * (n / 8))] for i in range(8)] if n > 8 else kept
        assert [k["frame_index"] for k in got[v]["keyframes"]] == [k[1] for k in chosen] and got[v]["duplicate_views"] == 15 - n
    assert got[9]["keyframes"][0]["quality_score"] == 60.0 and got[9]["motion_blur"] == 1


def test_boxes_against_a_loop(spark):
    rnd = random.Random(2)
    groups = [[(x := rnd.randrange(200), y := rnd.randrange(100), x + rnd.randrange(1, 40), y + rnd.randrange(1, 20)) for _ in range(n)] for n in (0, 1, 7, 30)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, b array<struct<x1:int,y1:int,x2:int,y2:int>>")
    got = [[tuple(b) for b in r["c"]] for r in df.select("i", boxes.cluster(F.col("b")).alias("c")).orderBy("i").collect()]
    for g, found in zip(groups, got, strict=True):
        done = []
        for b in sorted(g, key=lambda b: (b[1], b[0], b[2], b[3])):
            if done and b[0] <= done[-1][2] + 15 and b[2] >= done[-1][0] - 15 and b[1] <= done[-1][3] + 8 and b[3] >= done[-1][1] - 8:
                m = done.pop()
                b = (min(m[0], b[0]), min(m[1], b[1]), max(m[2], b[2]), max(m[3], b[3]))
            done.append(b)
        assert found == done


def test_image_metrics(spark):
    flat, checks = bytes([100]) * 400, bytes((255 * ((i // 20 + i) % 2)) for i in range(400))
    df = spark.createDataFrame([(1, 20, 20, bytearray(flat)), (2, 20, 20, bytearray(checks)), (3, 9, 9, None)], "image_id long, width int, height int, pixels binary")
    got = {r["image_id"]: r for r in images.image_metrics(df).collect()}
    assert got[1]["sharpness"] == 0 and got[1]["blockiness"] == 0 and got[2]["sharpness"] > 1e5 and got[3]["sharpness"] is None


def test_view_labels(spark):
    df = spark.createDataFrame([(0, '["Front", " ", "Top"]'), (1, "a, ,b "), (2, '"One"'), (3, None)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(tables.view_labels(F.col("s"))).collect()] == [["Front", "Top"], ["a", "b"], ["One"], []]


def test_image_requests(spark, tmp_path):
    for request, n in (("a", 2), ("b", 9)):
        (tmp_path / request).mkdir()
        for i in range(n):
            (tmp_path / request / f"{i}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 20)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "t.txt").write_bytes(b"no picture")
    got = {r["request"]: r["admissible"] for r in tables.image_requests(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, at string").withColumn("created_at", F.to_timestamp("at"))
    sinks.write_inspections(df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).filter("created_date = '2024-01-02'").count() == 1


def test_findings_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "LM-01", "Pass"), (1, "LM-02", "Fail")], "inspection_id long, rule_code string, status string")
    sinks.write_violations(df, str(tmp_path / "v"))
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "v")).filter("rule_code = 'LM-02'").collect()] == ["Fail"]


def test_label_files(spark, tmp_path):
    blocks = spark.createDataFrame([(1, "MRP 5", 0, 0, 100, 50, 200, 100), (1, "x", 0, 0, 2, 2, 200, 100), (2, "best before", 100, 50, 200, 100, 200, 100)], "id long, text string, x1 int, y1 int, x2 int, y2 int, width int, height int")
    training.write_label_files(training.label_lines(blocks), str(tmp_path / "l"))
    assert {r["id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "l")).collect()} == {1: "2 0.250000 0.250000 0.500000 0.500000", 2: "3 0.750000 0.750000 0.500000 0.500000"}


def test_dashboard_by_role(spark):
    rows = [(1, 7, "Compliant", 100.0), (2, 7, "Non-Compliant", 50.0), (3, 8, "Compliant", 90.0)]
    inspections = spark.createDataFrame(rows, "id long, inspector_id long, overall_status string, compliance_score double").withColumn("created_at", F.to_timestamp(F.lit("2024-01-01"))).withColumn("product_name", F.lit("p"))
    violations = spark.createDataFrame([(1, "LM-01", "Pass"), (3, "LM-01", "Fail")], "inspection_id long, rule_code string, status string")
    rules, users = spark.createDataFrame([("LM-01", "d")], "rule_code string, description string"), spark.createDataFrame([(7, "a", "a@x", "inspector"), (8, "b", "b@x", "viewer")], "id long, name string, email string, role string")
    show = lambda who, own=None: dashboard.dashboard(inspections, violations, rules, users, who, own)
    seen = {role: show(dashboards.Principal(7, role)) for role in ("inspector", "viewer", "admin")}
    assert [seen[r]["totals"].first()["total"] for r in ("inspector", "viewer", "admin")] == [2, 3, 3]
    assert [("progress" in seen[r]) for r in ("inspector", "viewer", "admin")] == [False, False, True]
    assert seen["inspector"]["breakdown"].first()["fail_count"] == 0 and seen["viewer"]["breakdown"].first()["fail_count"] == 1
    assert show(dashboards.Principal(1, "admin"), 8)["totals"].first()["total"] == 1 and seen["inspector"]["trend"].count() == 2


def test_collected_passes(spark):
    rows = spark.createDataFrame([(1, 1, "MRP Rs. 5", 0.5), (1, 0, "MRP Rs. 5.00 incl. of all taxes", 0.9)], "product_id long, pass_ord int, text string, confidence double").withColumn("blocks", F.array().cast("array<struct<text:string,confidence:double,source_pass:string>>"))
    found = consensus.consensus(consensus.collect_passes(rows)).first()
    assert found["raw_text"].startswith("MRP Rs. 5.00") and found["confidence"] == 0.9


def test_stream(spark, tmp_path):
    rows = [(i, "B", "Front", f"MRP Rs. {i + 5}.00" + " incl. of all taxes" * (i % 2), True, f"2024-01-01 00:0{i}:00") for i in range(6)]
    df = spark.createDataFrame(rows, "product_id long, brand string, view string, text string, is_food boolean, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    found = ingest.findings(ingest.label_stream(spark, str(tmp_path / "in")))
    q = ingest.write_findings(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 42 and out.filter("rule_code = 'LM-03' AND status = 'Pass'").count() == 3


QUICK = ["dashboard_totals", "dashboard_breakdown", "dashboard_trend", "inspection_page", "status_rollup", "windowed_findings", "gated_frames", "top_regions", "parsed_view_labels", "box_clusters", "uncovered_boxes", "owner_rates", "breakdown_of_unknown_codes", "picture_metrics", "validation_split", "block_confidences"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    ours = df.toPandas()
    theirs = con.sql(queries.ORACLES[name]).df()[list(ours.columns)]
    text = lambda d: sorted(map(tuple, d.astype(object).where(d.notna(), None).map(lambda v: f"{float(v):.6f}" if isinstance(v, float | int | np.number) and not isinstance(v, bool) else str(v)).to_numpy().tolist()))
    assert text(ours) == text(theirs)
