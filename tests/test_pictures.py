"""Pictures, videos and readings: decoding, sinks and sources, regions, skew, overlap, staged passes."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.functions import metrics, pixels
from labelwright.operators import frames, images, overlap, passes
from labelwright.sources import drawn, pictures


def png(rows, width, colour, depth, filters, palette=None):
    """A PNG by another hand: rows of bytes, each filtered as asked."""
    step = max(1, pixels.CHANNELS[colour] * depth // 8)
    raw, above = b"", bytes(len(rows[0]))
    for row, f in zip(rows, filters, strict=True):
        line = bytearray([f])
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((v - [0, a, b, (a + b) // 2, near][f]) % 256)
        raw, above = raw + bytes(line), row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    packed = zlib.compress(raw)
    parts = [chunk(b"IDAT", packed[:7]), chunk(b"IDAT", packed[7:])]
    return b"".join([pixels.MAGIC, chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)), *([chunk(b"PLTE", palette)] if palette else []), *parts, chunk(b"IEND", b"")])


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_png_is_decoded_whatever_its_filters(colour):
    rng = np.random.default_rng(colour)
    x = rng.integers(0, 256, (11, 9, pixels.CHANNELS[colour]), dtype=np.uint8)
    palette = rng.integers(0, 256, (256, 3), dtype=np.uint8)
    rgb = palette[x[:, :, 0]] if colour == 3 else x
    grey = rgb[:, :, 0].astype(float) if rgb.shape[2] < 3 else rgb[:, :, :3] @ (0.299, 0.587, 0.114)
    rows = [r.tobytes() for r in x]
    got = pixels.decode_png(png(rows, 9, colour, 8, rng.integers(0, 5, 11).tolist(), palette.tobytes() if colour == 3 else None))
    assert got.shape == (11, 9) and np.abs(got - grey).max() <= 0.51


def test_png_of_other_depths():
    bits = np.random.default_rng(1).integers(0, 2, (5, 13))
    assert (pixels.decode_png(png([np.packbits(r).tobytes() for r in bits], 13, 0, 1, [0, 1, 2, 3, 4])) == bits * 255).all()
    wide = np.random.default_rng(2).integers(0, 65536, (4, 6)).astype(">u2")
    assert (pixels.decode_png(png([r.tobytes() for r in wide], 6, 0, 16, [4, 3, 2, 1])) == wide >> 8).all()


def test_damaged_pictures_are_none(spark):
    g = np.random.default_rng(3).integers(0, 256, (20, 30), dtype=np.uint8)
    good = pixels.encode_png(g)
    assert (pixels.decode_png(good) == g).all()
    bomb = good[:16] + struct.pack(">II", 1 << 20, 1 << 20) + good[24:]
    bad = [good[:-30], good.replace(b"IDAT", b"IDAX"), bytes([*good[:60], good[60] ^ 1, *good[61:]]), bomb, b"\xff\xd8jpeg", b"", None]
    rows = [(0, good), *((i + 1, b) for i, b in enumerate(bad))]
    got = pictures.decoded(spark.createDataFrame(rows, "i int, content binary").withColumn("width", F.lit("clash"))).orderBy("i").collect()
    assert (got[0]["width"], got[0]["height"], bytes(got[0]["pixels"])) == (30, 20, g.tobytes()) and all(r["pixels"] is None and r["width"] is None for r in got[1:])
    assert pictures.decoded(spark.createDataFrame(rows, "i int, content binary"), most_pixels=599).filter("pixels is not null").count() == 0


def test_sink_writes_pictures_and_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(pictures.PictureSink)
    rows = spark.range(40).select("id", F.concat(F.col("id").cast("string"), F.lit(".png")).alias("name"))
    made = drawn.drawn(rows, lambda i: drawn.stripes(10 + i % 3, 8, i, 2 * i), "id").select("name", "width", "height", "pixels").repartition(4)
    path = f"file://{tmp_path}/out"
    save = lambda df, mode: df.write.format("labelwright_pictures").option("path", path).mode(mode).save()
    back = lambda: {r["path"].rsplit("/", 1)[1]: bytes(r["pixels"]) for r in pictures.decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)).collect()}
    save(made, "append")
    first = back()
    assert first == {f"{i}.png": drawn.stripes(10 + i % 3, 8, i, 2 * i).tobytes() for i in range(40)}
    before = sorted(str(p) for p in (tmp_path / "out").rglob("*"))
    bad = made.withColumn("pixels", F.when(F.col("name") == "39.png", F.lit(b"x")).otherwise(F.col("pixels")))
    with pytest.raises(Exception, match="no picture to write"):
        save(bad, "append")
    assert sorted(str(p) for p in (tmp_path / "out").rglob("*") if "_temporary" not in str(p)) == [x for x in before if "_temporary" not in x]
    assert not [p for p in (tmp_path / "out").rglob("*.png") if "_temporary" in str(p)] and back() == first
    save(made.filter("name like '1%'"), "overwrite")
    assert back() == {k: v for k, v in first.items() if k.startswith("1")}


def video(path, w, h, n, fps, kind="mono"):
    rng = np.random.default_rng(n)
    luma = rng.integers(0, 256, (n, h, w), dtype=np.uint8)
    chroma = {"mono": 0, "420jpeg": 2 * (-(-w // 2)) * (-(-h // 2)), "422": 2 * (-(-w // 2)) * h, "444": 2 * w * h}[kind]
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F{fps} Ip C{kind}\n".encode())
        for g in luma:
            f.write(b"FRAME\n" + g.tobytes() + bytes(chroma))
    return luma


@pytest.mark.parametrize("size", [64 << 20, 900])
def test_sampled_frames_are_those_of_a_plain_reader(spark, tmp_path, size):
    spark.dataSource.register(pictures.VideoSource)
    made = {"a": (video(tmp_path / "a.y4m", 17, 9, 40, "30000:1001", "420jpeg"), 19), "b": (video(tmp_path / "b.y4m", 8, 8, 7, "1:1"), 1), "c": (video(tmp_path / "c.y4m", 8, 6, 11, "0:0", "422"), 16), "d": (video(tmp_path / "d.y4m", 8, 6, 0, "25:1", "444"), 16)}
    got = spark.read.format("labelwright_video").option("path", f"file://{tmp_path}").option("bytes", size).load()
    rows = {(r["video"], r["frame_num"]): (r["width"], r["height"], bytes(r["pixels"])) for r in got.collect()}
    assert rows == {(v, k): (luma.shape[2], luma.shape[1], luma[k].tobytes()) for v, (luma, step) in made.items() for k in range(0, len(luma), step)}
    if size == 900:
        assert got.rdd.getNumPartitions() > 3
    (tmp_path / "x.y4m").write_bytes(b"no video\n")
    with pytest.raises(Exception, match="no uncompressed video"):
        spark.read.format("labelwright_video").option("path", f"file://{tmp_path}/x.y4m").load().count()


def test_wide_frames_are_shrunk(spark, tmp_path):
    g = np.random.default_rng(1).integers(0, 256, (4, 2560), dtype=np.uint8)
    assert (pixels.shrunk(g, 1280, 2) == np.rint(g.reshape(2, 2, 1280, 2).astype(float).mean((1, 3)))).all()
    spark.dataSource.register(pictures.VideoSource)
    video(tmp_path / "w.y4m", 2560, 4, 1, "1:1")
    r = spark.read.format("labelwright_video").option("path", f"file://{tmp_path}").load().first()
    assert (r["width"], r["height"]) == (1280, 2)


def test_written_videos_come_back(spark, tmp_path):
    spark.dataSource.register(pictures.VideoSource)
    rows = spark.range(60).select((F.col("id") % 3).alias("video"), F.col("id").alias("frame_num"))
    made = drawn.drawn(rows.repartition(5), lambda v, n: drawn.stripes(6 + v, 5, n, 3 * n % 256), "video", "frame_num")
    counts = {r["video"]: r["frames"] for r in pictures.write_videos(made, f"file://{tmp_path}/v", (3, 2)).collect()}
    assert counts == {"0": 20, "1": 20, "2": 20}
    got = {(r["video"], r["frame_num"]): bytes(r["pixels"]) for r in spark.read.format("labelwright_video").option("path", f"file://{tmp_path}/v").load().collect()}
    assert got == {(str(v), i): drawn.stripes(6 + v, 5, v + 3 * i, 3 * (v + 3 * i) % 256).tobytes() for v in range(3) for i in range(20)}


def test_frames_feed_gates_and_keyframes(spark, tmp_path):
    spark.dataSource.register(pictures.VideoSource)
    rows = spark.range(24).select(F.lit(1).alias("video"), F.col("id").alias("frame_num"))
    made = drawn.drawn(rows, lambda n: drawn.stripes(32, 32, 8 * (n // 4), 8 * (n // 4) + 120) if n % 4 else np.full((32, 32), 90, dtype=np.uint8), "frame_num")
    pictures.write_videos(made, f"file://{tmp_path}/v", (1, 1)).collect()
    found = spark.read.format("labelwright_video").option("path", f"file://{tmp_path}/v").load()
    r = frames.keyframes(images.frame_metrics(found), "video").first()
    # Every fourth frame is flat; the three after it look alike.
    assert (r["frames_sampled"], r["motion_blur"], r["duplicate_views"]) == (24, 6, 12) and [k["frame_index"] for k in r["keyframes"]] == [4 * i + 1 for i in range(6)]


def test_a_hot_video_passes_in_batches(spark):
    rng = np.random.default_rng(4)
    base = rng.random((12, 32))
    rows = spark.range(30_000).select(F.lit(1).alias("v"), F.col("id").alias("n"))
    kinds = [x.tolist() for x in base]
    df = rows.withColumn("histogram", F.element_at(F.array(*(F.array(*map(F.lit, k)) for k in kinds)), (F.pmod(F.xxhash64("n"), F.lit(12)) + 1).cast("int")))
    got = [r["n"] for r in frames.distinct_rows(df.repartition(8), "v", "n").orderBy("n").collect()]
    seen, wanted = [], []
    for r in df.orderBy("n").limit(500).collect():
        h = np.array(r["histogram"])
        if all(np.corrcoef(h, k)[0, 1] <= 0.94 for k in seen):
            seen.append(h)
            wanted.append(r["n"])
    assert got == wanted and len(got) == 12


@pytest.mark.parametrize("turn", [0, 3, 20, -12, 44, 89])
def test_least_rectangle_against_all_angles(turn):
    rng = np.random.default_rng(abs(turn))
    a = np.radians(turn)
    pts = np.unique(np.rint(rng.uniform((-60, -20), (60, 20), (400, 2)) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(int), axis=0)
    h = pixels.hull(pts)
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    assert all(cross(h[i], h[(i + 1) % len(h)], p) >= 0 for i in range(len(h)) for p in pts) and {tuple(x) for x in h.tolist()} <= {tuple(x) for x in pts.tolist()}
    area, angle = pixels.least_rectangle(pts)
    best = min((np.ptp(pts @ (np.cos(t), np.sin(t))) * np.ptp(pts @ (-np.sin(t), np.cos(t))) for t in np.radians(np.arange(0, 90, 0.05))))
    assert area <= best + 1e-6 and area >= best * 0.98 and min((angle - turn) % 90, (turn - angle) % 90) < 4


def test_skew_of_a_turned_page():
    assert pixels.skew(np.full((50, 50), 200, dtype=np.uint8)) == 0
    y, x = np.mgrid[:240, :320]
    for turn in (0, 5, -8):
        a = np.radians(turn)
        u, v = (x - 160) * np.cos(a) + (y - 120) * np.sin(a), -(x - 160) * np.sin(a) + (y - 120) * np.cos(a)
        page = np.where((np.abs(u) < 120) & (np.abs(v) < 50) & (v % 16 < 6), 30, 220).astype(np.uint8)
        # Points are (row, column), so a page that turns one way has an angle that turns the other.
        assert abs(abs(pixels.skew(page)) - abs(turn)) < 1.5


def flood(mask):
    """(area, x1, y1, x2, y2) of each four-connected component, by its pixels."""
    h, w = mask.shape
    seen, out = np.zeros_like(mask), {}
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            p, q = stack.pop()
            own.append((p, q))
            for a, b in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                if 0 <= a < h and 0 <= b < w and mask[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    stack.append((a, b))
        ys, xs = zip(*own, strict=True)
        out[frozenset(own)] = (len(own), min(xs), min(ys), max(xs) + 1, max(ys) + 1)
    return out


def test_component_tree_against_flood_fill():
    rng = np.random.default_rng(6)
    for levels in (3, 9, 200):
        g = rng.integers(0, levels, (13, 11)).astype(np.uint8)
        wanted, parents = set(), {}
        for v in sorted(set(g.ravel().tolist())):
            for own, box in flood(g <= v).items():
                if any(g[p] == v for p in own):
                    wanted.add((v, *box))
                    parents[(v, *box)] = min((u for u in sorted(set(g.ravel().tolist())) if u > v and next(len(o) > len(own) for o in flood(g <= u) if own <= o)), default=None)
        nodes = pixels.component_tree(g)
        real = [n for n in nodes if n[6] > -2]
        assert sorted(tuple(n[:6]) for n in real) == sorted(wanted)
        assert all((nodes[n[6]][0] if n[6] >= 0 else None) == parents[tuple(n[:6])] and (n[6] < 0 or nodes[n[6]][6] > -2) for n in real)


def test_component_tree_grows_with_zones_not_with_pixels():
    assert len(pixels.component_tree(drawn.block(120, 100, 20, 30, 12, 9))) == 2
    large = np.full((900, 1100), 255, dtype=np.uint8)
    for i in range(40):
        large[20 * i + 5 : 20 * i + 17, 25 * i : 25 * i + 14] = i
    nodes = pixels.component_tree(large)
    assert len(nodes) == 41 and sorted(n[:6] for n in nodes)[:40] == [[i, 168, 25 * i, 20 * i + 5, 25 * i + 14, 20 * i + 17] for i in range(40)]
    # A spiral is one zone inside another, however many runs it has.
    spiral, at, step = np.zeros((41, 41), dtype=np.uint8), [0, 0], (0, 1)
    spiral[0, 0] = 200
    for n in [40, *(k for k in range(40, 0, -2) for _ in range(2))]:
        for _ in range(n):
            at = [at[0] + step[0], at[1] + step[1]]
            spiral[tuple(at)] = 200
        step = step[1], -step[0]
    value, spans, pairs = pixels.flat_zones(spiral)
    assert value.tolist() == [200, 0] and spans[:, 0].tolist() == [int((spiral == 200).sum()), int((spiral == 0).sum())] and pairs.tolist() == [[0, 1]]


def test_zones_of_one_value_join_through_what_is_lower():
    g = np.zeros((60, 60), dtype=np.uint8)
    g[1::2, 1::2] = 9
    g[:, 30] = 5
    real = [n for n in pixels.component_tree(g) if n[6] > -2]
    assert sorted(n[:6] for n in real) == [[0, 1290, 31, 0, 60, 60], [0, 1350, 0, 0, 30, 60], [5, 2700, 0, 0, 60, 60], [9, 3600, 0, 0, 60, 60]]


def test_stable_regions_of_drawn_pictures(spark):
    g = np.full((120, 160), 230, dtype=np.uint8)
    marks = [(10, 10, 22, 24), (60, 30, 75, 40), (100, 80, 112, 95)]
    for i, (x1, y1, x2, y2) in enumerate(marks):
        g[y1:y2, x1:x2] = 20 + 30 * i
    g[50:52, 50:53] = 0  # Too small.
    got = pixels.stable_regions(g)
    assert got == sorted(marks, key=lambda b: (b[1], b[0]))
    assert pixels.stable_regions(255 - g) == got and pixels.stable_regions(np.full((40, 40), 9, dtype=np.uint8)) == []
    df = spark.createDataFrame([(1, 160, 120, bytearray(g.tobytes())), (2, 5, 5, None)], "image_id long, width int, height int, pixels binary")
    found = {r["image_id"]: [tuple(b) for b in r["boxes"]] for r in images.text_regions(df).collect()}
    assert found == {1: got, 2: []}


def test_edges_are_thin_and_joined():
    g = np.zeros((30, 40), dtype=np.uint8)
    g[:, 20:] = 200
    e = pixels.edges(g)
    assert e.sum(1).tolist() == [1] * 30 and set(np.argwhere(e)[:, 1].tolist()) <= {19, 20}
    faint = np.zeros((30, 40), dtype=np.uint8)
    faint[:, 20:] = 30  # Above the low threshold alone: no edge, unless it goes on from one.
    assert not pixels.edges(faint).any()
    faint[:10, 20:] = 200
    assert pixels.edges(faint)[12:28].any()


def test_overlap_against_all_pairs(spark):
    a, b = drawn.texture(1), drawn.texture(2)
    shifted = np.hstack([a[:, 30:], b[:, :30]])
    da, ds, db = (overlap.descriptors(g) for g in (a, shifted, b))
    bits = lambda x: np.unpackbits(x, axis=1)

    def plain(x, y):
        p, q = bits(x), bits(y)
        d = [[int((u != v).sum()) for v in q] for u in p]
        to = [r.index(min(r)) for r in d]
        back = [min(range(len(p)), key=lambda i: d[i][j]) for j in range(len(q))]
        return min(1.0, sum(back[j] == i and d[i][j] < 55 for i, j in enumerate(to)) / max(len(p), len(q)) * 3.5)

    for x, y in ((da, ds), (da, db), (da, da)):
        assert overlap.overlap(x, y) == pytest.approx(plain(x, y))
    assert overlap.overlap(da, da) == 1 and overlap.overlap(da, ds) > overlap.overlap(da, db) and overlap.overlap(da, da[:9]) == 0
    rows = [(1, i, 96, 96, bytearray(g.tobytes())) for i, g in enumerate((a, a, b))] + [(2, 0, 96, 96, bytearray(a.tobytes())), (3, 0, 96, 96, None), (3, 1, 96, 96, bytearray(a.tobytes()))]
    df = spark.createDataFrame(rows, "g long, i int, width int, height int, pixels binary")
    got = {r["g"]: (r["n_images"], r["overlap_confidence"]) for r in overlap.panoramas(df, "g", "i").collect()}
    assert got == {1: (3, pytest.approx((1 + overlap.overlap(da, db)) / 2)), 2: (1, 0.0), 3: (2, 0.0)}


def test_staged_passes_are_the_fold_and_read_ever_less(spark):
    rnd = random.Random(7)
    labels = [(i, rnd.choice([0.0, 0.3, 0.5, 0.7, 0.9]), rnd.random(), rnd.choice([0.9, 1.0, 1.2]), rnd.choice(["", "x" * 20, "x" * 60])) for i in range(300)]
    readings = [(i, p, rnd.choice(["", " ", "y" * 10, "y" * 50]), rnd.random()) for i in range(300) for p in passes.PASSES if rnd.random() < 0.7]
    first = spark.createDataFrame(labels, "label_id long, first_confidence double, first_score double, aspect double, text string")
    table = spark.createDataFrame(readings, "label_id long, pass string, text string, confidence double")
    asked = []

    def read(name, keys):
        asked.append((name, keys.count()))
        return passes.from_table(table)(name, keys)

    got = {r["label_id"]: (r["ran"], r["retries"], r["passes"], r["best_confidence"]) for r in passes.staged(first, read).collect()}
    held = table.groupBy("label_id").agg(F.map_from_entries(F.collect_list(F.struct("pass", F.struct("text", "confidence")))).alias("m"))
    rows = first.join(held, "label_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,struct<text:string,confidence:double>>")))
    known = F.map_concat("m", F.create_map(F.lit("natural"), F.struct("text", F.lit(0.0).alias("confidence"))))
    plan = metrics.reading_plan(F.col("first_confidence"), F.col("first_score"), F.col("aspect"), known, F.map_keys("m"))
    wanted = {r["label_id"]: tuple(r["p"][c] for c in ("ran", "retries", "passes", "best_confidence")) for r in rows.select("label_id", plan.alias("p")).collect()}
    assert got == wanted
    counts = dict(asked)
    assert [n for n, _ in asked] == list(passes.PASSES) and counts["natural_90deg"] < 300 and counts["variant_crop"] >= counts["variant_a"] >= counts["variant_b"] >= counts["variant_d"] and counts["region"] < counts["variant_a"]
    assert passes.staged(first.limit(0), passes.from_table(table)).count() == 0


def test_pictures_come_in_partitions_of_a_bounded_number(spark):
    rows = spark.range(5000).coalesce(1).selectExpr("id", "cast(id % 7 as int) as a")
    found = drawn.drawn(rows, lambda a: drawn.stripes(4, 2, a, a), "a", most=512)
    held = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("pixels").alias("n")).select("n").collect()]
    assert sum(held) == 5000 and max(held) <= 600


def test_pictures_are_made_once_and_pairs_of_a_large_group_are_dealt_out(spark):
    rows = spark.range(9).select(F.lit(1).alias("nation"), F.col("id").alias("position"), F.when(F.col("id") != 4, 3).alias("seed"))
    found = overlap.panoramas(drawn.drawn(rows, drawn.texture, "seed"), "nation", "position")
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") == 3 and "REPARTITION_BY_NUM" in plan.split("Window")[0]
    assert [tuple(r) for r in found.collect()] == [(1, 9, 0.75)]
