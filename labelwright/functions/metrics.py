"""Decisions over image, frame, region and box metrics (I3, I5, I7, I8, V1, V3, F10, K8, K9, P1) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Limits of the quality gate.
LIMITS = {"blur": 40.0, "width": 300, "height": 200, "dark": 30.0, "bright": 245.0, "contrast": 20.0, "noise": 35.0, "skew": 45.0}


def quality(m: Column, limits: dict | None = None) -> Column:
    """Struct of is_acceptable, quality_score and rejection_reasons.

    m: struct of width, height, sharpness, brightness, contrast, glare_fraction, noise, skew, edge_density; a null struct
    is an empty picture.
    """
    x = LIMITS | (limits or {})
    reasons = F.array_compact(
        F.array(
            F.when((m["width"] < x["width"]) | (m["height"] < x["height"]), "resolution"),
            F.when(m["sharpness"] < x["blur"], "blur"),
            F.when(m["brightness"] < x["dark"], "dark").when(m["brightness"] > x["bright"], "overexposed"),
            F.when(m["contrast"] < x["contrast"], "contrast"),
            F.when((m["glare_fraction"] > 0.92) & (m["contrast"] < 25.0), "glare"),
            F.when(m["noise"] > x["noise"], "noise"),
            F.when(F.abs(m["skew"]) > x["skew"], "skew"),
            F.when((m["edge_density"] < 0.005) & (m["sharpness"] < x["blur"] * 1.5), "no text"),
        )
    )
    one = F.lit(1.0)
    area = m["width"].cast("double") * m["height"]
    raw = F.least(one, m["sharpness"] / 300.0) * 35.0 + F.least(one, m["contrast"] / 60.0) * 25.0 + (1.0 - F.abs(m["brightness"] - 128.0) / 128.0) * 20.0 + F.least(one, area / (1200.0 * 900.0)) * 20.0
    graded = let(reasons, lambda r: F.struct((F.size(r) == 0).alias("is_acceptable"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 1))).alias("quality_score"), r.alias("rejection_reasons")))
    empty = F.struct(F.lit(False).alias("is_acceptable"), F.lit(0.0).alias("quality_score"), F.array(F.lit("empty")).alias("rejection_reasons"))
    return F.when(m.isNull(), empty).otherwise(graded)


def good_crop(width: Column, height: Column, crop_width: Column, crop_height: Column) -> Column:
    """Whether a crop keeps a fifth to 95 % of the area at a plausible shape."""
    area, crop = width.cast("double") * height, crop_width.cast("double") * crop_height
    shape = crop_width / F.greatest(F.lit(1), crop_height)
    return crop.between(0.20 * area, 0.95 * area) & shape.between(0.15, 6.0)


def frame_discard(sharpness: Column, brightness: Column, contrast: Column, min_sharpness: float = 35.0) -> Column:
    """why a frame is discarded, else null."""
    return F.when(sharpness < min_sharpness, "motion_blur").when((brightness < 25) | (brightness > 245) | (contrast < 18), "poor_lighting")


def frame_score(sharpness: Column, contrast: Column, edge_density: Column) -> Column:
    """V1."""
    return F.least(F.lit(100.0), F.least(sharpness, F.lit(200.0)) * 0.4 + contrast * 0.3 + edge_density * 800.0 * 0.3)


def frame_view(at: Column, total: Column, upper: Column, lower: Column, aspect: Column) -> Column:
    """V3: struct of view and confidence of the at-th of total keyframes, by its share of the sequence."""
    share = at / F.greatest(total, F.lit(1))
    phase = share - F.floor(share)
    raw = (
        F.when(total == 1, F.struct(F.lit("Front").alias("view"), F.lit(0.90).alias("c")))
        .when(phase < 0.25, F.struct(F.lit("Front").alias("view"), (0.88 + F.least(F.lit(0.08), upper * 2.0)).alias("c")))
        .when(phase < 0.50, F.struct(F.lit("Left Side").alias("view"), (0.78 + F.least(F.lit(0.12), F.abs(aspect - 0.7) * 0.2)).alias("c")))
        .when(phase < 0.75, F.struct(F.lit("Back").alias("view"), (0.86 + F.least(F.lit(0.10), lower * 2.0)).alias("c")))
        .otherwise(F.struct(F.lit("Right Side").alias("view"), (0.80 + F.least(F.lit(0.10), upper)).alias("c")))
    )
    return let(raw, lambda r: F.struct(r["view"].alias("view"), F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.65), r["c"])), 3).alias("confidence")))


def region_type(x1: Column, y1: Column, x2: Column, y2: Column, height: Column, width: Column) -> Column:
    """What a box of a label most likely holds."""
    w, h = x2 - x1, y2 - y1
    share = w * h / F.greatest(F.lit(1), height * width)
    cx, cy = (x1 + x2) / 2.0 / width, (y1 + y2) / 2.0 / height
    return (
        F.when((cy < 0.35) & (cx > 0.3) & (cx < 0.7) & (share > 0.04), "product_name")
        .when((cy > 0.60) & (share < 0.06), "date_fssai")
        .when((cx > 0.65) & (share < 0.1), "mrp_quantity")
        .when((h > 2.5 * w) & (share > 0.02), "manufacturer")
        .otherwise("general_text")
    )


def detector(yolo: Column, craft: Column, mser: Column, least: int = 2) -> Column:
    """I8: the regions of the first detector that finds enough, else none."""
    return F.coalesce(*(F.when(F.size(c) >= least, c) for c in (yolo, craft, mser)), F.slice(yolo, 1, 0))


#: Words of a text block and the class they give it, in order; fields and their classes.
BLOCK_CLASSES = [
    ("date_fssai", ["fssai", "lic no", "licence"]),
    ("date_fssai", ["mfg", "mfd", "exp", "best before", "packed"]),
    ("mrp_quantity", ["mrp", "m.r.p", "₹", "rs.", "price"]),
    ("mrp_quantity", ["net", "kg", "gm", "ml", "ltr", "pcs"]),
    ("manufacturer", ["manufactured", "marketed", "packed by", "pvt", "ltd", "industries"]),
]
FIELD_CLASSES = {"manufacturer_details": "manufacturer", "net_quantity": "mrp_quantity", "mrp": "mrp_quantity", "manufacture_date": "date_fssai", "customer_care": "general_text", "fssai_license": "date_fssai", "country_of_origin": "general_text"}

#: Class, centre and size of the zones that stand in for missing boxes.
ZONES = {"manufacturer": (0.3, 0.65, 0.55, 0.25), "date_fssai": (0.5, 0.82, 0.9, 0.14), "mrp_quantity": (0.75, 0.45, 0.4, 0.15)}
ZONE_FIELDS = ["manufacturer_details", "fssai_license", "manufacture_date", "mrp", "net_quantity"]


def block_class(text: Column) -> Column:
    """K8."""

    def of(t: Column) -> Column:
        c = F.lit("general_text")
        for label, words in reversed(BLOCK_CLASSES):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(t, F.lit(w))
            c = F.when(hit, label).otherwise(c)
        return c

    return let(F.lower(text), of)


def normal_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """K9: struct of cx, cy, w, h as shares, held within the picture; null for boxes under 5 by 3 pixels."""
    within = lambda c: F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))
    box = F.struct(
        within((x1 + x2) / 2.0 / width).alias("cx"), within((y1 + y2) / 2.0 / height).alias("cy"), F.least((x2 - x1) / width, F.lit(0.999)).alias("w"), F.least((y2 - y1) / height, F.lit(0.999)).alias("h")
    )
    return F.when((x2 - x1 >= 5) & (y2 - y1 >= 3), box)


def zone_boxes(fields: Column) -> Column:
    """K9: boxes for fields that were found where there are no text blocks."""
    one = lambda n: F.when(fields[n]["status"].isin("found", "low_confidence"), F.struct(F.lit(FIELD_CLASSES[n]).alias("class"), *(F.lit(v).alias(k) for k, v in zip(("cx", "cy", "w", "h"), ZONES[FIELD_CLASSES[n]], strict=True))))
    return F.array_compact(F.array(*(one(n) for n in ZONE_FIELDS)))


def panorama_fallback(n_images: Column, mean_overlap: Column) -> Column:
    """The record of a panorama that isn't made here: too few images, else no stitcher."""
    few = n_images < 2
    return F.struct(
        F.lit("fallback").alias("status"), F.lit(None).cast("string").alias("panorama_path"), F.when(few, 0.0).otherwise(F.coalesce(mean_overlap, F.lit(0.0))).alias("overlap_confidence"),
        F.when(few, "INSUFFICIENT_IMAGES").otherwise("NO_STITCHER").alias("fallback_reason"),
    )


def reading_plan(first_confidence: Column, first_score: Column, aspect: Column, passes: Column, has: Column, retries: int = 5) -> Column:
    """M9: the passes that a controller with early stops would run, over results that are known beforehand.

    passes: map of pass name to struct of text and confidence, with natural_90deg, natural_270deg, variant_crop,
    variant_a, variant_b, variant_d, variant_c, region; has: the names of pictures at hand. The first reading's
    confidence is 0 where it found no text. A retry is counted for a turned or cropped picture only if text came out.
    """
    start = F.struct(
        first_confidence.alias("best"), F.coalesce(F.char_length(F.try_element_at(passes, F.lit("natural"))["text"]), F.lit(0)).alias("length"), F.lit(0).alias("retries"),
        F.when(first_confidence > 0, 1).otherwise(0).alias("n"), F.array().cast("array<string>").alias("ran"), F.lit(False).alias("enhance"), F.lit(False).alias("enlarge"),
    )

    def step(s: Column, name: Column) -> Column:
        at_hand = F.array_contains(has, name)
        read = F.try_element_at(passes, name)
        left = s["retries"] < retries
        enhance = F.when(name == "variant_a", left & ((s["best"] < 0.70) | (s["length"] < 40))).otherwise(s["enhance"])
        enlarge = F.when(name == "variant_c", left & ((s["best"] < 0.45) | (s["length"] < 40))).otherwise(s["enlarge"])
        runs = at_hand & (
            F.when(name == "natural_90deg", (aspect >= 1.15) | (first_confidence < 0.65) | (first_score < 0.20))
            .when(name == "natural_270deg", (first_confidence < 0.40) & ((s["n"] <= 1) | (s["best"] < 0.50)))
            .when(name == "variant_crop", left)
            .when(name.isin("variant_a", "variant_b", "variant_d"), enhance & left)
            .when(name == "variant_c", enlarge & left)
            .otherwise((s["best"] < 0.25) & (s["length"] < 15))
        )
        text = F.coalesce(F.trim(read["text"]), F.lit(""))
        got = runs & (text != "")
        counts = F.when(name.isin("natural_90deg", "natural_270deg", "variant_crop"), got).when(name == "region", F.lit(False)).otherwise(runs)
        return F.struct(
            F.when(got, F.greatest(s["best"], read["confidence"])).otherwise(s["best"]).alias("best"), F.when(got, F.greatest(s["length"], F.char_length(text))).otherwise(s["length"]).alias("length"),
            (s["retries"] + F.when(counts, 1).otherwise(0)).alias("retries"), (s["n"] + F.when(got, 1).otherwise(0)).alias("n"),
            F.when(runs, F.array_append(s["ran"], name)).otherwise(s["ran"]).alias("ran"), enhance.alias("enhance"), enlarge.alias("enlarge"),
        )

    names = F.array(*map(F.lit, ("natural_90deg", "natural_270deg", "variant_crop", "variant_a", "variant_b", "variant_d", "variant_c", "region")))
    return F.aggregate(names, start, step, lambda s: F.struct(s["ran"].alias("ran"), s["retries"].alias("retries"), s["n"].alias("passes"), s["best"].alias("best_confidence")))
