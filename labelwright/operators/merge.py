"""Multi-view merge (M1-M5, U1) and evidence boxes (JN9): one shuffle by product, partial aggregates on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.extract import FIELDS
from labelwright.functions.text import built, compared, let, once, strip, title
from labelwright.functions.vision import rank

#: Names of views without one.
MERGE_VIEWS = ["Front", "Back", "Left Side", "Right Side", "Top", "Bottom", "Close-up"]


def resolved_view(view: Column, at: Column) -> Column:
    """M5: the given name in title case, else the default's, else its number."""
    return F.coalesce(F.when(view != "", title(strip(view))), F.get(F.array(*map(F.lit, MERGE_VIEWS)), at), F.concat(F.lit("Angle "), (at + 1).cast("string")))


def evidence_box(snippet: Column, blocks: Column) -> Column:
    """JN9: y1, x1, y2, x2 of the first block that holds most of the snippet's words; null if none holds any.

    Words of three characters and more count, all words where there are none. blocks: array of text and box (points).
    """
    words = F.transform(F.regexp_extract_all(F.coalesce(snippet, F.lit("")), F.lit(r"(?U)(\w+)"), F.lit(1)), F.lower)
    chosen = let(words, lambda w: let(F.filter(w, lambda x: F.char_length(x) >= 3), lambda long: F.when(F.size(long) > 0, long).otherwise(w)))

    def best(w: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            text = F.lower(F.coalesce(b["text"], F.lit("")))
            n = F.size(F.filter(w, lambda x: F.contains(text, x)))
            xs, ys = F.transform(b["box"], lambda p: F.get(p, F.lit(0))), F.transform(b["box"], lambda p: F.get(p, F.lit(1)))
            box = F.array(F.array_min(ys), F.array_min(xs), F.array_max(ys), F.array_max(xs))
            return F.when((n > 0) & (F.size(b["box"]) >= 4), F.struct(n.alias("n"), (-i).alias("first"), box.alias("box")))

        return F.array_max(F.array_compact(F.transform(blocks, one)))["box"]

    return F.when(blocks.isNotNull(), let(chosen, best))


def merge_views(views: DataFrame, product: str = "product_id", fields: str = "fields", keep: tuple[str, ...] = (), also: tuple[Column, ...] = ()) -> DataFrame:
    """A row per product: a struct of the seven merged fields, and what was merged; and ``also``, further aggregates of
    the views' columns in ``keep``, so that nothing else has to group the views again.

    views: product, view_ord, view, image_path, confidence, fields (and blocks, if there are boxes). The best status
    wins, then the higher confidence, then the earlier view. Each merged field has its view, picture, box, confidence and
    its sources, the views where it was found or found with low confidence; if their values differ in letters and digits
    a discrepancy is noted. A null field is skipped; a null confidence counts as 0.9.
    """
    boxes = F.col("blocks") if "blocks" in views.columns else F.lit(None).cast("array<struct<text:string,box:array<array<int>>>>")
    at = F.col("view_ord").cast("int")
    v = views.withColumn("__view", built(("resolved_view",), lambda: resolved_view(F.col("view"), F.col("view_ord").cast("int")))).withColumn("__conf", F.coalesce("confidence", F.lit(0.9))).withColumn("__blocks", boxes)

    def placed(name: str) -> Column:
        f = F.col(fields)[name]
        own = [f[k].alias(k) for k in ("value", "status", "raw_snippet", "amount", "taxes_included", "phone", "email")]
        box = evidence_box(F.coalesce(F.nullif(f["raw_snippet"], F.lit("")), f["value"]), F.col("__blocks"))
        return F.when(f.isNotNull(), F.struct(*own, F.col("__view").alias("source_view"), F.coalesce("image_path", F.lit("")).alias("evidence_image_path"), box.alias("bounding_box"), F.round("__conf", 3).alias("confidence"), at.alias("image_index")))

    v = v.select(product, "view_ord", "__view", "__conf", *keep, *(built(("placed", fields, n), lambda n=n: placed(n).alias(n)) for n in FIELDS))

    def gathered(n: str) -> tuple[Column, Column]:
        order = F.when(F.col(n).isNotNull(), F.struct(rank(F.col(n)["status"]).alias("r"), F.col("__conf").alias("c"), (-F.col("view_ord")).alias("o")))
        source = F.when(F.col(n)["status"].isin("found", "low_confidence"), F.struct(F.col("view_ord").alias("o"), F.struct(*(F.col(n)[a].alias(b) for a, b in (("source_view", "view"), ("image_index", "image_index"), ("evidence_image_path", "image_path"), ("value", "value"), ("status", "status"), ("confidence", "confidence"), ("bounding_box", "bounding_box")))).alias("s")))
        return F.max_by(n, order).alias(n), F.sort_array(F.collect_list(source)).alias(f"__{n}")

    per = [c for n in FIELDS for c in built(("gathered", n), lambda n=n: gathered(n))]
    grouped = v.groupBy(product).agg(F.count(F.lit(1)).alias("images_processed"), F.sort_array(F.collect_list(F.struct(F.col("view_ord").alias("o"), F.col("__view").alias("v")))).alias("__views"), *per, *also)

    def finished(n: str) -> Column:
        sources = F.transform(F.col(f"__{n}"), lambda x: x["s"])
        differ = F.size(F.array_distinct(F.transform(sources, lambda s: compared(s["value"])))) > 1
        note = F.concat(F.lit("Values differ between views: "), F.array_join(F.transform(sources, lambda s: F.concat_ws(": ", s["view"], s["value"])), ", "))
        kept = [F.col(n)[k].alias(k) for k in ("value", "status", "raw_snippet", "amount", "taxes_included", "phone", "email", "source_view", "evidence_image_path", "bounding_box", "confidence")]
        return F.struct(*kept, sources.alias("sources"), F.coalesce(differ, F.lit(False)).alias("discrepancy_detected"), F.when(differ, note).alias("discrepancy_note")).alias(n)

    return grouped.select(
        product,
        F.struct(*(built(("finished", n), lambda n=n: finished(n)) for n in FIELDS)).alias("fields"),
        F.struct("images_processed", (F.col("images_processed") > 1).alias("merged"), F.transform("__views", lambda x: x["v"]).alias("views")).alias("merge_metadata"),
        *(c for c in grouped.columns if c not in (product, "images_processed", "__views", *FIELDS, *(f"__{n}" for n in FIELDS))),
    )


def field_rows(merged: DataFrame, product: str = "product_id") -> DataFrame:
    """A row per product and field of a merge."""
    rows = F.array(*(F.struct(F.lit(n).alias("field"), F.col("fields")[n].alias("f")) for n in FIELDS))
    return merged.select(product, F.inline(once(rows))).select(product, "field", "f.*")


def texts_in_order(text: str = "text") -> Column:
    """The views' texts as an aggregate: order, name and text of each."""
    return F.sort_array(F.collect_list(F.struct("view_ord", "view", F.col(text).alias("t"))))


def marked_text(texts: Column, marker: str = "\n\n--- {} ---\n\n") -> Column:
    """A10: such texts as one, with a marker that names the next view between them."""
    head, tail = marker.split("{}")
    parts = F.transform(texts, lambda x, i: F.concat(F.when(i == 0, "").otherwise(F.concat(F.lit(head), x["view"], F.lit(tail))), F.coalesce(x["t"], F.lit(""))))
    return F.array_join(parts, "")


def joined_text(views: DataFrame, product: str = "product_id", text: str = "text", marker: str = "\n\n--- {} ---\n\n") -> DataFrame:
    """A10: a row per product with its views' texts as one."""
    rows = views.groupBy(product).agg(texts_in_order(text).alias("v"))
    return rows.select(product, marked_text(F.col("v"), marker).alias("combined_text"), F.size("v").cast("long").alias("n_views"))


def view_summary(views: DataFrame, product: str = "product_id") -> DataFrame:
    """The best confidence and its view, and the first picture that has a path."""
    first = F.struct(F.col("view_ord"))
    return views.groupBy(product).agg(
        F.max("confidence").alias("best_confidence"),
        F.max_by("view", F.struct("confidence", -F.col("view_ord"))).alias("best_view"),
        F.min_by("image_path", F.when(F.col("image_path") != "", first)).alias("first_image"),
    )


def gate_views(views: DataFrame, acceptable: str = "is_acceptable", product: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """acceptable views, and the products that have none and are rejected whole."""
    good = views.filter(F.coalesce(F.col(acceptable), F.lit(False)))
    none = views.groupBy(product).agg(F.count_if(F.col(acceptable)).alias("n")).filter("n = 0").select(product)
    return good, none
