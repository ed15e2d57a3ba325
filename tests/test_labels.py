from pyspark.sql import functions as F

from labelwright.functions import extract, profile, rules, text, vision
from labelwright.operators import merge
from labelwright.plans.inspection import inspect

GOOD = "Pkd. Date: 08/2024\n    Marketed by: Acme Foods Pvt Ltd, Plot 7\n    MRP Rs. 50.00 (incl. of all taxes)\n    Net Quantity: 250 gm\n    Customer Care: 1800-123-4567, care@acme.example\n    FSSAI Lic No: 10012345678901\n    Country of Origin: India"


def fields_of(spark, texts, only=extract.FIELDS):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in extract.extract_fields(rows, only=only).orderBy("i").select("fields").collect()]


def test_extraction_edges(spark):
    texts = [
        GOOD,
        "FSSAI Lic No: 10012345678901\nCountry of Origin: Japan",
        "Net Wt: 250gm",
        "Net Wt: 250 gm",
        "packed in a box of 5 kg",
        "MRP Rs. 50.00",
        "Manufactured by: Acme Industries\nPkd 12/2025",
        "Mfg Date: 12/2025",
        None,
        "",
    ]
    f = fields_of(spark, texts)
    assert [f[0][n]["status"] for n in extract.FIELDS] == ["found"] * 7
    assert f[0]["mrp"]["value"] == "₹ 50.00 (incl. of all taxes)" and f[0]["mrp"]["amount"] == 50.0
    assert f[1]["fssai_license"]["status"] == "uncertain" and f[1]["fssai_license"]["value"] == text.UNCERTAIN
    assert f[2]["net_quantity"]["status"] == "not_found" and f[3]["net_quantity"]["value"] == "250 g"
    assert f[4]["net_quantity"]["status"] == "uncertain"
    assert (f[5]["mrp"]["status"], f[5]["mrp"]["taxes_included"]) == ("low_confidence", False)
    assert f[6]["manufacture_date"]["status"] == "low_confidence"
    assert (f[7]["manufacturer_details"]["status"], f[7]["manufacturer_details"]["value"]) == ("found", "Date: 12/2025")
    assert all(f[i][n]["status"] == "not_found" for i in (8, 9) for n in extract.FIELDS)


def test_rules(spark):
    rows = spark.createDataFrame([(0, GOOD, True), (1, "MRP Rs. 50.00\nNet Quantity: 5 kg", True), (2, GOOD.replace("    FSSAI Lic No: 10012345678901\n", ""), False)], "i int, text string, food boolean")
    out = rules.evaluate(extract.extract_fields(rows), is_food=F.col("food")).orderBy("i").collect()
    assert [(r["compliance_score"], r["overall_status"]) for r in out] == [(100.0, "Compliant"), (14.3, "Non-Compliant"), (100.0, "Compliant")]
    assert [x["reason"] for x in out[1]["results"]][2] == "taxes not declared"


def test_merge(spark):
    views = [(1, 0, "front", "a.png", 0.9, "MRP Rs. 50.00 (incl. of all taxes)"), (1, 1, None, "b.png", 0.9, "MRP Rs. 60.00 (incl. of all taxes)\nNet Quantity: 5 kg"), (2, 0, "", None, None, GOOD), (1, 8, None, None, 0.1, None)]
    rows = spark.createDataFrame(views, "product_id long, view_ord int, view string, image_path string, confidence double, text string")
    merged = {r["product_id"]: r for r in merge.merge_views(extract.extract_fields(rows)).collect()}
    price = merged[1]["fields"]["mrp"]
    assert price["source_view"] == "Front" and price["discrepancy_detected"] and "Back" in price["discrepancy_note"] and len(price["sources"]) == 2
    assert merged[1]["fields"]["net_quantity"]["source_view"] == "Back" and merged[1]["merge_metadata"]["views"] == ["Front", "Back", "Angle 9"]
    assert not merged[2]["merge_metadata"]["merged"] and merged[2]["fields"]["mrp"]["confidence"] == 0.9
    whole = inspect(rows.withColumn("is_food", F.lit(True)))
    assert whole.findings.count() == 14 and whole.profiles.filter("combined_text LIKE '%--- Angle%' OR combined_text LIKE '%Acme%'").count() >= 1
    assert {r["product_id"]: r["compliance_score"] for r in whole.inspections.select("product_id", "compliance_score").collect()}[2] == 100.0


def test_profile(spark):
    texts = [
        "Ingredients: Sugar, Flour (a, b), Colour (INS 1102), INS 500(ii), Citric Acid.\nNutritional info per 100 g Energy 5 kcal",
        "Contains Wheat\nand more text on another line",
        "Almonds only",
        "sugar and salt",
        "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = profile.profile(rows).orderBy("i").collect()
    assert [a["identifier"] for a in out[0]["additives"]] == ["INS 102", "INS 500(ii)", "INS 330", "INS 500(ii)"][:3]
    assert out[0]["nutrition"]["detected"] and out[0]["ingredients"]["found"]
    assert [(a["allergen"], a["is_explicit"]) for a in out[1]["allergens"]] == [("Wheat", False)]
    assert out[2]["allergens"] == [] and profile.profile(rows, strict=True).filter("i = 2").first()["allergens"][0]["allergen"] == "Tree Nuts"
    assert [x["name"] for x in out[3]["ingredients"]["items"]] == ["Sugar", "Salt"]
    assert out[4]["evidence_confidence"] == 0.6


def test_vision(spark):
    answers = ['```json\n{"net_quantity_declared": "250g", "fssai_license_14_digit": "1001234567890", "country_of_origin": "null"}\n```', "{broken", None]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string").withColumn("f", vision.adapt(F.from_json(vision.fenced_json(F.col("a")), vision.ANSWER)))
    out = [r["f"] for r in rows.orderBy("i").collect()]
    assert (out[0]["net_quantity"]["value"], out[0]["fssai_license"]["status"], out[0]["country_of_origin"]["status"]) == ("250 g", "low_confidence", "not_found")
    assert all(f[n]["status"] == "not_found" for f in out[1:] for n in extract.FIELDS)
