"""Five made-up labels for demonstrations, seeded for each user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_A = "Pkd. Date: 03/2025\n    Marketed by: Hill Oats Foods Pvt Ltd, Plot 4\n    MRP Rs. 120.00 (incl. of all taxes)\n    Net Quantity: 500 gm\n    Customer Care: 1800-111-2222, help@hilloats.example\n    FSSAI Lic No: 10012345678901\n    Country of Origin: India"
_B = "Pkd. Date: 04/2025\n    Marketed by: Plain Biscuit Company, Plot 9\n    MRP Rs. 45.00\n    Net Quantity: 200 gm"
_C = "Pkd. Date: 05/2025\n    Marketed by: Clear Soap Works, Plot 2\n    MRP Rs. 60.00 (incl. of all taxes)\n    Net Quantity: 125 gm\n    Customer Care: 1800-333-4444, care@clearsoap.example\n    Country of Origin: India"
_D = "Pkd. Date: 06/2025\n    Marketed by: River Rice Mills, Plot 11\n    MRP Rs. 99.00 (incl. of all taxes)\n    Net Quantity: 1 kg\n    Customer Care: 1800-555-6666, rice@river.example\n    FSSAI Lic No: 1OO12345678902\n    Country of Origin: India"
_E = "Pkd. Date: 07/2025\n    Marketed by: Cool Gel Traders, Plot 1\n    Best used cold"

ROWS = [("Rolled oats", "Hill", _A, True), ("Biscuits", "Plain", _B, True), ("Soap", "Clear", _C, False), ("Rice", "River", _D, True), ("Gel", "Cool", _E, True)]


def seed(users: DataFrame) -> DataFrame:
    """inspector_id, product_name, brand, text, is_food: the five labels of each user (id)."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("product_name", "brand", "text", "is_food"), r, strict=True))) for r in ROWS))
    return users.select(F.col("id").alias("inspector_id"), F.inline(rows))
