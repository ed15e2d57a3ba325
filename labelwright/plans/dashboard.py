"""The dashboard of a principal as a set of small DataFrames over scoped scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelwright.operators import dashboards as d


def dashboard(inspections: DataFrame, violations: DataFrame, rules: DataFrame, users: DataFrame, who: d.Principal, inspector_id: int | None = None) -> dict[str, DataFrame]:
    """totals, breakdown and trend; progress for admins alone."""
    own = d.scope(inspections, who, inspector_id)
    found = violations if d.target(who, inspector_id) is None else d.of_inspections(violations, own)
    out = {"totals": d.totals(own), "breakdown": d.breakdown(found, rules), "trend": d.trend(own)}
    if who.role == "admin":
        out["progress"] = d.progress(inspections, users)
    return out
