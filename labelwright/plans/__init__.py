"""Whole inspections and dashboards as plans."""
