"""Operators over DataFrames: merging views, reading consensus, frames, boxes, dashboards, reports, training sets, images."""
