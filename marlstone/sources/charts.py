"""Charts as specifications with their data: JSON that any Vega-Lite viewer draws. A chart's rows are a report, not a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import small_rows

#: Points that a chart can hold; more are an error.
MOST_POINTS = 10_000


def lines(rows: DataFrame, title: str, x: str, y: str) -> dict:
    """A line per series over rows series, x, y (null points are left out of the line)."""
    points = sorted(({"series": r.series, "x": r.x, "y": r.y} for r in small_rows(rows.select("series", "x", "y"), MOST_POINTS)), key=lambda p: (str(p["series"]), p["x"] is None, p["x"]))
    return {
        "$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title, "data": {"values": points}, "mark": {"type": "line", "point": True},
        "encoding": {
            "x": {"field": "x", "type": "quantitative", "title": x}, "y": {"field": "y", "type": "quantitative", "title": y}, "color": {"field": "series", "type": "nominal"},
        },
    }


def write_lines(rows: DataFrame, path: str, title: str, x: str, y: str) -> None:
    """The specification as one text file in a folder."""
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(lines(rows, title, x, y)),)], "value string").coalesce(1).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """series, x, y of a written chart."""
    kind = "struct<data:struct<values:array<struct<series:string,x:double,y:double>>>>"
    return spark.read.text(path).select(F.inline(F.from_json("value", kind)["data"]["values"]))
