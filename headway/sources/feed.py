"""Timetable feeds: CSV tables in a folder or a zip file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .zipped import ZippedFeed

COLUMNS = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["route_id", "service_id", "trip_id", "shape_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "transfers": ["from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}
OPTIONAL = {"transfers", "shapes"}


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """The known columns by header name, blank values and absent columns as NULL."""
    held = {c.strip().lstrip("﻿"): c for c in df.columns}
    return df.select(*[(F.nullif(F.trim(F.col(f"`{held[c]}`")), F.lit("")) if c in held else F.lit(None).cast("string")).alias(c) for c in COLUMNS[table]])


def read_table(spark: SparkSession, location: str, table: str) -> DataFrame:
    """All columns as trimmed text. An optional table that is absent is empty; a required one raises."""
    if location.endswith(".zip"):
        return _from_zip(spark, location, table)
    try:
        df = spark.read.csv(f"{location}/{table}.txt", header=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    except Exception as e:
        if table in OPTIONAL and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS[table]))
        raise
    return _shaped(df, table)


def _from_zip(spark: SparkSession, location: str, table: str) -> DataFrame:
    """A member of a zip file, at its top or in a folder; a task a member, see sources.zipped."""
    spark.dataSource.register(ZippedFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": location, "table": table, "columns": ",".join(COLUMNS[table]), "optional": str(table in OPTIONAL).lower()}
    return spark.read.format("zipped_feed").options(**options).load()


def write_folder(tables: dict[str, DataFrame], location: str) -> None:
    """Writes tables as a feed folder that read_table reads."""
    for name, rows in tables.items():
        rows.select([c for c in COLUMNS[name] if c in rows.columns]).write.csv(f"{location}/{name}.txt", header=True, escape='"')
