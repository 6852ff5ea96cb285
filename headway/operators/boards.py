"""Departure boards and the messages that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import small

AHEAD_S, PER_LINE, ZONE = 6 * 3600, 5, "Europe/Paris"


def departures(trip_times: DataFrame, kinds: DataFrame, now_sec: int, ahead: int = AHEAD_S, per_line: int = PER_LINE) -> DataFrame:
    """(station, line, place, dep_sec, terminus): each line's next departures, without termini; same second and terminus count once.

    Patterns grow with the trips, so their ends are joined without a broadcast hint.
    """
    last = kinds.select("pattern_id", "line", (F.col("n_stops") - 1).alias("last"))
    ends = trip_times.where("trip_no = 0").join(last, "pattern_id").where("pos = last").select("pattern_id", "line", "last", F.col("station").alias("terminus"))
    rows = trip_times.where((F.col("dep_sec") >= now_sec) & (F.col("dep_sec") < now_sec + ahead)).join(ends, "pattern_id").where("pos < last")
    rows = rows.select("station", "line", "dep_sec", "terminus").distinct()
    place = F.row_number().over(Window.partitionBy("station", "line").orderBy("dep_sec", "terminus"))
    return rows.withColumn("place", place).where(F.col("place") <= per_line).select("station", "line", "place", "dep_sec", "terminus")


def display_messages(board: DataFrame, nodes: DataFrame, service_date: str, zone: str = ZONE, valid_s: int = 60, shift: Column | None = None) -> DataFrame:
    """One message a departure, with times as epoch ms of the service date's local midnight plus the second of day, and a sequence number."""
    midnight = F.unix_millis(F.to_utc_timestamp(F.lit(f"{service_date} 00:00:00"), zone))
    names = nodes.select(F.col("station").alias("terminus"), F.col("name").alias("headline"))
    rows = board.join(small(names), "terminus", "left")
    dep_ms = midnight + F.col("dep_sec").cast("long") * 1000
    order = Window.partitionBy("station").orderBy("line", "dep_sec", "terminus")
    return rows.select(
        F.concat_ws("/", F.col("station"), F.col("line"), F.col("dep_sec")).alias("message_id"), F.concat_ws("/", F.lit("piv/idf"), F.col("station"), F.col("line")).alias("subject"),
        "headline", F.format_string("%02d:%02d", F.expr("dep_sec div 3600"), F.expr("dep_sec div 60 % 60")).alias("body"),
        dep_ms.alias("valid_to_ms"), (dep_ms - valid_s * 1000).alias("valid_from_ms"), F.row_number().over(order).cast("long").alias("display_seq"),
    )
