"""A rail network and its telemetry, derived from the order tables and the event table.

An order is a trip, its lines in order of shipment are the stops, a supplier is a platform whose nation
is the station, times are whole days since 1992, and an order's priority is the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_DAYS, DWELL_DAYS, CAP = 180, 30, 600
ORDER = ("arr", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
WINDOW = 6 * 3600 * 1000
NOW_MS = 1_706_745_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, line, station, arr, dep, and the columns that order a trip)."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("station"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("line"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("arr"))
    rows = items.join(suppliers, "l_suppkey").join(orders, "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("trip_id"), "line", "station", "arr", (F.col("arr") + F.col("l_linenumber") % 4).alias("dep"), *ORDER[1:])


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of one region are within a walk of 30 with a margin of 20."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), "n_regionkey")
    m = n.withColumnRenamed("src", "dst")
    return n.join(m, "n_regionkey").where("src != dst").select("src", "dst", F.lit(30).alias("min_sec"), F.lit(20).alias("slack_sec"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, name, lines) of the visited stations."""
    lines = calls(spark, sf_dir).groupBy("station").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return lines.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station"), F.col("n_name").alias("name")), "station")


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The order tables as a timetable feed, all columns as text.

    Suppliers are platforms of their nation's station, each tenth with a parent that does not exist; a priority is a
    route and 5-LOW a bus; a day is a minute, some times are missing; each trip has a shape through its stations.
    """
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    spot = lambda base, c: [(F.col(c) + base).cast("double").cast("string").alias("stop_lat"), (F.col(c) * 0.25).cast("double").cast("string").alias("stop_lon")]
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    lost = F.col("s_suppkey") % 10 == 0
    platforms = supplier.select(text("S", "s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), *spot(100, "s_suppkey"), F.lit("0").alias("location_type"), F.when(lost, text("X", "s_nationkey")).otherwise(text("N", "s_nationkey")).alias("parent_station"))
    stations = nation.select(text("N", "n_nationkey").alias("stop_id"), F.col("n_name").alias("stop_name"), *spot(40, "n_nationkey"), F.lit("1").alias("location_type"), F.lit(None).cast("string").alias("parent_station"))
    orders = table(spark, sf_dir, "orders")
    line = F.col("o_orderpriority")
    routes = orders.select(line.alias("route_short_name")).distinct().select(F.concat(F.lit("R"), "route_short_name").alias("route_id"), "route_short_name", F.lit(None).cast("string").alias("route_long_name"), F.when(F.col("route_short_name") == "5-LOW", "3").otherwise("2").alias("route_type"))
    trips = orders.select(F.concat(F.lit("R"), line).alias("route_id"), F.col("o_orderkey").cast("string").alias("trip_id"), text("H", "o_orderkey").alias("shape_id"))
    rows = calls(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("trip_id").orderBy(*ORDER)))
    n = F.col("l_linenumber")
    digits = lambda x: F.when(F.length(x.cast("string")) < 2, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    clock = lambda t: F.concat_ws(":", F.floor(t / 3600).cast("string"), digits(F.floor(t / 60) % 60), digits(t % 60))
    stop_times = rows.select(
        F.col("trip_id").cast("string").alias("trip_id"), F.when((n % 5 != 0) & (n % 7 != 0), clock(F.col("arr").cast("long") * 60)).alias("arrival_time"), F.when((n % 3 != 0) & (n % 7 != 0), clock(F.col("arr").cast("long") * 60 + n % 4 * 30)).alias("departure_time"),
        text("S", "l_suppkey").alias("stop_id"), F.col("seq").cast("string").alias("stop_sequence"),
    )
    key, base = F.when(F.col("l_suppkey") % 10 == 0, F.col("l_suppkey")).otherwise(F.col("station")), F.when(F.col("l_suppkey") % 10 == 0, 100).otherwise(40)
    shapes = rows.select(text("H", "trip_id").alias("shape_id"), (key + base).cast("string").alias("shape_pt_lat"), (key * 0.25).cast("string").alias("shape_pt_lon"), F.col("seq").cast("string").alias("shape_pt_sequence"))
    walks = supplier.select(text("S", "s_suppkey").alias("from_stop_id"), F.concat(F.lit("N"), ((F.col("s_nationkey") + F.col("s_suppkey")) % 25).cast("string")).alias("to_stop_id"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") * 37 % 300).cast("string")).alias("min_transfer_time"), F.col("s_suppkey").alias("row_no"))
    return {"stops": platforms.unionByName(stations), "routes": routes, "trips": trips, "stop_times": stop_times, "shapes": shapes, "transfers": walks}


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a typed position that is late by its value."""
    return events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "trip_id", F.col("station").alias("station_id"), F.col("value").alias("delay_seconds"), F.lit("v1").alias("graph_version"), "event_time_ms")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"), (F.col("user_id") % 25).cast("int").alias("station"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("trip_id"), "event_type", "value")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, station, delay): every late event, its delay rounded half up."""
    late = events(spark, sf_dir).withColumn("delay", F.floor(F.col("value") + 0.5).cast("int")).where("delay > 0")
    return late.select(F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("source_id"), "station", "delay")


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, action, target, id, weight): every event as a directive on its station or a line, some of them not valid; one in 5,000 clears all."""
    e = events(spark, sf_dir)
    k = F.col("event_id")
    action = F.when(k % 5000 == 0, "clear").when(k % 97 == 0, "drop").otherwise("set")
    target = F.when(k % 89 == 0, "zone").when(k % 2 == 0, "station").otherwise("line")
    name = F.when(k % 2 == 0, (F.col("station") + F.when(k % 83 == 0, 100).otherwise(0)).cast("string")).when(k % 4 == 1, "1-URGENT").when(k % 4 == 3, "5-LOW")
    return e.select(k.alias("seq"), action.alias("action"), target.alias("target"), name.alias("id"), F.when(k % 79 == 0, -1.0).otherwise((k % 7) / 4.0).alias("weight"))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, body): position frames in three dialects by event_id, errors as broken text, dealt by trip as the partitions of a topic."""
    e = events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "trip_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    whole = F.floor("value").cast("long").cast("string")
    id_, trip, station = F.col("event_id").cast("string"), F.col("trip_id"), F.col("station").cast("string")
    flat = text('{"trip_id":"', trip, '","vehicle_id":"V', id_, '","lat":48.', station, ',"lon":2.5,"delay_seconds":', whole, ',"timestamp":', F.expr("event_time_ms div 1000").cast("string"), "}")
    nested = text('{"VehicleJourneyRef":"', trip, '","VehicleRef":"V', id_, '","Position":{"Latitude":48.', station, ',"Longitude":2.5},"Delay":"PT', F.expr("floor(value) div 60").cast("string"), "M", (F.floor("value") % 60).cast("string"), 'S","RecordedAtTime":"', F.date_format(F.timestamp_millis("event_time_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"}')
    stop = text('{"tripId":"', trip, '","vehicleId":"V', id_, '","stop_id":"IDFM:Q', station, '","delay":"', whole, '","ts":', F.expr("event_time_ms div 1000 * 1000").cast("string"), "}")
    body = F.when(F.col("event_type") == "error", F.concat(F.lit('{"trip_id":"BROKEN'), id_, F.lit('", not json'))).when(F.col("event_id") % 3 == 0, flat).when(F.col("event_id") % 3 == 1, nested).otherwise(stop)
    return e.select(F.lit("POSITION").alias("kind"), body.alias("body"))


def stop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("stop_id"), F.col("n_nationkey").cast("int").alias("station"))


def cascade_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('click', 'view')")
    return e.select("station", F.col("event_id").alias("seq"), "event_time_ms", F.col("event_id").cast("string").alias("event_id"), F.col("value").alias("delay"), (F.col("event_type") == "click").alias("missed"))


def prediction_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('purchase', 'signup')")
    return e.select("station", F.col("event_id").alias("seq"), "event_time_ms", F.col("event_id").cast("string").alias("event_id"), (F.col("value") / 500).alias("escalation"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("station", F.expr("event_time_ms div 1000").alias("ts"), F.col("value").alias("delay"), "trip_id")


def journey_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a customer: from its nation to the nation 7 further, on a day that its key decides."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("query_id"), F.col("c_nationkey").cast("int").alias("origin"), ((F.col("c_nationkey") + 7) % 25).cast("int").alias("dest"), (F.col("c_custkey") * 37 % 2400).cast("int").alias("departure_sec"))
