"""Raw telemetry frames to typed events, with a dead-letter output; and their sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import ALIASES, PLACES, computed_once, content_id, delay_seconds, enum_of, event_time_ms, field, first_good, first_number, first_of, first_time_ms, parsed
from ..functions.tables import lookup

KINDS = ("POSITION", "SIGNALLING", "INCIDENT")


def read_frames(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Frames (kind, body) of text files, one JSON object or array of objects a line; batches are unnested."""
    lines = (spark.readStream if stream else spark.read).format("text").load(path)
    return unnested(lines.select(F.lit(kind).alias("kind"), F.col("value").alias("body")))


def unnested(frames: DataFrame) -> DataFrame:
    """Array bodies become one frame an element; other bodies, broken ones too, stay as they are."""
    batch = F.when(F.ltrim("body").startswith("["), F.from_json("body", "array<variant>"))
    each = frames.select("*", F.explode_outer(F.coalesce(batch, F.array(F.lit(None).cast("variant")))).alias("_v"))
    return each.withColumn("body", F.coalesce(F.to_json("_v"), "body")).drop("_v")


def resolve_stations(frames: DataFrame, stop_map: DataFrame, name: str = "station") -> DataFrame:
    """Adds `<name>_id` to parsed frames: the first alias that resolves. A JSON number is the index; text is looked up whole,
    then by what follows its last colon, then taken as an index if all digits.

    stop_map(stop_id, station) is one value that each frame looks into, and only joined if it is too large for that.
    """
    stops = stop_map.groupBy("stop_id").agg(F.min("station").alias("station"))
    frames, station_of, ids = computed_once(frames, _named=_named(name)), lookup(stops, "stop_id", "station"), []
    for k in range(len(ALIASES[name])):
        found = F.get("_named", k)
        if station_of:
            whole, part = station_of(found["text"]), station_of(found["tail"])
        else:
            for c in ("text", "tail"):
                frames = frames.join(stops.select(F.col("stop_id").alias("_s"), F.col("station").alias(f"_{c}{k}")), found[c] == F.col("_s"), "left").drop("_s")
            whole, part = F.col(f"_text{k}"), F.col(f"_tail{k}")
        ids.append(F.coalesce(found["number"], whole, part, found["digits"]))
    return frames.withColumn(f"{name}_id", F.coalesce(*ids)).drop("_named", *[f"_{c}{k}" for c in ("text", "tail") for k in range(len(ids))])


def _named(name: str) -> Column:
    """The usable station fields in order: as an index if it is a number, else as text, by its last part, and as digits."""

    def read(alias: Column) -> Column:
        text, number = field(alias), F.array_contains("numbers", alias)
        tail = F.substring_index(text, ":", -1)
        index = F.when(number, F.floor(text.try_cast("double") + 0.5).cast("int"))
        digits = F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("int"))
        return F.struct(index.alias("number"), F.when(~number, text).alias("text"), F.when(~number & (tail != "") & (tail != text), tail).alias("tail"), F.when(~number, digits).alias("digits"))

    return F.transform(F.filter(F.array(*map(F.lit, ALIASES[name])), lambda a: F.map_contains_key("texts", a)), read)


def _place(name: str) -> Column:
    inside = first_good([f"{p}.{a}" for p in PLACES for a in ALIASES[name]], lambda a: F.try_element_at("placed", a).try_cast("double"), "placed")
    return F.coalesce(inside, first_number(name))


def _common(ingest: Column) -> list[Column]:
    return [first_of("graph_version").alias("graph_version"), event_time_ms(ingest).alias("event_time_ms"), ingest.alias("ingest_time_ms")]


def normalize_positions(frames: DataFrame, stop_map: DataFrame, ingest_time_ms: int) -> DataFrame:
    """Position events and a reason column; reason is NULL for accepted rows. An unresolved station stays NULL."""
    ingest = F.lit(ingest_time_ms).cast("long")
    rows = resolve_stations(parsed(frames), stop_map)
    out = rows.select(
        "kind", "body", "v",
        first_of("trip_id").alias("trip_id"), first_of("vehicle_id").alias("vehicle_id"), first_of("line_id").alias("line_id"),
        _place("latitude").alias("latitude"), _place("longitude").alias("longitude"),
        first_number("bearing").alias("bearing"), first_number("speed_kmh").alias("speed_kmh"),
        "station_id", F.floor(first_of("next_stop").try_cast("double") + 0.5).cast("int").alias("next_stop_id"),
        delay_seconds().alias("delay_seconds"), F.coalesce(first_of("source_feed"), F.lit("UNKNOWN")).alias("source_feed"), *_common(ingest),
    )
    reason = F.when(F.col("v").isNull(), "malformed json").when(F.col("trip_id").isNull(), "missing trip id").when((F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("station_id").isNull(), "no place")
    return out.withColumn("reason", reason).withColumn("event_id", content_id("kind", "body")).drop("v")


def normalize_signalling(frames: DataFrame, stop_map: DataFrame, ingest_time_ms: int) -> DataFrame:
    ingest = F.lit(ingest_time_ms).cast("long")
    rows = resolve_stations(parsed(frames), stop_map)
    out = rows.select(
        "kind", "body", "v", first_of("trip_id").alias("trip_id"), first_of("block_id").alias("block_id"), "station_id",
        enum_of("block_state", first_of("block_state")).alias("block_state"), enum_of("interlocking", first_of("interlocking")).alias("interlocking_status"),
        first_of("signal").alias("owning_signal_id"), *_common(ingest),
    )
    reason = F.when(F.col("v").isNull(), "malformed json").when(F.col("trip_id").isNull(), "missing trip id").when(F.col("block_id").isNull(), "missing block id")
    return out.withColumn("reason", reason).withColumn("event_id", content_id("kind", "body")).drop("v")


def _listed(name: str) -> Column:
    """The first alias that holds an array of scalars or one scalar, as an array of texts."""
    one = lambda a: F.coalesce(F.expr(f"try_variant_get(v, '$.{a}', 'array<string>')"), F.when(field(a).isNotNull(), F.array(field(a))))
    return F.coalesce(*[one(a) for a in ALIASES[name]], F.array().cast("array<string>"))


def normalize_incidents(frames: DataFrame, ingest_time_ms: int) -> DataFrame:
    ingest = F.lit(ingest_time_ms).cast("long")
    rows = parsed(frames)
    clearance = first_time_ms("clearance")
    out = rows.select(
        "kind", "body", "v", first_of("trip_id").alias("trip_id"),
        enum_of("category", first_of("category")).alias("category"), enum_of("severity", first_of("severity")).alias("severity"),
        _listed("lines").alias("impacted_line_ids"),
        F.filter(F.transform(_listed("stations"), lambda s: s.try_cast("int")), lambda s: s.isNotNull()).alias("impacted_station_ids"),
        first_of("description").alias("description"), event_time_ms(ingest, "start").alias("start_time_ms"),
        clearance.alias("estimated_clearance_ms"), clearance.isNotNull().alias("clearance_estimate_known"), *_common(ingest),
    )
    out = out.withColumn("key", F.coalesce("trip_id", F.try_element_at("impacted_line_ids", F.lit(1))))
    reason = F.when(F.col("v").isNull(), "malformed json").when(F.col("key").isNull(), "no trip or line")
    return out.withColumn("reason", reason).withColumn("event_id", content_id("kind", "body")).drop("v")


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason is null").drop("reason", "body")


def dead_letters(normalized: DataFrame, ingest_time_ms: int) -> DataFrame:
    """(kind, body, reason, ingest_ts) of rejected rows, body verbatim."""
    return normalized.where("reason is not null").select("kind", "body", "reason", F.lit(ingest_time_ms).cast("long").alias("ingest_ts"))


def by_trip(events: DataFrame, partitions: int = 22) -> DataFrame:
    """One trip in one partition, in order of time; rows without a trip are spread by their event."""
    return events.repartition(partitions, F.coalesce("trip_id", "event_id")).sortWithinPartitions("trip_id", "event_time_ms")


def realtime_frames(entities: DataFrame, source: str) -> DataFrame:
    """Position frames of decoded real-time entities.

    A trip update gives its first stop update with a departure delay, else its first with an arrival
    delay; a vehicle its place. Entities without trip id, stop id or place give nothing.
    """
    updates = F.col("trip_update.stop_time_updates")
    departing = F.try_element_at(F.filter(updates, lambda u: u["departure_delay"].isNotNull()), F.lit(1))
    arriving = F.try_element_at(F.filter(updates, lambda u: u["arrival_delay"].isNotNull()), F.lit(1))
    chosen = F.coalesce(departing, arriving)
    delay = F.coalesce(departing["departure_delay"], arriving["arrival_delay"]).cast("double")
    when = lambda c: (F.coalesce(F.col(f"{c}.timestamp"), F.col("header_ts")) * 1000).cast("long")
    null = F.lit(None).cast("double")
    trips = entities.where("trip_update.trip_id is not null").select(F.col("trip_update.trip_id").alias("trip_id"), F.col("trip_update.route_id").alias("line_id"), chosen["stop_id"].alias("stop_id"), delay.alias("delay_seconds"), null.alias("latitude"), null.alias("longitude"), null.alias("bearing"), null.alias("speed_kmh"), when("trip_update").alias("event_time_ms")).where("stop_id is not null")
    vehicles = entities.where("vehicle.trip_id is not null and vehicle.lat is not null and vehicle.lon is not null")
    vehicles = vehicles.select(F.col("vehicle.trip_id").alias("trip_id"), F.col("vehicle.route_id").alias("line_id"), F.col("vehicle.stop_id").alias("stop_id"), null.alias("delay_seconds"), F.col("vehicle.lat").alias("latitude"), F.col("vehicle.lon").alias("longitude"), F.col("vehicle.bearing").cast("double").alias("bearing"), (F.col("vehicle.speed").cast("double") * 3.6).alias("speed_kmh"), when("vehicle").alias("event_time_ms"))
    return trips.unionByName(vehicles).withColumn("source_feed", F.lit(source))


def write_routed(normalized: DataFrame, path: str, ingest_time_ms: int, batch: str) -> None:
    """Sinks of one batch: a table for each kind of accepted rows, and one of dead letters.

    Each batch has folders of its own, so a retry of the same batch overwrites what it wrote before.
    """
    accepted(normalized).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/events/batch={batch}")
    dead_letters(normalized, ingest_time_ms).write.mode("overwrite").parquet(f"{path}/dead_letters/batch={batch}")
