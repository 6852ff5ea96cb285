"""Column expressions that read the many dialects of rail telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field aliases in the order they are tried.
ALIASES = {
    "trip_id": ["trip_id", "tripId", "tripRef", "DatedVehicleJourneyRef", "VehicleJourneyRef"],
    "vehicle_id": ["vehicle_id", "vehicleId", "vehicleRef", "VehicleRef"],
    "line_id": ["line_id", "lineId", "lineRef", "LineRef", "route_id", "routeId"],
    "latitude": ["latitude", "lat", "Latitude"],
    "longitude": ["longitude", "lon", "lng", "Longitude"],
    "delay": ["delay_seconds", "delaySeconds", "delay", "Delay"],
    "bearing": ["bearing", "heading", "Bearing"],
    "speed_kmh": ["speed_kmh", "speed", "Velocity"],
    "station": ["station_id", "stationId", "stop_id", "stopId", "StopPointRef", "MonitoringRef"],
    "next_stop": ["next_stop_id", "nextStopId", "nextStopRef"],
    "event_time": ["event_time_ms", "timestamp", "ts", "RecordedAtTime"],
    "source_feed": ["source_feed", "source", "producer"],
    "graph_version": ["graph_version", "graphVersion"],
    "block_id": ["block_id", "blockId", "trackCircuitId", "tcId"],
    "block_state": ["block_state", "blockState", "occupancy"],
    "interlocking": ["interlocking_status", "interlockingStatus", "interlocking"],
    "signal": ["owning_signal_id", "signalId", "signalRef"],
    "category": ["category", "incidentType", "type"],
    "severity": ["severity", "Severity", "level"],
    "description": ["description", "summary", "Summary"],
    "clearance": ["estimated_clearance_ms", "estimatedClearance", "expectedEndTime", "ValidUntilTime"],
    "start": ["start_time_ms", "startTime", "CreationTime"],
    "lines": ["impacted_line_ids", "impactedLines", "AffectsLines", "lines"],
    "stations": ["impacted_station_ids", "impactedStations", "stations"],
}
PLACES = ["position", "Position", "Location", "VehicleLocation"]

# Enum synonyms, upper-cased.
ENUMS = {
    "block_state": {"CLEAR": ["CLEAR", "FREE", "UNOCCUPIED"], "OCCUPIED": ["OCCUPIED", "BUSY"], "RESERVED": ["RESERVED", "LOCKED"], "FAILED": ["FAILED", "FAULT"]},
    "interlocking": {"NORMAL": ["NORMAL", "OK"], "DEGRADED": ["DEGRADED"], "FAILURE": ["FAILURE", "FAILED"]},
    "category": {"INFRASTRUCTURE": ["INFRASTRUCTURE", "TRACK", "SIGNALLING"], "ROLLING_STOCK": ["ROLLING_STOCK", "TRAIN"], "EXTERNAL": ["EXTERNAL", "WEATHER", "INTRUSION"], "PASSENGER": ["PASSENGER", "MEDICAL"], "OPERATIONAL": ["OPERATIONAL", "STAFFING"]},
    "severity": {"MINOR": ["MINOR", "LOW"], "MAJOR": ["MAJOR", "HIGH"], "CRITICAL": ["CRITICAL", "SEVERE"]},
}
SECONDS_BELOW = 100_000_000_000


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that the optimiser does not compute again for each use: a generator puts them out."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(frames: DataFrame) -> DataFrame:
    """Adds v, the body as a variant (NULL if it is no JSON); texts, the usable scalars by name; placed, those within
    a place as `place.name`; and numbers, the station fields that are JSON numbers.

    A body is read once, however many of its fields are used.
    """
    fields = lambda c: F.coalesce(F.try_variant_get(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = computed_once(frames, v=F.expr("try_parse_json(body)"))
    rows = computed_once(rows, _top=fields(F.col("v")))
    within = lambda p: F.transform_keys(usable(fields(F.try_element_at("_top", F.lit(p)))), lambda k, _: F.concat(F.lit(p + "."), k))
    number = F.map_filter("_top", lambda k, x: k.isin(ALIASES["station"]) & F.schema_of_variant(x).rlike("BIGINT|DECIMAL|DOUBLE"))
    return computed_once(rows, texts=usable(F.col("_top")), placed=F.map_concat(*map(within, PLACES)), numbers=F.map_keys(number)).drop("_top")


def usable(fields: Column) -> Column:
    """The texts of a map's scalars, trimmed; blank ones, objects and arrays are left out."""
    texts = F.transform_values(fields, lambda _, x: F.trim(F.try_variant_get(x, "$", "string")))
    return F.map_filter(texts, lambda _, t: (t != "") & ~t.startswith("{") & ~t.startswith("["))


def field(name: str | Column) -> Column:
    """Text of a scalar field of a parsed frame; NULL if absent, blank, or an object or array."""
    return F.try_element_at("texts", F.lit(name))


def first_good(names: list[str], read: Callable[[Column], Column], of: str = "texts") -> Column:
    """The first value that read makes of a usable field of these names and that is not NULL.

    One short expression over the names, not one for each: the generated code stays small.
    """
    there = F.filter(F.array(*map(F.lit, names)), lambda a: F.map_contains_key(of, a))
    return F.try_element_at(F.array_compact(F.transform(there, read)), F.lit(1))


def first_of(name: str) -> Column:
    """The first alias of a field with a usable value."""
    return first_good(ALIASES[name], field)


def seconds_of(text: Column) -> Column:
    """A number, numeric text or ISO-8601 duration in seconds; NULL if neither."""
    shape = r"^(-?)P(?:(\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+(?:\.\d+)?)S)?)?$"
    part = lambda k: F.coalesce(F.regexp_extract(text, shape, k).try_cast("double"), F.lit(0.0))
    total = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return F.coalesce(text.try_cast("double"), F.when(text.rlike(shape) & text.rlike(r"\d"), F.when(F.regexp_extract(text, shape, 1) == "-", -total).otherwise(total)))


def delay_seconds() -> Column:
    return F.coalesce(first_good(ALIASES["delay"], lambda a: seconds_of(field(a))), F.lit(0.0))


def epoch_ms(text: Column) -> Column:
    """Epoch seconds or milliseconds, or ISO-8601 text, as milliseconds."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number < SECONDS_BELOW, number * 1000).otherwise(number).cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def event_time_ms(ingest_time_ms: Column, name: str = "event_time") -> Column:
    return F.coalesce(first_time_ms(name), ingest_time_ms)


def first_time_ms(name: str) -> Column:
    return first_good(ALIASES[name], lambda a: epoch_ms(field(a)))


def first_number(name: str) -> Column:
    return first_good(ALIASES[name], lambda a: field(a).try_cast("double"))


def enum_of(name: str, text: Column) -> Column:
    """The enum value whose synonym the text is, else UNSPECIFIED."""
    upper = F.upper(text)
    return F.coalesce(*[F.when(upper.isin(words), F.lit(value)) for value, words in ENUMS[name].items()], F.lit("UNSPECIFIED"))


def clock_seconds(text: Column) -> Column:
    """H:MM[:SS] as second of day, past 24 h too; NULL if malformed."""
    number = lambda parts, k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    whole = lambda parts: number(parts, 1) * 3600 + number(parts, 2) * 60 + F.when(F.size(parts) > 2, number(parts, 3)).otherwise(F.lit(0))
    # a lambda's argument is split once, however often it is used
    return F.get(F.transform(F.array(F.split(F.trim(text), ":")), lambda parts: F.when(F.size(parts).between(2, 3), whole(parts))), 0)


def content_id(*columns: str) -> Column:
    """An idempotency key from the contents: the same on every retry."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")
