"""From a timetable to a station network with recovery margins, and views of the network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import clock_seconds, round_half_up
from ..functions.tables import small

RUN_LIMIT, DWELL_LIMIT = 6 * 3600, 3600
RUN_CAP, DWELL_CAP, TRANSFER_SLACK, TRANSFER_MIN = 600, 180, 120, 120
RAIL = ("2",)


def kept_routes(routes: DataFrame, types=RAIL, lines: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, line) of routes of the types whose short name is in the list (an empty list keeps all)."""
    short = F.upper(F.trim("route_short_name"))
    kept = routes.where(F.col("route_type").isin(*types))
    if lines:
        kept = kept.where(short.isin(*[x.strip().upper() for x in lines]))
    return kept.select("route_id", F.coalesce("route_short_name", "route_long_name", "route_id").alias("line"))


def station_of_stop(stops: DataFrame) -> DataFrame:
    """(stop_id, station_stop, name, lat, lon): each stop's station is its parent, one level up, if that exists, else itself."""
    parent = stops.select(F.col("stop_id").alias("parent_id"), F.col("stop_name").alias("p_name"), F.col("stop_lat").alias("p_lat"), F.col("stop_lon").alias("p_lon"))
    both = stops.join(parent, stops.parent_station == parent.parent_id, "left")
    pick = lambda p, own: F.when(F.col("parent_id").isNotNull(), F.col(p)).otherwise(F.col(own))
    return both.select("stop_id", F.coalesce("parent_id", "stop_id").alias("station_stop"), pick("p_name", "stop_name").alias("name"), F.coalesce(pick("p_lat", "stop_lat").try_cast("double"), F.lit(0.0)).alias("lat"), F.coalesce(pick("p_lon", "stop_lon").try_cast("double"), F.lit(0.0)).alias("lon"))


def fill_times(stop_times: DataFrame, trip: str = "trip_id", seq: str = "seq") -> DataFrame:
    """arr from dep, dep from arr; both missing: the trip's last known departure, else 0."""
    earlier = Window.partitionBy(trip).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.coalesce("dep", "arr"), ignorenulls=True).over(earlier)
    filled = stop_times.withColumn("_known", F.coalesce(known, F.lit(0)))
    return filled.withColumns({"arr": F.coalesce("arr", "dep", "_known"), "dep": F.coalesce("dep", "arr", "_known")}).drop("_known")


def timetable(stops: DataFrame, routes: DataFrame, trips: DataFrame, stop_times: DataFrame, types=RAIL, lines: tuple[str, ...] = ()) -> DataFrame:
    """(trip_id, line, stop_id, seq, arr, dep, shape_id, name, lat, lon) of the stops of kept trips at their stations (stop_id is the station's)."""
    kept = trips.join(small(kept_routes(routes, types, lines)), "route_id").select("trip_id", "line", "shape_id")
    calls = stop_times.join(small(kept), "trip_id")
    calls = calls.select("trip_id", "line", "shape_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), clock_seconds(F.col("arrival_time")).alias("arr"), clock_seconds(F.col("departure_time")).alias("dep"))
    # filled while the calls still lie by trip: a large table of stops deals them anew
    at = fill_times(calls).join(small(station_of_stop(stops)), "stop_id", "left")
    return at.select("trip_id", "line", "shape_id", F.coalesce("station_stop", "stop_id").alias("stop_id"), "seq", "arr", "dep", F.coalesce("name", "stop_id").alias("name"), F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"))


def stations(calls: DataFrame) -> DataFrame:
    """(station, stop_id, name, lat, lon, lines) of visited stations; the index is dense, in order of stop_id."""
    seen = calls.groupBy("stop_id").agg(F.min("name").alias("name"), F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.array_sort(F.collect_set("line")).alias("lines"))
    return seen.select((F.row_number().over(Window.orderBy("stop_id")) - 1).alias("station"), "stop_id", "name", "lat", "lon", "lines")


def _slack(cap: int) -> Column:
    return F.least(F.greatest(round_half_up(F.avg("x") - F.min("x")), F.lit(0)), F.lit(cap))


def edges(calls: DataFrame, run_limit: int = RUN_LIMIT, cap: int = RUN_CAP, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(src, dst, run_sec, run_slack_sec) of consecutive stops of trips: least run time, and how much the mean run exceeds it."""
    trip = Window.partitionBy("trip_id").orderBy(*order)
    hop = calls.select(F.col("station").alias("src"), F.lead("station").over(trip).alias("dst"), (F.lead("arr").over(trip) - F.col("dep")).alias("x"))
    hop = hop.where((F.col("x") >= 0) & (F.col("x") < run_limit) & F.col("dst").isNotNull())
    return hop.groupBy("src", "dst").agg(F.min("x").alias("run_sec"), _slack(cap).alias("run_slack_sec"))


def dwell(calls: DataFrame, limit: int = DWELL_LIMIT, cap: int = DWELL_CAP, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(station, dwell_slack_sec) over interior stops of trips."""
    trip = Window.partitionBy("trip_id").orderBy(*order)
    stop = calls.select("station", (F.col("dep") - F.col("arr")).alias("x"), F.lag("station").over(trip).alias("before"), F.lead("station").over(trip).alias("after"))
    stop = stop.where((F.col("x") >= 0) & (F.col("x") < limit) & F.col("before").isNotNull() & F.col("after").isNotNull())
    return stop.groupBy("station").agg(_slack(cap).alias("dwell_slack_sec"))


def merged_edges(all_edges: DataFrame) -> DataFrame:
    """One row a directed pair: the faster run wins."""
    return all_edges.groupBy("src", "dst").agg(F.min(F.struct("run_sec", "run_slack_sec")).alias("e")).select("src", "dst", "e.*")


def transfers(feed: DataFrame, stops: DataFrame, seen: DataFrame, slack: int = TRANSFER_SLACK) -> DataFrame:
    """(src, dst, min_sec, slack_sec) between visited stations in both directions; the last of duplicates wins, by row_no where the feed has it, else in the order of its one file."""
    to = small(station_of_stop(stops).join(seen.select("station", F.col("stop_id").alias("station_stop")), "station_stop").select("stop_id", "station"))
    rows = feed if "row_no" in feed.columns else feed.withColumn("row_no", F.monotonically_increasing_id())
    rows = rows.join(to.select(F.col("stop_id").alias("from_stop_id"), F.col("station").alias("src")), "from_stop_id").join(to.select(F.col("stop_id").alias("to_stop_id"), F.col("station").alias("dst")), "to_stop_id").where("src != dst")
    minimum = F.greatest(F.coalesce(F.col("min_transfer_time").try_cast("int"), F.lit(TRANSFER_MIN)), F.lit(0))
    rows = rows.select("src", "dst", minimum.alias("min_sec"), "row_no")
    rows = rows.union(rows.select("dst", "src", "min_sec", "row_no"))
    return rows.groupBy("src", "dst").agg(F.max_by("min_sec", "row_no").alias("min_sec")).withColumn("slack_sec", F.lit(slack))


def trip_stops(calls: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(trip_id, line, stops) of trips of two calls or more, stops being (pos, station, arr, dep) in order."""
    number = F.row_number().over(Window.partitionBy("trip_id").orderBy(*order)) - 1
    placed = calls.select("trip_id", "line", number.alias("pos"), "station", "arr", "dep")
    stops = F.array_sort(F.collect_list(F.struct("pos", "station", "arr", "dep")))
    return placed.groupBy("trip_id", "line").agg(stops.alias("stops")).where(F.size("stops") > 1)


def patterns(calls: DataFrame, order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """(patterns, trip_times): trips of one line with the same stations in the same order form a pattern; its trips are numbered by first departure."""
    trips = trip_stops(calls, order)
    key = F.sha2(F.concat_ws(",", F.col("line"), F.transform("stops", lambda s: s["station"].cast("string"))), 256)
    trips = trips.select("trip_id", "line", key.alias("pattern_id"), "stops", F.col("stops")[0]["dep"].alias("dep0"))
    trips = trips.withColumn("trip_no", F.row_number().over(Window.partitionBy("pattern_id").orderBy("dep0", "trip_id")) - 1)
    kinds = trips.groupBy("pattern_id", "line").agg(F.first(F.size("stops")).alias("n_stops"), F.count("*").alias("n_trips"))
    times = trips.select("pattern_id", "trip_id", "trip_no", F.explode("stops").alias("s")).select("pattern_id", "trip_id", "trip_no", "s.pos", "s.station", F.col("s.arr").alias("arr_sec"), F.col("s.dep").alias("dep_sec"))
    return kinds, times


def pattern_stops(times: DataFrame) -> DataFrame:
    """(pattern_id, pos, station): also the index from a station to its patterns."""
    return times.where("trip_no = 0").select("pattern_id", "pos", "station")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the shapes of a batch together, one stop of each at a time; see geometry."""
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        flat = lambda name: column[name].flatten().to_numpy(zero_copy_only=False)
        first = lambda name: np.asarray(column[name].offsets)[:-1].astype(np.int64) - column[name].offsets[0].as_py()
        size = lambda name: np.diff(np.asarray(column[name].offsets).astype(np.int64))
        s0, sn, p0, pn = first("s_lon"), size("s_lon"), first("p_lon"), size("p_lon")
        at, line, station = np.stack([flat("s_lon"), flat("s_lat")], 1), np.stack([flat("p_lon"), flat("p_lat")], 1).astype(float), flat("s_station")
        gap = lambda p, q: ((p - q) ** 2).sum(axis=1)
        a, z, head, tail = at[s0], at[s0 + sn - 1], line[p0], line[p0 + pn - 1]
        turned = gap(tail, a) + gap(head, z) < gap(head, a) + gap(tail, z)
        order = _spans(p0, pn)
        within = order - np.repeat(p0, pn)
        line = line[np.where(np.repeat(turned, pn), np.repeat(p0 + pn - 1, pn) - within, order)]
        low, out = np.zeros(len(s0), np.int64), []
        for k in range(int(sn.max(initial=0))):
            here = np.flatnonzero(sn > k)
            sizes = pn[here] - low[here]
            begin = np.cumsum(sizes) - sizes
            index = _spans(p0[here] + low[here], sizes)
            away = gap(line[index], np.repeat(at[s0[here] + k], sizes, axis=0))
            hit = np.flatnonzero(away == np.repeat(np.minimum.reduceat(away, begin), sizes))
            owner, firsts = np.unique(np.searchsorted(begin, hit, "right") - 1, return_index=True)
            now = low.copy()
            now[here[owner]] += hit[firsts] - begin[owner]
            if k:
                long = here[now[here] > low[here]]
                out.append((long, np.full(len(long), k - 1), low[long], now[long] - low[long] + 1))
            low = now
        shape, place, start, points = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 4))
        path = line[_spans(p0[shape] + start, points)] if len(shape) else line[:0]
        values = pa.StructArray.from_arrays([pa.array(path[:, 0]), pa.array(path[:, 1])], ["lon", "lat"])
        paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(points)]).astype(np.int32)), values)
        ends = [pa.array(station[s0[shape] + place + k].astype(np.int32)) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([column["shape_id"].take(pa.array(shape)), pa.array(place.astype(np.int32)), *ends, paths], ["shape_id", "place", "src", "dst", "path"])


def geometry(calls: DataFrame, shapes: DataFrame) -> DataFrame:
    """(src, dst, path) from the shapes that trips use: each shape is turned to its trip's direction and cut between stops.

    Stops are projected forward only, each to its nearest shape point after the last one's.
    Pieces of fewer than two points are dropped; of several pieces for a pair the first by shape_id and place on it wins.
    """
    first = calls.where("shape_id is not null").groupBy("shape_id").agg(F.min("trip_id").alias("trip_id"))
    stops = calls.join(first, ["shape_id", "trip_id"]).groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("seq", "station", "lon", "lat"))).alias("stops"))
    point = F.struct(F.col("shape_pt_sequence").try_cast("int").alias("n"), F.col("shape_pt_lon").try_cast("double").alias("lon"), F.col("shape_pt_lat").try_cast("double").alias("lat"))
    lines = shapes.join(small(first.select("shape_id")), "shape_id", "left_semi").groupBy("shape_id").agg(F.array_sort(F.collect_list(point)).alias("points"))

    columns = [F.col(f"{c}.{name}").alias(f"{c[0]}_{name}") for c, name in (("stops", "station"), ("stops", "lon"), ("stops", "lat"), ("points", "lon"), ("points", "lat"))]
    pieces = stops.join(lines, "shape_id").select("shape_id", *columns).mapInArrow(_pieces, "shape_id string, place int, src int, dst int, path array<struct<lon:double,lat:double>>")
    return pieces.groupBy("src", "dst").agg(F.min_by("path", F.struct("shape_id", "place")).alias("path"))


def matrix_view(net_edges: DataFrame, seen: DataFrame, ranks: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(edges with weights, stations with hub score and lines), both with the network's version."""
    nodes = seen.join(ranks, "station", "left").select("station", "name", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "lines", F.lit(version).alias("graph_version"))
    return net_edges.select("src", "dst", F.col("run_sec").alias("weight"), F.lit(version).alias("graph_version")), nodes


def seriation(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(station, place): stations by their first (pattern, position), unvisited ones last by index."""
    seen = stops.groupBy("station").agg(F.min(F.struct("pattern_id", "pos")).alias("first"))
    order = Window.orderBy(F.col("first").isNull(), "first", "station")
    return nodes.select("station").join(seen, "station", "left").select("station", (F.row_number().over(order) - 1).alias("place"))


def network_stats(nodes: DataFrame, net_edges: DataFrame, walks: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return one(nodes, "stations").union(one(net_edges, "edges")).union(one(walks, "transfers"))


def top_hubs(ranks: DataFrame, k: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("pagerank"), "station").limit(k)


def search_stations(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first stations by index whose name contains the text, whatever its case."""
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("station").limit(limit)


def stop_map(stops: DataFrame) -> DataFrame:
    """(stop_id, station): the least index of each stop; blank ids are dropped."""
    return stops.where(F.trim("stop_id") != "").groupBy("stop_id").agg(F.min("station").alias("station"))


def display_station(messages: DataFrame, station: int | None = None) -> DataFrame:
    """Adds the station that a subject such as piv/idf/{station}/{line} names, -1 if none; filters by it if given."""
    part = F.try_element_at(F.split("subject", "/"), F.lit(3)).try_cast("int")
    out = messages.withColumn("station", F.coalesce(part, F.lit(-1)))
    return out if station is None else out.where(F.col("station") == station)


def geometry_listing(paths: DataFrame) -> DataFrame:
    """(src, dst, points) with points as [lon, lat] pairs."""
    return paths.select("src", "dst", F.transform("path", lambda p: F.array(p["lon"], p["lat"])).alias("points"))
