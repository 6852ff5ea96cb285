"""Delay cascades: how far a delay spreads through the network before margins absorb it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import content_id, round_half_up
from ..functions.tables import saved, small


def absorbing_edges(edges: DataFrame, dwell: DataFrame, transfers: DataFrame) -> DataFrame:
    """(src, dst, absorb, running): what a delay loses on its way; running edges also lose the dwell margin at their end. Parallel ways keep the least loss."""
    run = edges.join(small(dwell.withColumnRenamed("station", "dst")), "dst", "left").select("src", "dst", (F.col("run_slack_sec") + F.coalesce("dwell_slack_sec", F.lit(0))).cast("long").alias("absorb"), F.lit(True).alias("running"))
    walk = transfers.select("src", "dst", F.col("slack_sec").cast("long").alias("absorb"), F.lit(False).alias("running"))
    return run.union(walk).groupBy("src", "dst", "running").agg(F.min("absorb").alias("absorb"))


def _origins(sources: DataFrame) -> DataFrame:
    """(origin, delay): each station that sources start at, with their largest delay; saved."""
    return saved(sources.groupBy(F.col("station").alias("origin")).agg(F.max("delay").cast("long").alias("delay")), "origins")


def _each(sources: DataFrame, found: DataFrame) -> DataFrame:
    """What was found from each origin, for every source: the stations at which something is left of its delay."""
    each = sources.withColumnRenamed("station", "origin").join(small(found), "origin").where("delay > absorbed")
    rest = [c for c in found.columns if c not in ("origin", "station", "absorbed")]
    return each.select("source_id", "station", (F.col("delay") - F.col("absorbed")).cast("long").alias("residual"), "absorbed", *rest)


def residuals(sources: DataFrame, ways: DataFrame, max_hops: int = 128) -> DataFrame:
    """(source_id, station, residual): the largest residual delay at each station reached; a source_id has one row of sources.

    How much is absorbed on the way to a station depends on where a delay starts, not on how large it is. So every
    station where sources start is spread once, as far as the largest delay there gets, and joined back.
    """
    sources = sources.where("delay > 0")
    return _each(sources, _spread(_origins(sources), ways, max_hops)).drop("absorbed")


def _spread(origins: DataFrame, ways: DataFrame, max_hops: int) -> DataFrame:
    """(origin, station, absorbed): the least that is absorbed between the two, where it is less than the origin's delay.

    All origins advance together, one join a round. Only rows that improved in the last round are
    expanded; each round is written to shared storage; it stops when nothing improves.
    """
    ways = small(saved(ways.groupBy("src", "dst").agg(F.min("absorb").alias("absorb")), "ways"))
    best = saved(origins.select("origin", F.col("origin").alias("station"), F.lit(0).cast("long").alias("absorbed"), "delay"), "best")
    frontier = best
    for _ in range(max_hops):
        step = frontier.join(ways, frontier.station == ways.src).select("origin", F.col("dst").alias("station"), (F.col("absorbed") + F.col("absorb")).alias("absorbed"), "delay").where("absorbed < delay")
        step = step.groupBy("origin", "station").agg(F.min("absorbed").alias("new"), F.first("delay").alias("delay"))
        frontier = saved(step.join(best.select("origin", "station", "absorbed"), ["origin", "station"], "left").where("absorbed is null or new < absorbed").select("origin", "station", F.col("new").alias("absorbed"), "delay"), "frontier")
        if frontier.isEmpty():
            break
        best = saved(best.union(frontier).groupBy("origin", "station").agg(F.min("absorbed").alias("absorbed"), F.first("delay").alias("delay")), "best")
    return best.drop("delay")


def labelled(best: DataFrame, ways: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds hop and missed to (origin, station, absorbed), by a law that leaves nothing open.

    A station may be reached from its tight predecessors, those whose absorbed delay and the way's make up its own. One
    that has lost less comes before one that has lost as much: of those it is the first by (absorbed, rank, running
    before walking, station). A station that only has predecessors that lost as much is reached by the fewest hops,
    and of these from the first in the same order. hop is the predecessor's and one, missed if the way is a walk.
    """
    ranked = best.join(small(ranks), "station", "left").select("origin", F.col("station").alias("u"), F.col("absorbed").alias("au"), F.coalesce("pagerank", F.lit(0.0)).alias("rank"))
    tight = ranked.join(small(ways), ranked.u == ways.src).join(best.select("origin", F.col("station").alias("dst"), F.col("absorbed").alias("av")), ["origin", "dst"]).where("au + absorb = av and dst != origin")
    tight = tight.select("origin", F.col("dst").alias("v"), "u", F.struct((-F.col("au")).alias("lost"), "rank", "running", "u").alias("order"), "running", (F.col("au") < F.col("av")).alias("strict"))
    strict = tight.where("strict").groupBy("origin", "v").agg(F.max_by(F.struct("u", "order", "running"), "order").alias("p")).select("origin", "v", "p.*")
    loose = tight.where("not strict").join(strict.select("origin", "v"), ["origin", "v"], "left_anti").select("origin", "v", "u", "order", "running")
    into = saved(strict.union(loose), "predecessors")
    done = saved(best.where("station = origin").select("origin", "station", F.lit(0).alias("hop"), F.lit(False).alias("missed")), "done")
    fresh = done
    while not fresh.isEmpty():
        came = fresh.select("origin", F.col("station").alias("u"), "hop")
        new = into.join(came, ["origin", "u"]).groupBy("origin", F.col("v").alias("station")).agg(F.max_by(F.struct((F.col("hop") + 1).alias("hop"), (~F.col("running")).alias("missed")), "order").alias("l"))
        fresh = saved(new.join(done, ["origin", "station"], "left_anti").select("origin", "station", "l.*"), "fresh")
        done = saved(done.union(fresh), "done")
    return best.join(done, ["origin", "station"]).select("origin", "station", "absorbed", "missed", "hop")


def propagate(sources: DataFrame, edges: DataFrame, dwell: DataFrame, transfers: DataFrame, ranks: DataFrame | None = None, max_hops: int = 128) -> DataFrame:
    """(source_id, station, residual, absorbed, missed, hop) for sources(source_id, station, delay) with a positive delay at a known station.

    Every station where sources start is spread and labelled once and joined back, see residuals.
    """
    ways = saved(absorbing_edges(edges, dwell, transfers), "ways")
    known = ways.select(F.col("src").alias("station")).union(ways.select("dst")).distinct()
    sources = sources.join(small(known), "station", "left_semi").where("delay > 0")
    ranks = ranks if ranks is not None else known.select("station", F.lit(0.0).alias("pagerank"))
    return _each(sources, saved(labelled(_spread(_origins(sources), ways, max_hops), ways, ranks), "labels"))


def cascade_summary(cascades: DataFrame, n_stations: int) -> DataFrame:
    return cascades.groupBy("source_id").agg(F.count("*").alias("stations_hit"), F.max("hop").alias("max_hop"), F.max("residual").alias("peak_residual"), F.sum("absorbed").alias("total_absorbed"), F.sum(F.col("missed").cast("int")).alias("missed"), (F.count("*") / F.lit(n_stations)).alias("network_share"))


def cascade_events(positions: DataFrame, edges: DataFrame, dwell: DataFrame, transfers: DataFrame, compute_time_ms: int, ranks: DataFrame | None = None, max_hops: int = 128) -> DataFrame:
    """One event for each station that a late position affects; delays are rounded half up first."""
    sources = positions.where("station_id is not null").select(F.col("event_id").alias("source_id"), F.col("station_id").alias("station"), round_half_up(F.col("delay_seconds")).alias("delay"))
    hit = propagate(sources, edges, dwell, transfers, ranks, max_hops).withColumnRenamed("source_id", "origin_event_id")
    origin = positions.select(F.col("event_id").alias("origin_event_id"), "trip_id", "graph_version", "event_time_ms")
    out = hit.join(origin, "origin_event_id").select("origin_event_id", "trip_id", F.col("station").alias("station_id"), F.col("residual").cast("double").alias("propagated_delay_seconds"), F.col("absorbed").cast("double").alias("absorbed_slack_seconds"), F.col("missed").alias("missed_connection"), "hop", "graph_version", "event_time_ms", F.lit(compute_time_ms).cast("long").alias("compute_time_ms"))
    return out.withColumn("event_id", content_id("origin_event_id", "station_id"))
