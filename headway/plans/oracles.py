"""DuckDB SQL for the registered rail queries."""

ORDER = "arr, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
CALLS = f"""calls AS (
  SELECT l_orderkey AS trip_id, o_orderpriority AS line, s_nationkey AS station, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS arr,
    date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_linenumber % 4 AS dep, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey),
hops AS (SELECT *, lead(station) OVER w AS nxt, lead(arr) OVER w - dep AS run, lag(station) OVER w AS prv, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY trip_id) AS n
  FROM calls WINDOW w AS (PARTITION BY trip_id ORDER BY {ORDER})),
edges AS (SELECT station AS src, nxt AS dst, min(run) AS run_sec, CAST(least(greatest(floor(avg(run) - min(run) + 0.5), 0), 600) AS INT) AS run_slack_sec
  FROM hops WHERE run >= 0 AND run < 180 AND nxt IS NOT NULL GROUP BY ALL),
dwells AS (SELECT station, CAST(least(greatest(floor(avg(dep - arr) - min(dep - arr) + 0.5), 0), 600) AS INT) AS dwell_slack_sec
  FROM hops WHERE dep - arr >= 0 AND dep - arr < 30 AND prv IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL),
walks AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, 30 AS min_sec, 20 AS slack_sec FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
nodes AS (SELECT DISTINCT station, n_name AS name FROM calls JOIN nation ON n_nationkey = station)"""
EV = """ev AS (SELECT event_id, epoch_us(ts) // 1000 AS t, CAST(user_id % 25 AS INT) AS station, 'T' || user_id AS trip_id, event_type, value FROM events)"""
SOURCES = """sources AS (SELECT 'S' || event_id AS source_id, station, CAST(floor(value + 0.5) AS INT) AS delay FROM ev WHERE floor(value + 0.5) > 0 AND station IN (SELECT station FROM nodes))"""


def _cascade() -> str:
    """What absorbs least between any two stations, over 1, 2, 4 .. 128 hops; a residual is what a source's delay exceeds it by."""
    out = [f"WITH {CALLS}, {EV}, {SOURCES}", """ways AS (SELECT src, dst, min(absorb) AS absorb FROM (
      SELECT src, dst, run_slack_sec + coalesce(dwell_slack_sec, 0) AS absorb FROM edges LEFT JOIN dwells ON station = dst UNION ALL SELECT src, dst, slack_sec FROM walks) GROUP BY ALL)""",
      "a0 AS MATERIALIZED (SELECT src, dst, min(absorb) AS absorb FROM (SELECT * FROM ways UNION ALL SELECT station, station, 0 FROM nodes) GROUP BY ALL)"]
    for k in range(1, 8):
        out.append(f"a{k} AS MATERIALIZED (SELECT x.src, y.dst, min(x.absorb + y.absorb) AS absorb FROM a{k - 1} x JOIN a{k - 1} y ON x.dst = y.src GROUP BY ALL)")
    out.append("hit AS (SELECT source_id, dst AS station, CAST(delay - absorb AS INT) AS residual FROM sources JOIN a7 ON src = station WHERE delay > absorb)")
    return ", ".join(out)


def _labels() -> str:
    """_cascade with hop and missed. What is absorbed to a station, and so its predecessors, depend on the origin alone.

    A predecessor that lost less counts before those that lost as much; the hops are counted out from the origin."""
    return _cascade().replace("WITH ", "WITH RECURSIVE ", 1) + """, legs AS (SELECT src, dst, running, min(absorb) AS absorb FROM (
      SELECT src, dst, true AS running, run_slack_sec + coalesce(dwell_slack_sec, 0) AS absorb FROM edges LEFT JOIN dwells ON station = dst UNION ALL SELECT src, dst, false, slack_sec FROM walks) GROUP BY ALL),
    tight AS (SELECT x.src AS o, l.dst AS v, l.src AS u, running, x.absorb AS au, y.absorb AS av FROM a7 x JOIN legs l ON l.src = x.dst JOIN a7 y ON y.src = x.src AND y.dst = l.dst WHERE x.absorb + l.absorb = y.absorb AND l.dst <> x.src),
    one AS (SELECT o, v, arg_max(struct_pack(u := u, running := running), struct_pack(a := -au, b := running, c := u)) AS p FROM tight WHERE au < av GROUP BY o, v),
    into_ AS MATERIALIZED (SELECT o, v, p.u AS u, p.running AS running FROM one UNION ALL SELECT o, v, u, running FROM tight t WHERE au = av AND NOT EXISTS (SELECT 1 FROM one WHERE one.o = t.o AND one.v = t.v)),
    walk AS (SELECT DISTINCT src AS o, src AS s, 0 AS hop FROM a7 UNION SELECT w.o, v, hop + 1 FROM walk w JOIN into_ i ON i.o = w.o AND i.u = w.s WHERE hop < 40),
    hops_ AS (SELECT o, s, min(hop) AS hop FROM walk GROUP BY o, s),
    missed_ AS (SELECT i.o, i.v, arg_max(NOT running, struct_pack(b := running, c := i.u)) AS missed FROM into_ i JOIN hops_ x ON x.o = i.o AND x.s = i.u JOIN hops_ y ON y.o = i.o AND y.s = i.v WHERE x.hop + 1 = y.hop GROUP BY i.o, i.v),
    label AS (SELECT source_id, sources.station AS origin, hit.station, residual, delay - residual AS absorbed, coalesce(missed, false) AS missed, hop
      FROM hit JOIN sources USING (source_id) JOIN hops_ h ON h.o = sources.station AND h.s = hit.station LEFT JOIN missed_ m ON m.o = sources.station AND m.v = hit.station)"""


def _ranks(teleport: str) -> str:
    """50 rounds; a station without links passes its rank on as the teleport does."""
    return f"""WITH RECURSIVE {CALLS}, links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM (SELECT DISTINCT src, dst FROM edges)), base AS ({teleport}),
      share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / degree AS p FROM links UNION ALL SELECT a.station, b.station, b.t FROM base a, base b WHERE a.station NOT IN (SELECT src FROM links)),
      plain AS MATERIALIZED (SELECT station, t FROM base),
      r(k, station, r) AS (SELECT 0, station, t FROM plain UNION ALL
        SELECT any_value(k) + 1, station, 0.15 * any_value(t) + 0.85 * sum(part) FROM (SELECT r.k, plain.station, plain.t, coalesce(r.r * share.p, 0) AS part FROM plain JOIN r ON true LEFT JOIN share ON share.src = r.station AND share.dst = plain.station WHERE r.k < 50) GROUP BY station)
      SELECT station, round(r, 8) AS pagerank FROM r WHERE k = 50"""


LOG = f"""{EV}, log AS (SELECT event_id AS seq, CASE WHEN event_id % 5000 = 0 THEN 'clear' WHEN event_id % 97 = 0 THEN 'drop' ELSE 'set' END AS action,
    CASE WHEN event_id % 89 = 0 THEN 'zone' WHEN event_id % 2 = 0 THEN 'station' ELSE 'line' END AS target,
    CASE WHEN event_id % 2 = 0 THEN CAST(station + CASE WHEN event_id % 83 = 0 THEN 100 ELSE 0 END AS VARCHAR) WHEN event_id % 4 = 1 THEN '1-URGENT' ELSE '5-LOW' END AS id,
    CASE WHEN event_id % 79 = 0 THEN -1.0::DOUBLE ELSE (event_id % 7)::DOUBLE / 4 END AS weight FROM ev),
  named AS (SELECT DISTINCT 'line' AS target, line AS id FROM calls UNION SELECT 'station', CAST(station AS VARCHAR) FROM nodes),
  judged AS (SELECT log.*, CASE WHEN action = 'clear' THEN NULL WHEN action <> 'set' THEN 'unknown action' WHEN target NOT IN ('line', 'station') THEN 'unknown target' WHEN (target, id) NOT IN (SELECT (target, id) FROM named) THEN 'unknown id' WHEN weight < 0 THEN 'no weight' END AS reason FROM log),
  force AS (SELECT target, id, arg_max(weight, seq) AS weight, max(seq) AS seq FROM judged WHERE action = 'set' AND reason IS NULL AND seq > coalesce((SELECT max(seq) FROM judged WHERE action = 'clear'), -1) GROUP BY target, id)"""

# Ranks under overrides go on from those without any: 50 rounds each.
RERANK = f"""WITH RECURSIVE {CALLS}, {LOG}, links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM (SELECT DISTINCT src, dst FROM edges)),
  raw AS (SELECT n.station, greatest(coalesce(any_value(o.weight), 1.0) * avg(coalesce(l.weight, 1.0)), 0.0) AS w FROM nodes n JOIN (SELECT DISTINCT station, line FROM calls) c USING (station)
    LEFT JOIN force o ON o.target = 'station' AND o.id = CAST(n.station AS VARCHAR) LEFT JOIN force l ON l.target = 'line' AND l.id = c.line GROUP BY n.station),
  both_ AS MATERIALIZED (SELECT station, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS t0, w / (SELECT sum(w) FROM raw) AS t FROM raw),
  share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / degree AS p, NULL::DOUBLE AS dummy FROM links),
  dead AS MATERIALIZED (SELECT station FROM both_ WHERE station NOT IN (SELECT src FROM links)),
  r(k, station, r) AS (SELECT 0, station, t0 FROM both_ UNION ALL
    SELECT any_value(k) + 1, station, 0.15 * any_value(t) + 0.85 * sum(part) FROM (SELECT r.k, b.station, CASE WHEN r.k < 50 THEN b.t0 ELSE b.t END AS t, coalesce(r.r * share.p, 0) + CASE WHEN r.station IN (SELECT station FROM dead) THEN r.r * CASE WHEN r.k < 50 THEN b.t0 ELSE b.t END ELSE 0 END AS part
      FROM both_ b JOIN r ON true LEFT JOIN share ON share.src = r.station AND share.dst = b.station WHERE r.k < 100) GROUP BY station)
  SELECT station, round(r, 8) AS pagerank FROM r WHERE k = 100"""

W = f"""WITH {CALLS}, pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(run_sec) AS t FROM edges WHERE src <> dst GROUP BY ALL),
weights AS (SELECT a, b, exp(-(t * t) / 400.0) AS w FROM pairs WHERE exp(-(t * t) / 400.0) > 0),
sym AS (SELECT a AS r, b AS c, w FROM weights UNION ALL SELECT b, a, w FROM weights),
deg AS (SELECT r, sum(w) AS d FROM sym GROUP BY r),
lap AS (SELECT s.r AS "row", s.c AS col, -w / sqrt(x.d * y.d) AS val FROM sym s JOIN deg x ON x.r = s.r JOIN deg y ON y.r = s.c
  UNION ALL SELECT station, station, CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END FROM nodes LEFT JOIN deg ON r = station),
scaled AS (SELECT "row", col, val * 1.0 - CASE WHEN "row" = col THEN 1.0 ELSE 0.0 END AS val FROM lap)"""

SIDES = f"""{EV}, c AS (SELECT * FROM ev WHERE event_type IN ('click', 'view')), p AS (SELECT * FROM ev WHERE event_type IN ('purchase', 'signup'))"""

# A cascade takes its station's last prediction before it, if near; else the first near prediction after it, up to the next cascade that waits.
JOINED = f"""{SIDES}, now AS (SELECT c.station, c.event_id, c.t, c.value, c.event_type = 'click' AS missed, arg_max(struct_pack(id := p.event_id, t := p.t, esc := p.value / 500), p.event_id) AS lp FROM c LEFT JOIN p ON p.station = c.station AND p.event_id < c.event_id GROUP BY ALL),
waits AS (SELECT *, lead(event_id) OVER (PARTITION BY station ORDER BY event_id) AS until FROM now WHERE NOT coalesce(abs(t - lp.t) <= 21600000, false)),
met AS (SELECT w.event_id, arg_min(struct_pack(id := p.event_id, t := p.t, esc := p.value / 500), p.event_id) AS np FROM waits w JOIN p ON p.station = w.station AND p.event_id > w.event_id AND (until IS NULL OR p.event_id < until) AND abs(p.t - w.t) <= 21600000 GROUP BY w.event_id),
joined AS (SELECT station, event_id, t, value, missed, lp.id AS pid, lp.esc AS esc, abs(t - lp.t) AS lag_ms FROM now WHERE abs(t - lp.t) <= 21600000
  UNION ALL SELECT station, event_id, t, value, missed, np.id, np.esc, coalesce(abs(t - np.t), -1) FROM waits LEFT JOIN met USING (event_id)),
scored AS (SELECT *, CAST(event_id AS VARCHAR) AS cascade_id, (1 + 1.0::DOUBLE / (station + 1) / (SELECT max(1.0::DOUBLE / (station + 1)) FROM nodes)) * (greatest(value, 0) / 60.0::DOUBLE + 2.0 * CAST(missed AS INT) + 3.0 * least(greatest(coalesce(esc, 0.0), 0.0), 1.0)) AS total FROM joined)"""

HOURS = f"""{EV}, reads AS (SELECT station, (t // 1000) // 3600 AS frame, arg_max(value, ((t // 1000), value)) AS v FROM ev GROUP BY ALL),
grid AS (SELECT s.station, f.frame FROM (SELECT DISTINCT station FROM reads) s, (SELECT unnest(generate_series((SELECT min(frame) FROM reads), (SELECT max(frame) FROM reads))) AS frame) f),
fr AS (SELECT station, frame, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY station ORDER BY frame), 0.0) AS delay FROM grid LEFT JOIN reads USING (station, frame)),
hist AS (SELECT station, frame, delay, CAST(least(sum(CASE WHEN delay <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY frame), 13) AS INT) AS seen,
  CAST(count(*) OVER h AS INT) AS frames, sum(delay) OVER h AS total, lead(delay, 3) OVER (PARTITION BY station ORDER BY frame) - delay AS y
  FROM fr WINDOW h AS (PARTITION BY station ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""

# The regression's normal equations, 12 delays, two terms over the network and one, by elimination a column at a time.
MODEL = f"""{W.replace("WITH ", "WITH RECURSIVE ", 1)}, {HOURS}, terms1 AS MATERIALIZED (SELECT frame, "row" AS station, sum(val * delay) AS x FROM scaled JOIN fr ON fr.station = col GROUP BY ALL),
terms2 AS (SELECT fr.frame, fr.station, 2 * coalesce(s.x, 0) - fr.delay AS x FROM fr LEFT JOIN (SELECT frame, "row" AS station, sum(val * x) AS x FROM scaled JOIN terms1 ON terms1.station = col GROUP BY ALL) s USING (station, frame)),
feats AS MATERIALIZED (SELECT h.station, h.frame, delay, y, seen, frames, list_concat(list_transform(past, lambda v: v / 600), [coalesce(a.x, 0) / 600, coalesce(b.x, 0) / 600, 1.0]) AS x
  FROM (SELECT *, list(delay) OVER (PARTITION BY station ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS past FROM hist) h LEFT JOIN terms1 a USING (station, frame) LEFT JOIN terms2 b USING (station, frame)),
tr AS MATERIALIZED (SELECT x, y / 600 AS t FROM feats WHERE frames = 12 AND y IS NOT NULL AND (frame + station) % 5 <> 0),
cells AS (SELECT i, j, avg(x[i] * x[j]) AS a FROM tr, range(1, 16) u(i), range(1, 16) v(j) GROUP BY i, j), rhs AS (SELECT i, avg(x[i] * t) AS b FROM tr, range(1, 16) u(i) GROUP BY i),
eq AS (SELECT i, list_append(list(a + CASE WHEN i = j AND i < 15 THEN 0.001 ELSE 0 END ORDER BY j), any_value(b)) AS r FROM cells JOIN rhs USING (i) GROUP BY i),
elim(k, m) AS (SELECT 1, (SELECT list(r ORDER BY i) FROM eq) UNION ALL SELECT k + 1, list_transform(m, lambda r, i: list_transform(range(1, 17), lambda c: CASE WHEN i = k THEN r[c] / r[k] ELSE r[c] - r[k] / m[k][k] * m[k][c] END)) FROM elim WHERE k <= 15),
weights_ AS (SELECT list_transform(m, lambda r: r[16]) AS w FROM elim WHERE k = 16),
modelled AS (SELECT feats.*, CASE WHEN frames = 12 THEN list_dot_product(x, w) * 600 END AS prediction FROM feats, weights_)"""

TRIPS = f"""{CALLS}, trips AS (SELECT trip_id, line, list(station ORDER BY pos) AS stops, count(*) AS n_stops, min(CASE WHEN pos = 0 THEN dep END) AS dep0 FROM hops GROUP BY trip_id, line HAVING count(*) > 1)"""

BOARD = f"""{TRIPS}, ends AS (SELECT trip_id, arg_max(station, pos) AS terminus, max(pos) AS last FROM hops WHERE n > 1 GROUP BY trip_id),
rows_ AS (SELECT DISTINCT station, line, dep AS dep_sec, terminus FROM hops JOIN ends USING (trip_id) WHERE pos < last AND dep >= 1000 AND dep < 1400),
board AS (SELECT * FROM (SELECT station, line, CAST(row_number() OVER (PARTITION BY station, line ORDER BY dep_sec, terminus) AS INT) AS place, dep_sec, terminus FROM rows_) WHERE place <= 5)"""


def _journeys() -> str:
    out = [f"""WITH {CALLS}, rides AS (SELECT a.station AS src, b.station AS dst, a.dep, b.arr FROM hops a JOIN hops b ON a.trip_id = b.trip_id AND a.pos < b.pos WHERE a.station <> b.station GROUP BY ALL),
      q AS (SELECT 'Q' || c_custkey AS query_id, c_nationkey AS origin, (c_nationkey + 7) % 25 AS dest, CAST(c_custkey * 37 % 2400 AS INT) AS dep0 FROM customer),
      l0 AS (SELECT query_id, station, min(arr) AS arr FROM (SELECT query_id, origin AS station, dep0 AS arr FROM q UNION ALL SELECT query_id, dst, dep0 + min_sec FROM q JOIN walks ON src = origin) GROUP BY ALL)"""]  # fmt: skip
    for k in range(1, 7):
        p = k - 1
        out.append(f"""m{k} AS MATERIALIZED (SELECT query_id, dst AS station, min(rides.arr) AS arr FROM l{p} JOIN rides ON src = station AND dep >= l{p}.arr GROUP BY ALL),
          i{k} AS (SELECT m.* FROM m{k} m LEFT JOIN l{p} o ON o.query_id = m.query_id AND o.station = m.station WHERE o.arr IS NULL OR m.arr < o.arr),
          l{k} AS MATERIALIZED (SELECT query_id, station, min(arr) AS arr FROM (SELECT * FROM l{p} UNION ALL SELECT * FROM i{k} UNION ALL SELECT query_id, dst, arr + min_sec FROM i{k} JOIN walks ON src = station) GROUP BY ALL)""")
    ends = " UNION ALL ".join(f"SELECT q.query_id, arr AS arrival, {max(k - 1, 0)} AS transfers, {k} AS k FROM l{k} JOIN q ON q.query_id = l{k}.query_id AND station = dest" for k in range(7))
    out.append(f"ends AS (SELECT query_id, transfers, min(arrival) AS arrival FROM ({ends}) GROUP BY ALL)")
    return ", ".join(out) + " SELECT query_id, arrival, transfers FROM (SELECT *, min(arrival) OVER (PARTITION BY query_id ORDER BY transfers ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ends) WHERE b IS NULL OR arrival < b"


FEED = f"""WITH days AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS arr FROM lineitem),
base AS (SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, o_orderpriority AS line, s_suppkey % 10 = 0 AS lost, s_suppkey, s_name, n_nationkey, n_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS seq,
    CASE WHEN l_linenumber % 5 <> 0 AND l_linenumber % 7 <> 0 THEN arr * 60 END AS a0, CASE WHEN l_linenumber % 3 <> 0 AND l_linenumber % 7 <> 0 THEN arr * 60 + l_linenumber % 4 * 30 END AS d0
  FROM days JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
known AS (SELECT *, last_value(coalesce(d0, a0) IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM base),
every AS (SELECT trip_id, line, CASE WHEN lost THEN 'S' || s_suppkey ELSE 'N' || n_nationkey END AS stop_id, CAST(seq AS INT) AS seq, CAST(coalesce(a0, d0, before, 0) AS INT) AS arr, CAST(coalesce(d0, a0, before, 0) AS INT) AS dep,
    CASE WHEN lost THEN s_name ELSE n_name END AS name, CAST(CASE WHEN lost THEN s_suppkey + 100 ELSE n_nationkey + 40 END AS DOUBLE) AS lat, CASE WHEN lost THEN s_suppkey ELSE n_nationkey END * 0.25::DOUBLE AS lon FROM known),
rail AS (SELECT * FROM every WHERE line <> '5-LOW'),
seen AS (SELECT CAST(row_number() OVER (ORDER BY stop_id) - 1 AS INT) AS station, * FROM (SELECT stop_id, min(name) AS name, min(lat) AS lat, min(lon) AS lon, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM rail GROUP BY stop_id))"""
# Consecutive calls at one station are one run; the shape holds each call, so a piece starts with one point a call of its run.
RUNS = """turns AS (SELECT trip_id, seq, station, lon, lat, CAST(coalesce(station <> lag(station) OVER w, true) AS INT) AS turn FROM rail JOIN seen USING (stop_id, lat, lon) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
runs AS (SELECT trip_id, min(seq) AS first, any_value(station) AS station, CAST(any_value(lon) * 4 AS INT) || ':' || CAST(any_value(lat) AS INT) AS point, count(*) AS n
  FROM (SELECT *, sum(turn) OVER (PARTITION BY trip_id ORDER BY seq) AS run FROM turns) GROUP BY trip_id, run),
pieces AS (SELECT trip_id, first, station AS src, lead(station) OVER w AS dst, repeat(point || ',', n) || lead(point) OVER w AS points FROM runs WINDOW w AS (PARTITION BY trip_id ORDER BY first))"""

ORACLES = {
    "feed_calls": f"{FEED} SELECT * FROM rail",
    "feed_stations": f"{FEED} SELECT station, stop_id, name, lat, lon, lines FROM seen",
    "feed_edges": f"""{FEED}, places AS (SELECT stop_id, CAST(row_number() OVER (ORDER BY stop_id) - 1 AS INT) AS station FROM (SELECT DISTINCT stop_id FROM every)),
      rides AS (SELECT line = '5-LOW' AS bus, station AS src, lead(station) OVER w AS dst, lead(arr) OVER w - dep AS run FROM every JOIN places USING (stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
      links AS (SELECT bus, src, dst, min(run) AS run_sec, CAST(least(greatest(floor(avg(run) - min(run) + 0.5), 0), 600) AS INT) AS run_slack_sec FROM rides WHERE run >= 0 AND run < 21600 AND dst IS NOT NULL GROUP BY ALL)
      SELECT src, dst, run_sec, run_slack_sec FROM links QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY run_sec, run_slack_sec) = 1""",
    "feed_transfers": f"""{FEED}, ends AS (SELECT s_suppkey AS row_no, CASE WHEN s_suppkey % 10 = 0 THEN 'S' || s_suppkey ELSE 'N' || s_nationkey END AS a, 'N' || (s_nationkey + s_suppkey) % 25 AS b, CASE WHEN s_suppkey % 4 = 0 THEN 120 ELSE s_suppkey * 37 % 300 END AS m FROM supplier),
      way AS (SELECT x.station AS src, y.station AS dst, m, row_no FROM ends JOIN seen x ON x.stop_id = a JOIN seen y ON y.stop_id = b WHERE a <> b)
      SELECT src, dst, CAST(arg_max(m, row_no) AS INT) AS min_sec, 120 AS slack_sec FROM (SELECT * FROM way UNION ALL SELECT dst, src, m, row_no FROM way) GROUP BY src, dst""",
    "feed_geometry": f"{FEED}, {RUNS} SELECT src, dst, points FROM pieces WHERE dst IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY 'H' || trip_id, first) = 1",
    "cascade_impact": f"{_labels()} SELECT source_id, count(*) AS stations_hit, max(hop) AS max_hop, max(residual) AS peak_residual, CAST(sum(absorbed) AS BIGINT) AS total_absorbed, CAST(sum(CAST(missed AS INT)) AS BIGINT) AS missed, count(*) / (SELECT count(*) FROM nodes)::DOUBLE AS network_share FROM label GROUP BY source_id",
    "cascade_labels": f"{_labels()} SELECT source_id, station, residual, absorbed, missed, hop FROM label",
    "cascade_events": f"""{_labels()} SELECT sha256(event_id || '|' || label.station) AS event_id, CAST(event_id AS VARCHAR) AS origin_event_id, trip_id, label.station AS station_id, residual::DOUBLE AS propagated_delay_seconds, absorbed::DOUBLE AS absorbed_slack_seconds, missed AS missed_connection, hop, 'v1' AS graph_version, t AS event_time_ms, 1706745600000 AS compute_time_ms
      FROM label JOIN ev ON source_id = 'S' || event_id""",
    "network_edges": f"WITH {CALLS} SELECT src, dst, run_sec, run_slack_sec FROM edges",
    "network_dwell": f"WITH {CALLS} SELECT station, dwell_slack_sec FROM dwells",
    "station_rollup": f"WITH {CALLS} SELECT station, count(*) AS calls, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM calls GROUP BY station",
    "patterns": f"WITH {TRIPS}, kinds AS (SELECT line, stops, n_stops, count(*) AS n FROM trips GROUP BY ALL) SELECT line, CAST(n_stops AS INT) AS n_stops, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS trips FROM kinds GROUP BY line, n_stops",
    "pattern_index": f"WITH {TRIPS}, k AS (SELECT DISTINCT line, stops FROM trips) SELECT station, count(*) AS patterns FROM (SELECT DISTINCT line, stops, unnest(stops) AS station FROM k) GROUP BY station",
    "network_stats": f"WITH {CALLS} SELECT 'stations' AS metric, count(*) AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'transfers', count(*) FROM walks",
    "network_matrix": f"WITH {CALLS} SELECT src, dst, run_sec AS weight, 'v1' AS graph_version FROM edges",
    "seriation": f"WITH {CALLS}, f AS (SELECT station, min((line, arr)) AS first FROM calls GROUP BY station) SELECT station, CAST(row_number() OVER (ORDER BY first, station) - 1 AS INT) AS place FROM f",
    "station_search": f"WITH {CALLS} SELECT station, name FROM nodes WHERE contains(lower(name), 'n_1') ORDER BY station LIMIT 20",
    "stop_map": "SELECT s_name AS stop_id, min(s_nationkey) AS station FROM supplier WHERE trim(s_name) <> '' GROUP BY s_name",
    "normalize_positions": f"""WITH {EV} SELECT trip_id, 'V' || event_id AS vehicle_id, CASE WHEN event_id % 3 < 2 THEN CAST('48.' || station AS DOUBLE) END AS latitude, CASE WHEN event_id % 3 < 2 THEN 2.5 END AS longitude,
      CASE WHEN event_id % 3 = 2 THEN station END AS station_id, floor(value) AS delay_seconds, t // 1000 * 1000 AS event_time_ms FROM ev WHERE event_type <> 'error'""",
    "dead_letters": f"WITH {EV} SELECT 'POSITION' AS kind, '{{\"trip_id\":\"BROKEN' || event_id || '\", not json' AS body, 'malformed json' AS reason, 1706745600000 AS ingest_ts FROM ev WHERE event_type = 'error'",
    "signalling_events": f"WITH {EV} SELECT 'B' || station AS block_id, CASE event_type WHEN 'click' THEN 'OCCUPIED' WHEN 'view' THEN 'CLEAR' WHEN 'signup' THEN 'FAILED' ELSE 'UNSPECIFIED' END AS block_state, count(*) AS n, max(t) AS last_ms FROM ev GROUP BY ALL",
    "incident_events": f"WITH {EV} SELECT 'L' || station AS key, CASE event_type WHEN 'error' THEN 'INFRASTRUCTURE' ELSE 'EXTERNAL' END AS category, 'MAJOR' AS severity, count(*) AS n, 2 * count(*) AS stations FROM ev WHERE event_type IN ('error', 'purchase') GROUP BY ALL",
    "trip_partitions": f"WITH {EV} SELECT trip_id, 1 AS partitions, count(*) AS events FROM ev GROUP BY trip_id",
    "cascade_residuals": f"{_cascade()} SELECT source_id, station, residual FROM hit",
    "cascade_summary": f"{_cascade()} SELECT source_id, count(*) AS stations_hit, max(residual) AS peak_residual, CAST(sum(residual) AS BIGINT) AS total_residual FROM hit GROUP BY source_id",
    "hub_overrides": f"WITH {CALLS}, {LOG} SELECT target, id, weight, seq FROM force",
    "rejected_directives": f"WITH {CALLS}, {LOG} SELECT seq, action, target, id, weight, reason FROM judged WHERE reason IS NOT NULL",
    "hub_rerank": RERANK,
    "pagerank": _ranks("SELECT station, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS t FROM nodes"),
    "top_hubs": _ranks("SELECT station, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS t FROM nodes") + " ORDER BY pagerank DESC, station LIMIT 10",
    "pagerank_personalised": _ranks("SELECT station, (station % 3 + 0.5)::DOUBLE / (SELECT sum(station % 3 + 0.5)::DOUBLE FROM nodes) AS t FROM nodes"),
    "kernel_weights": f"{W} SELECT a, b, round(w, 8) AS w FROM weights",
    "laplacian": f'{W} SELECT "row", col, CASE WHEN round(val, 8) = 0 THEN 0.0 ELSE round(val, 8) END AS val FROM lap',
    "adjacency": f"""{W}, own AS (SELECT * FROM sym UNION ALL SELECT station, station, 1.0 FROM nodes), od AS (SELECT r, sum(w) AS d FROM own GROUP BY r)
      SELECT o.r AS "row", o.c AS col, round(w / sqrt(x.d * y.d), 8) AS val FROM own o JOIN od x ON x.r = o.r JOIN od y ON y.r = o.c""",
    "scaled_laplacian": f'{W} SELECT "row", col, CASE WHEN round(val, 8) = 0 THEN 0.0 ELSE round(val, 8) END AS val FROM scaled',
    "lambda_max": f"""{W.replace("WITH calls", "WITH RECURSIVE calls", 1)}, l AS MATERIALIZED (SELECT * FROM lap), n AS MATERIALIZED (SELECT station FROM nodes),
      v(k, station, x) AS (SELECT 0, station, 1 / sqrt((SELECT count(*) FROM n)::DOUBLE) FROM n UNION ALL
        SELECT k + 1, "row", y / sqrt(sum(y * y) OVER ()) FROM (SELECT any_value(k) AS k, "row", sum(val * x) AS y FROM v JOIN l ON col = station WHERE k < 99 GROUP BY "row"))
      SELECT (SELECT count(*) FROM n) AS stations, round(least(greatest(sum(val * a.x * b.x), 1e-6), 2.0), 8) AS lambda_max FROM l JOIN v a ON a.station = "row" AND a.k = 99 JOIN v b ON b.station = col AND b.k = 99""",
    "diffusion": f"WITH {CALLS} SELECT src AS \"row\", dst AS col, round(1.0 / count(*) OVER (PARTITION BY src), 8) AS val FROM (SELECT DISTINCT src, dst FROM edges)",
    "cheb_features": f"""{W}, t0 AS (SELECT station, (station % 5)::DOUBLE AS x FROM nodes), t1 AS (SELECT "row" AS station, sum(val * x) AS x FROM scaled JOIN t0 ON station = col GROUP BY ALL),
      t2 AS (SELECT s.station, 2 * s.x - t0.x AS x FROM (SELECT "row" AS station, sum(val * x) AS x FROM scaled JOIN t1 ON station = col GROUP BY ALL) s JOIN t0 USING (station))
      SELECT station, 0 AS k, round(x, 6) AS x FROM t0 UNION ALL SELECT station, 1, round(x, 6) FROM t1 UNION ALL SELECT station, 2, round(x, 6) FROM t2""",
    "criticality_join": f"WITH {CALLS}, {JOINED} SELECT station, CAST(event_id AS VARCHAR) AS cascade_id, CAST(pid AS VARCHAR) AS prediction_id, CAST(lag_ms AS BIGINT) AS lag_ms FROM joined",
    "criticality_latest": f"WITH {CALLS}, {JOINED} SELECT station, arg_max(cascade_id, (t, cascade_id)) AS cascade_id, round(arg_max(total, (t, cascade_id)), 6) AS total FROM scored GROUP BY station",
    "criticality_events": f"WITH {CALLS}, {JOINED} SELECT s.station AS station_id, name AS station_name, pid IS NOT NULL AS prediction_joined, count(*) AS n, round(sum(total), 4) AS total FROM scored s LEFT JOIN nodes USING (station) GROUP BY ALL",
    "topk_decisions": f"WITH {CALLS}, {JOINED}, o AS (SELECT station, cascade_id, row_number() OVER (PARTITION BY station ORDER BY total DESC, cascade_id) AS i FROM scored) SELECT station, string_agg(cascade_id, ',' ORDER BY i) AS cascades FROM o WHERE i <= 3 GROUP BY station",
    "criticality_interval": f"""WITH {SIDES} SELECT c.station, count(p.event_id) AS pairs, count(*) - count(p.event_id) AS alone, CAST(sum(coalesce(abs(c.t - p.t), -1)) AS BIGINT) AS lag_ms
      FROM c LEFT JOIN p ON p.station = c.station AND abs(c.t - p.t) <= 21600000 GROUP BY c.station""",
    "criticality_top": f"{_labels()} SELECT station, round((1 + 1.0::DOUBLE / (station + 1) / (SELECT max(1.0::DOUBLE / (station + 1)) FROM nodes)) * (max(residual)::DOUBLE + 2 * max(CAST(missed AS INT)) + 3 * avg(CAST(missed AS INT))), 3) AS total FROM label GROUP BY station ORDER BY total DESC, station LIMIT 10",
    "latest_observation": f"WITH {EV} SELECT station, arg_max(value, (t // 1000, value, trip_id)) AS delay, arg_max(trip_id, (t // 1000, value, trip_id)) AS trip_id FROM ev GROUP BY station",
    "frames_resampled": f"WITH {HOURS} SELECT station, frame, delay FROM fr",
    "rolling_history": f"WITH {HOURS} SELECT station, frame, seen, frames, round(total, 6) AS total FROM hist",
    "escalation": f"WITH {HOURS} SELECT station, frame, round(delay * 1.1, 6) AS forecast, round(least(greatest((delay * 1.1 - delay) / greatest(delay, 30.0), 0), 1), 6) AS escalation_ratio, round(delay * 1.1 * 1.25, 6) AS p90 FROM hist WHERE delay >= 60",
    "prediction_events": f"WITH {HOURS} SELECT 'station-' || station AS trip_id, station AS station_id, count(*) AS n, max(frame) * 3600000 AS last_ms FROM hist WHERE delay >= 60 GROUP BY station",
    "supervised_windows": f"WITH {HOURS} SELECT station, frame, round(delay, 6) AS now, round(y, 6) AS y FROM hist WHERE frames = 12 AND y IS NOT NULL",
    "forecast_losses": f"""WITH {HOURS}, e AS (SELECT (y - delay * 0.1) / 600 AS e FROM hist WHERE frames = 12 AND y IS NOT NULL)
      SELECT round(avg(e * e), 6) AS mse, round(avg(abs(e) * 600), 6) AS mae_seconds, round(avg(greatest(0.9 * e, -0.1 * e)), 6) AS pinball, round(0.7 * avg(e * e) + 0.3 * avg(greatest(0.9 * e, -0.1 * e)), 6) AS loss FROM e""",
    "residual_forecast": f"""{MODEL}, e AS (SELECT (y - prediction) / 600 AS e FROM modelled WHERE y IS NOT NULL AND prediction IS NOT NULL AND (frame + station) % 5 = 0)
      SELECT round(avg(e * e), 6) AS mse, round(avg(abs(e) * 600), 6) AS mae_seconds, round(avg(greatest(0.9 * e, -0.1 * e)), 6) AS pinball, round(0.7 * avg(e * e) + 0.3 * avg(greatest(0.9 * e, -0.1 * e)), 6) AS loss FROM e""",
    "escalation_model": f"""{MODEL}, f AS (SELECT station, frame, delay, seen < 3 OR prediction IS NULL AS cold, CASE WHEN seen < 3 OR prediction IS NULL THEN delay * 1.1 ELSE greatest(delay + prediction, 0) END AS f FROM modelled WHERE delay >= 60)
      SELECT station, frame, cold AS fallback_used, round(f, 4) AS forecast, round(least(greatest((f - delay) / greatest(delay, 30.0), 0), 1), 6) AS escalation_ratio FROM f""",
    "delay_percentiles": f"""WITH {EV}, s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
      SELECT event_type, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN value END) AS p50, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN value END) AS p95, max(CASE WHEN i = floor(0.99 * (n - 1)) THEN value END) AS p99 FROM s GROUP BY event_type""",
    "journey_frontier": _journeys(),
    "journey_path_proofs": f"SELECT query_id, min(arrival) AS arrival, arg_min(transfers, arrival) AS transfers, true AS whole, true AS exist FROM ({_journeys()}) GROUP BY query_id",
    "departure_board": f"WITH {BOARD} SELECT station, line, place, dep_sec, terminus FROM board",
    "display_messages": f"""WITH {BOARD} SELECT station || '/' || line || '/' || dep_sec AS message_id, 'piv/idf/' || station || '/' || line AS subject, name AS headline,
      printf('%02d:%02d', dep_sec // 3600, dep_sec // 60 % 60) AS body, 1705273200000 + dep_sec * 1000 AS valid_to_ms, 1705273200000 + dep_sec * 1000 - 60000 AS valid_from_ms,
      row_number() OVER (PARTITION BY b.station ORDER BY line, dep_sec, terminus) AS display_seq FROM (SELECT * FROM board) b LEFT JOIN (SELECT station AS terminus, name FROM nodes) n USING (terminus)""",
}
