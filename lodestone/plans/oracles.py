"""DuckDB SQL for the queries of ``queries``: the same semantics, written down a second time."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


def jr(x: str, places: int) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians(({y2}) - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians(({x2}) - ({x1})) / 2), 2)))))"


def norm(x: str) -> str:
    s = f"regexp_replace(upper(trim({x})), '&', ' AND ', 'g')"
    s = f"regexp_replace({s}, '[.''’]', '', 'g')"
    s = f"trim(regexp_replace(regexp_replace({s}, '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    s = f"array_to_string(list_transform(string_split({s}, ' '), lambda w: CASE w WHEN 'MT' THEN 'MOUNT' WHEN 'MTN' THEN 'MOUNTAIN' WHEN 'RD' THEN 'ROAD' ELSE w END), ' ')"
    return f"regexp_replace({s}, '( ?\\bTRAIL)+$', '')"


def tok(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def overlap(a: str, b: str) -> str:
    x, y = tok(a), tok(b)
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0e0 ELSE len(list_intersect({x}, {y}))::DOUBLE / greatest(len({x}), len({y})) END)"


def sim(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1e0 ELSE 1e0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def key(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha1(concat_ws('|', {', '.join(parts)})), 1, 16)"


def closest(px: str, py: str, ax: str, ay: str, bx: str, by: str, source: str, keep: str) -> str:
    """A query of ``keep``, ratio, d (metres) over ``source``."""
    return f"""(SELECT *, {hav('px', 'py', '(ux + vx * ratio) / (111320e0 * cos(radians(oy))) + ox', '(uy + vy * ratio) / 111320e0 + oy')} AS d FROM (
      SELECT *, CASE WHEN vx * vx + vy * vy = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, ((qx - ux) * vx + (qy - uy) * vy) / (vx * vx + vy * vy))) END AS ratio FROM (
      SELECT *, (px - ox) * 111320e0 * cos(radians(oy)) AS qx, (py - oy) * 111320e0 AS qy, (ax - ox) * 111320e0 * cos(radians(oy)) AS ux, (ay - oy) * 111320e0 AS uy,
        (bx - ox) * 111320e0 * cos(radians(oy)) - (ax - ox) * 111320e0 * cos(radians(oy)) AS vx, (by_ - oy) * 111320e0 - (ay - oy) * 111320e0 AS vy FROM (
      SELECT {keep}, {px} AS px, {py} AS py, {ax} AS ax, {ay} AS ay, {bx} AS bx, {by} AS by_, (({px}) + ({ax}) + ({bx})) / 3 AS ox, (({py}) + ({ay}) + ({by})) / 3 AS oy FROM {source}))))"""


POINTS = """
e0 AS (
  SELECT user_id, row_number() OVER w AS rn, sum((event_type = 'error')::INT) OVER w AS er, sum((event_type = 'signup')::INT) OVER w AS comp
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), pts AS (
  SELECT 'u' || user_id AS activity_key, comp::INT AS component_idx, rn::INT AS point_idx, -71e0 + 4e-4 * rn + 2e-3 * er AS lon, 44e0 + 22e-5 * (user_id % 5) AS lat FROM e0
)"""
EDGES = f"""
g0 AS (
  SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM pts WINDOW w AS (PARTITION BY activity_key, component_idx ORDER BY point_idx)
), gaps AS (SELECT *, CASE WHEN lon2 IS NULL THEN NULL ELSE {hav('lon', 'lat', 'lon2', 'lat2')} END AS gap FROM g0
), lines AS (
  SELECT *, sum(new) OVER (PARTITION BY activity_key, component_idx ORDER BY point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS line_idx FROM (
    SELECT *, (coalesce(lag(gap) OVER (PARTITION BY activity_key, component_idx ORDER BY point_idx), 0) > 120)::INT AS new FROM gaps)
)"""
SEGMENTS = "seg AS (SELECT 's' || n_nationkey AS segment_key, -71e0 + 1e-3 * n_nationkey AS x1, 44e0 + 22e-5 * (n_nationkey % 5) AS y1, -71e0 + 1e-3 * n_nationkey + 5e-3 AS x2, 44e0 + 22e-5 * (n_nationkey % 5) AS y2 FROM nation)"
PAIRS = """
abox AS (SELECT activity_key, min(lon) AS ax1, min(lat) AS ay1, max(lon) AS ax2, max(lat) AS ay2 FROM pts GROUP BY 1
), pairs AS (
  SELECT activity_key, segment_key FROM (
    SELECT *, 35e0 / 111320e0 AS dy, 35e0 / greatest(111320e0 * cos(greatest(abs(ay1), abs(ay2), abs(y1), abs(y2)) * (3.141592653589793e0 / 180e0)), 1e0) AS dx FROM abox, seg)
  WHERE NOT (ax2 + dx < x1 OR ax1 - dx > x2 OR ay2 + dy < y1 OR ay1 - dy > y2)
)"""
SAMPLES = f"""
len AS (SELECT *, {hav('x1', 'y1', 'x2', 'y2')} AS total FROM seg
), s0 AS (
  SELECT segment_key, 0::BIGINT AS k, x1 AS px, y1 AS py FROM len
  UNION ALL SELECT segment_key, k, x1 + (x2 - x1) * (k * 20e0 / total), y1 + (y2 - y1) * (k * 20e0 / total) FROM (SELECT *, unnest(generate_series(1, (ceil(total / 20e0) - 1)::BIGINT)) AS k FROM len)
  UNION ALL SELECT segment_key, 1::BIGINT << 60, x2, y2 FROM len
), s1 AS (
  SELECT *, lag(px) OVER w AS bx, lag(py) OVER w AS by_ FROM s0 WINDOW w AS (PARTITION BY segment_key ORDER BY k)
), samples AS (
  SELECT segment_key, row_number() OVER (PARTITION BY segment_key ORDER BY k) - 1 AS sample_idx, px, py FROM s1 WHERE bx IS NULL OR {hav('bx', 'by_', 'px', 'py')} > 0.01
)"""
NEAR = f"""
probe AS (SELECT activity_key, segment_key, sample_idx, px AS sx, py AS sy FROM pairs JOIN samples USING (segment_key)
), oe AS (
  SELECT activity_key, segment_key, sample_idx, component_idx, line_idx, {jr('min(d)', 3)} AS d FROM {closest('sx', 'sy', 'lon', 'lat', 'lon2', 'lat2', "(SELECT * FROM probe JOIN lines USING (activity_key) WHERE gap <= 120)", 'activity_key, segment_key, sample_idx, component_idx, line_idx')} GROUP BY ALL
), op AS (
  SELECT activity_key, segment_key, sample_idx, component_idx, min({hav('sx', 'sy', 'lon', 'lat')}) AS d FROM probe JOIN pts USING (activity_key) GROUP BY ALL
), near AS (
  SELECT activity_key, segment_key, sample_idx, component_idx, {jr('min(d)', 3)} AS distance FROM (SELECT activity_key, segment_key, sample_idx, component_idx, d FROM oe UNION ALL SELECT * FROM op) GROUP BY ALL
), uni AS (SELECT activity_key, segment_key, sample_idx, min(distance) AS distance FROM near GROUP BY ALL
), last AS (SELECT segment_key, max(sample_idx) AS last FROM samples GROUP BY 1)"""


def evidence(rows: str, keys: str) -> str:
    return f"""
  SELECT m.*, coalesce(r.longest_run, 0) AS longest_run, {jr('coalesce(r.longest_run, 0) / m.samples', 4)} AS gap_ratio FROM (
    SELECT {keys}, count(*) AS samples, count(*) FILTER (distance <= 25) AS covered, {jr('count(*) FILTER (distance <= 25) / count(*)', 4)} AS coverage,
      {jr('median(distance)', 3)} AS median_distance, {jr('list_sort(list(distance))[greatest(1, ceil(count(*) * 0.95e0)::INT)]', 3)} AS p95_distance, {jr('max(distance)', 3)} AS max_distance,
      min(distance) FILTER (sample_idx = 0) AS start_distance, min(distance) FILTER (sample_idx = last) AS end_distance
    FROM {rows} JOIN last USING (segment_key) GROUP BY {keys}) m LEFT JOIN (
    SELECT {keys}, max(n) AS longest_run FROM (
      SELECT {keys}, i, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sample_idx) - row_number() OVER (PARTITION BY {keys}, distance <= 25 ORDER BY sample_idx) AS i FROM {rows}) WHERE NOT distance <= 25 GROUP BY {keys}, i)
    GROUP BY {keys}) r USING ({keys})"""


STRONG = "(coverage >= 0.9 AND start_distance <= 35 AND end_distance <= 35 AND median_distance <= 8 AND p95_distance <= 18 AND gap_ratio <= 0.2)"
P95 = "list_sort(list(gap) FILTER (gap IS NOT NULL))[greatest(1, ceil(count(gap) * 0.95e0)::INT)]"
STATS = f"""
stats AS (
  SELECT activity_key, {jr('coalesce(max(gap), 0)', 3)} AS max_gap, {jr(f'coalesce({P95}, 0)', 3)} AS p95_gap, count(*) FILTER (gap > 120) AS ignored_edges,
    {jr('coalesce(sum(gap), 0)', 3)} AS raw_metres, {jr('coalesce(sum(gap) FILTER (gap <= 120), 0)', 3)} AS trusted_metres FROM gaps GROUP BY 1
)"""
EVIDENCE = f"cm AS ({evidence('near', 'activity_key, segment_key, component_idx')}), pm AS ({evidence('uni', 'activity_key, segment_key')})"
MATCHES = f"""{EVIDENCE}, comp AS (
  SELECT activity_key, segment_key, max(coverage) AS best_coverage, arg_max(component_idx, struct_pack(c := coverage, n := -component_idx)) AS best_component, min(component_idx) FILTER ({STRONG}) AS strong_component FROM cm GROUP BY 1, 2
), f0 AS (
  SELECT *, {STRONG} AND strong_component IS NULL AS blocked, least(start_distance, end_distance) <= 35 AS reached, coverage >= 0.55 AND median_distance <= 25 AS middle
  FROM pm JOIN comp USING (activity_key, segment_key) JOIN stats USING (activity_key)
), matches AS (
  SELECT *, {key('activity_match', "'activity-matching-v1'", 'activity_key', 'segment_key')} AS match_key, CASE
    WHEN {STRONG} AND strong_component IS NOT NULL THEN 'strong_candidate' WHEN coverage >= 0.9 AND reached THEN 'needs_review' WHEN middle AND (blocked OR ignored_edges > 0) THEN 'needs_review'
    WHEN middle AND (median_distance > 18 OR p95_distance > 35) THEN 'needs_review' WHEN middle AND reached AND gap_ratio <= 0.45 THEN 'candidate' WHEN middle THEN 'needs_review'
    WHEN coverage >= 0.35 OR median_distance <= 25 THEN 'needs_review' ELSE 'insufficient_coverage' END AS classification FROM f0
)"""
CHAIN = f"WITH {POINTS.strip()}, {EDGES.strip()}, {SEGMENTS}, {PAIRS.strip()}, {SAMPLES.strip()}, {NEAR.strip()}"
FULL = f"{CHAIN}, {STATS.strip()}, {MATCHES}"

ORACLE_SQL["classify_matches"] = f"{FULL} SELECT activity_key, segment_key, match_key, classification, samples, covered, coverage, start_distance, end_distance, median_distance, p95_distance, max_distance, longest_run, gap_ratio, best_coverage, best_component, strong_component, ignored_edges, blocked FROM matches"
ORACLE_SQL["match_diagnostics"] = f"""{FULL}, n AS (
  SELECT count(*) AS scored, count(*) FILTER (classification = 'strong_candidate') AS strong_candidate, count(*) FILTER (classification = 'candidate') AS candidate, count(*) FILTER (classification = 'needs_review') AS needs_review,
    count(*) FILTER (classification = 'insufficient_coverage') AS insufficient_coverage, count(DISTINCT activity_key) FILTER (classification <> 'insufficient_coverage') AS matched_activities, count(DISTINCT segment_key) FILTER (classification <> 'insufficient_coverage') AS matched_segments FROM matches
), a AS (SELECT count(DISTINCT activity_key) AS activities FROM pts), s AS (SELECT count(*) AS segments FROM seg)
SELECT n.*, activities, segments, activities * segments AS considered, activities * segments - scored AS box_rejected, activities - matched_activities AS unmatched_activities FROM n, a, s"""
ORACLE_SQL["unmatched_activities"] = f"{FULL} SELECT DISTINCT activity_key FROM pts WHERE activity_key NOT IN (SELECT activity_key FROM matches WHERE classification <> 'insufficient_coverage')"
ORACLE_SQL["component_metrics"] = f"{CHAIN}, {EVIDENCE} SELECT activity_key, segment_key, component_idx, samples, covered, coverage, start_distance, end_distance, median_distance, p95_distance, max_distance, gap_ratio FROM cm"
#: The place of a covered sample: its component's, where the distance is least (ties: the smaller component); there the line's if it is as near as the nearest point (ties: the first line), else the first point's.
PLACES = f"""
cov AS (SELECT activity_key, segment_key, sample_idx, component_idx, distance FROM near WHERE distance <= 25
), pick AS (
  SELECT activity_key, segment_key, arg_min(component_idx, (sample_idx, distance, component_idx)) AS c1, min(sample_idx) AS i1, arg_min(component_idx, (-sample_idx, distance, component_idx)) AS c2, max(sample_idx) AS i2 FROM cov GROUP BY 1, 2
), seek AS (
  SELECT activity_key, segment_key, 'first' AS which, i1 AS sample_idx, c1 AS component_idx FROM pick UNION ALL SELECT activity_key, segment_key, 'last', i2, c2 FROM pick
), sought AS (SELECT seek.*, sx, sy FROM seek JOIN probe USING (activity_key, segment_key, sample_idx)
), le AS (
  SELECT activity_key, segment_key, which, line_idx, {jr('min(d)', 3)} AS d, arg_min(qlat, (d, point_idx)) AS lat
  FROM (SELECT *, (uy + vy * ratio) / 111320e0 + oy AS qlat FROM {closest('sx', 'sy', 'lon', 'lat', 'lon2', 'lat2', "(SELECT * FROM sought JOIN lines USING (activity_key, component_idx) WHERE gap <= 120)", 'activity_key, segment_key, which, line_idx, point_idx')}) GROUP BY ALL
), pe AS (SELECT activity_key, segment_key, which, min(d) AS d, arg_min(lat, (d, point_idx)) AS lat FROM (SELECT activity_key, segment_key, which, point_idx, lat, {hav('sx', 'sy', 'lon', 'lat')} AS d FROM sought JOIN pts USING (activity_key, component_idx)) GROUP BY ALL
), found AS (
  SELECT activity_key, segment_key, which, arg_min(lat, (d, kind, o)) AS lat FROM (SELECT activity_key, segment_key, which, d, 0 AS kind, line_idx AS o, lat FROM le UNION ALL SELECT activity_key, segment_key, which, d, 1, 0, lat FROM pe) GROUP BY ALL
)"""
ORACLE_SQL["coverage_metrics"] = f"""{CHAIN}, {EVIDENCE}, {PLACES.strip()}
SELECT activity_key, segment_key, covered, coverage, longest_run, {jr('a.lat', 5)} AS first_matched_lat, {jr('b.lat', 5)} AS last_matched_lat FROM pm
LEFT JOIN (SELECT * FROM found WHERE which = 'first') a USING (activity_key, segment_key) LEFT JOIN (SELECT * FROM found WHERE which = 'last') b USING (activity_key, segment_key)"""
ORACLE_SQL["nearest_distance"] = f"{CHAIN} SELECT activity_key, segment_key, sample_idx, distance FROM uni"
ORACLE_SQL["line_samples"] = f"WITH {SEGMENTS}, {SAMPLES.strip()} SELECT segment_key, sample_idx, {jr('px', 6)} AS lon, {jr('py', 6)} AS lat FROM samples"
ORACLE_SQL["bbox_pairs"] = f"WITH {POINTS.strip()}, {SEGMENTS}, {PAIRS.strip()} SELECT * FROM pairs"
ORACLE_SQL["trace_gaps"] = f"WITH {POINTS.strip()}, {EDGES.strip()}, {STATS.strip()} SELECT * FROM stats"
ORACLE_SQL["trusted_lines"] = f"WITH {POINTS.strip()}, {EDGES.strip()} SELECT activity_key, component_idx, line_idx, count(*) AS points, {jr('coalesce(sum(gap) FILTER (gap <= 120), 0)', 3)} AS metres FROM lines GROUP BY 1, 2, 3"
ORACLE_SQL["cumulative_measure"] = f"WITH {POINTS.strip()}, {EDGES.strip()} SELECT activity_key, component_idx, point_idx, {jr('coalesce(sum(gap) OVER (PARTITION BY activity_key, component_idx ORDER BY point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 3)} AS measure FROM gaps"
ORACLE_SQL["dedupe_sequential"] = f"""WITH {POINTS.strip()}, f AS (SELECT activity_key, component_idx, point_idx, -71e0 + (point_idx // 3) * 4e-4 AS lon, lat FROM pts
), l AS (SELECT *, lag(lon) OVER w AS bx, lag(lat) OVER w AS by_ FROM f WINDOW w AS (PARTITION BY activity_key, component_idx ORDER BY point_idx))
SELECT activity_key, component_idx, point_idx FROM l WHERE bx IS NULL OR {hav('bx', 'by_', 'lon', 'lat')} > 0.01"""
ORACLE_SQL["longest_uncovered_run"] = """WITH n AS (SELECT user_id, event_type = 'view' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, ok ORDER BY n) AS i FROM n), r AS (SELECT user_id, i, count(*) AS c FROM i WHERE NOT ok GROUP BY 1, 2)
SELECT user_id, coalesce(max(c), 0) AS longest_run FROM (SELECT DISTINCT user_id FROM n) LEFT JOIN r USING (user_id) GROUP BY 1"""
ORACLE_SQL["activity_summary"] = "SELECT count(DISTINCT user_id) AS activities, count(*) AS points FROM events"
ORACLE_SQL["activity_lengths"] = f"""WITH {POINTS.strip()}, v AS (SELECT *, count(*) OVER (PARTITION BY activity_key, component_idx) AS n FROM pts)
SELECT activity_key, count(*) AS original_points, count(*) FILTER (n < 2) AS malformed_points, count(*) FILTER (n >= 2) AS kept_points FROM v GROUP BY 1"""
ORACLE_SQL["haversine_length"] = f"WITH {SEGMENTS} SELECT segment_key, {jr(hav('x1', 'y1', 'x2', 'y2'), 3)} AS metres, {jr(hav('x1', 'y1', 'x2', 'y2') + ' / 1609.344e0', 6)} AS miles FROM seg"
ORACLE_SQL["bbox_extent"] = f"WITH {POINTS.strip()} SELECT activity_key, {jr('min(lon)', 6)} AS x1, {jr('min(lat)', 6)} AS y1, {jr('max(lon)', 6)} AS x2, {jr('max(lat)', 6)} AS y2 FROM pts GROUP BY 1"
ORACLE_SQL["point_segment_distance"] = f"""WITH {SEGMENTS}, c AS (SELECT c_custkey, 's' || c_nationkey AS segment_key, -71e0 + 1e-5 * (c_custkey % 4000) AS sx, 44e0 + 1e-5 * (c_custkey % 97) AS sy FROM customer)
SELECT c_custkey, {jr('d', 3)} AS distance, {jr('ratio', 6)} AS ratio FROM {closest('sx', 'sy', 'x1', 'y1', 'x2', 'y2', '(SELECT * FROM c JOIN seg USING (segment_key))', 'c_custkey')}"""
NETWORK = "na AS (SELECT 'n' || n_nationkey AS n_key, 44e0 + 1e-3 * n_nationkey AS y FROM nation), ra AS (SELECT 'r' || r_regionkey AS r_key, -70.9995e0 + 2e-3 * r_regionkey AS x FROM region), met AS (SELECT * FROM na, ra WHERE y BETWEEN 43.9995e0 AND 44.0245e0 AND x BETWEEN -71e0 AND -70.99e0)"
ORACLE_SQL["segment_crossings"] = f"WITH {NETWORK} SELECT n_key || '|' || r_key AS items, {jr('x', 6)} AS lon, {jr('y', 6)} AS lat FROM met"
ORACLE_SQL["line_splits"] = f"""WITH {NETWORK} SELECT n_key AS item_key, (SELECT count(*) FROM met m WHERE m.n_key = na.n_key) + 1 AS segments, {jr(hav('-71e0', 'y', '-70.99e0', 'y'), 1)} AS metres FROM na
UNION ALL SELECT r_key, (SELECT count(*) FROM met m WHERE m.r_key = ra.r_key) + 1, {jr(hav('x', '43.9995e0', 'x', '44.0245e0'), 1)} FROM ra"""
ORACLE_SQL["topology_diagnostics"] = f"""WITH {NETWORK}, c AS (SELECT count(*) AS crossings FROM met), l AS (SELECT count(*) AS lines FROM (SELECT n_key FROM na UNION ALL SELECT r_key FROM ra))
SELECT lines AS sources, lines, 2 * lines + crossings AS junctions, crossings, lines + 2 * crossings AS segments, 0::BIGINT AS near_misses, 0::BIGINT AS issues FROM c, l"""
ORACLE_SQL["endpoint_near_join"] = f"""WITH na AS (SELECT 'n' || n_nationkey AS item_key, 44e0 + 1e-3 * n_nationkey AS y FROM nation), c AS (SELECT c_custkey::VARCHAR AS junction_key, -71e0 + 1e-5 * (c_custkey % 1000) AS x, 44e0 + 1e-5 * (c_custkey % 2503) AS cy FROM customer)
SELECT junction_key, item_key, {jr('d', 2)} AS gap FROM {closest('x', 'cy', '-71e0', 'y', '-70.99e0', 'y', '(SELECT * FROM c, na WHERE abs(cy - y) < 2e-4)', 'junction_key, item_key')} WHERE d <= 12"""
ORACLE_SQL["junction_clusters"] = f"""WITH {POINTS.strip()}, q AS (SELECT activity_key, point_idx, lon, 1e-2 * substr(activity_key, 2)::BIGINT AS y FROM pts
), l AS (SELECT *, lag(lon) OVER (PARTITION BY activity_key ORDER BY point_idx) AS bx FROM q
), c AS (SELECT *, sum((bx IS NULL OR {hav('bx', 'y', 'lon', 'y')} > 60)::INT) OVER (PARTITION BY activity_key ORDER BY point_idx) AS cluster FROM l
), n AS (SELECT activity_key, cluster, count(*) AS n FROM c GROUP BY 1, 2)
SELECT activity_key, count(*) AS clusters, max(n) AS largest FROM n GROUP BY 1"""
ORACLE_SQL["component_groups"] = """WITH k AS (SELECT n_regionkey, n_nationkey // 5 AS k FROM nation), g AS (SELECT n_regionkey, (k >= 3)::BIGINT AS component_idx, count(*) AS members FROM k GROUP BY 1, 2)
SELECT 'r' || n_regionkey AS item_key, component_idx, members, members + 1 AS points, count(*) OVER (PARTITION BY n_regionkey) > 1 AS disconnected FROM g"""

# names and reconciliation
ORACLE_SQL["name_normalize"] = f"SELECT name, {norm('name')} AS normalized FROM (SELECT DISTINCT ' Mt. ' || p_name || ' & ' || p_type || '''s-Rd  TrAiL trail' AS name FROM part)"
NEXT = "WITH p AS (SELECT p_partkey, {0} AS a FROM part), x AS (SELECT p.p_partkey, p.a, q.a AS b FROM p JOIN p q ON p.p_partkey = q.p_partkey + 1)"
ORACLE_SQL["name_similarity"] = f"{NEXT.format('upper(p_name)')} SELECT p_partkey, {jr(sim('a', 'b'), 6)} AS similarity FROM x"
ORACLE_SQL["token_overlap"] = NEXT.format("upper(p_name || ' ' || p_type)") + f" SELECT p_partkey, {jr(overlap('a', 'b'), 6)} AS overlap FROM x"
ITEM_NAME = "array_to_string(list_transform(string_split(replace(p_name, 'e', ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Rd'"
FEATURES = "fe AS (SELECT p_partkey::VARCHAR AS id, 'Mt. ' || p_name || ' Trail' AS trail_name, p_size / 8e0 AS gis_miles, p_size * 1e-2 - 72 AS x1, p_retailprice * 1e-4 + 43 AS y1, p_size * 1e-2 - 72 + 2e-2 AS x2, p_retailprice * 1e-4 + 43 + 1e-2 AS y2 FROM part)"
GROUPS = f"{FEATURES}, gr AS (SELECT {norm('trail_name')} AS normalized, count(*) AS feature_count, min(trim(trail_name)) AS display_name, array_to_string(list_sort(list(DISTINCT trim(trail_name))), '|') AS names, array_to_string(list_transform(list_sort(list(id::BIGINT)), lambda v: v::VARCHAR), '|') AS ids, {jr('sum(gis_miles)', 6)} AS gis_miles, {jr('min(x1)', 6)} AS x1, {jr('min(y1)', 6)} AS y1, {jr('max(x2)', 6)} AS x2, {jr('max(y2)', 6)} AS y2 FROM fe GROUP BY 1)"
SCORED = f"""it AS (SELECT DISTINCT p_type || '|' || p_name AS item_key, {norm(ITEM_NAME)} AS item_name FROM part
), sc AS (
  SELECT item_key, item_name, normalized, {jr('sim', 3)} AS similarity, {jr('ov', 3)} AS overlap,
    CASE WHEN item_name = normalized THEN 100 ELSE least(100, floor(greatest(75e0 * sim, 70e0 * ov) + (CASE WHEN sim >= 0.82 THEN 15 ELSE 0 END) + (CASE WHEN ov >= 0.66 THEN 10 ELSE 0 END) + 0.5)) END::BIGINT AS score
  FROM (SELECT *, {sim('item_name', 'normalized')} AS sim, {overlap('item_name', 'normalized')} AS ov FROM it, gr)
), ca AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, normalized) AS place FROM sc WHERE score >= 45
), cl AS (
  SELECT it.item_key, count(ca.normalized) AS n_candidates, max(ca.normalized) FILTER (place = 1) AS top_name, max(score) FILTER (place = 1) AS top_score, max(score) FILTER (place = 2) AS second_score
  FROM it LEFT JOIN ca USING (item_key) GROUP BY 1
), cs AS (
  SELECT *, CASE WHEN n_candidates = 0 THEN 'unmatched' WHEN top_score = 100 AND coalesce(second_score, 0) < 90 THEN 'exact' WHEN n_candidates >= 2 AND top_score - second_score < 12 THEN 'ambiguous' ELSE 'needs_review' END AS status FROM cl
)"""
RECONCILE = f"WITH {GROUPS}, {SCORED}"
ORACLE_SQL["candidate_rank"] = f"{RECONCILE} SELECT item_key, item_name, normalized, similarity, overlap, score, place FROM ca WHERE place <= 5"
ORACLE_SQL["candidate_classify"] = f"{RECONCILE} SELECT * FROM cs"
ORACLE_SQL["reconcile_summary"] = f"{RECONCILE} SELECT count(*) AS items, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("exact", "ambiguous", "needs_review", "unmatched")) + ", count(*) FILTER (status <> 'unmatched') AS candidate_found FROM cs"
ORACLE_SQL["referenced_groups"] = f"{RECONCILE} SELECT normalized, feature_count FROM gr WHERE normalized IN (SELECT normalized FROM ca)"
ORACLE_SQL["source_groups"] = f"WITH {GROUPS} SELECT * FROM gr"
ORACLE_SQL["source_summary"] = f"WITH {FEATURES} SELECT count(*) AS features, count(nullif(trim(trail_name), '')) AS named, count(DISTINCT nullif(trim(trail_name), '')) AS unique_names, {jr('sum(gis_miles)', 3)} AS gis_miles FROM fe"
ORACLE_SQL["duplicate_names"] = "SELECT p_name, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1"
ORACLE_SQL["inventory_check"] = """WITH r AS (SELECT p_partkey + 2 AS row_no, CASE WHEN p_partkey % 50 = 7 THEN '' ELSE p_name || '-' || p_size END AS item_key, CASE WHEN p_partkey % 70 = 3 THEN '' ELSE p_name END AS name FROM part
), w AS (SELECT *, item_key <> '' AND row_number() OVER (PARTITION BY item_key ORDER BY row_no) > 1 AS again FROM r)
SELECT 'required_key' AS rule, 'Row ' || row_no || ': item_key is required.' AS message FROM w WHERE item_key = ''
UNION ALL SELECT 'required_name', 'Row ' || row_no || ': name is required.' FROM w WHERE name = ''
UNION ALL SELECT 'duplicate_key', 'Row ' || row_no || ': duplicate item_key ''' || item_key || '''.' FROM w WHERE again"""

# serving
SERVED = "WITH sv AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority AS trail_name, n_name AS segment_name, r_name AS region, l_quantity AS miles, l_returnflag = 'R' AS completed FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
PROGRESS = f"{jr('coalesce(sum(miles), 0)', 3)} AS total_miles, {jr('coalesce(sum(miles) FILTER (completed), 0)', 3)} AS completed_miles, count(*) AS segments, count(*) FILTER (completed) AS completed_segments, CASE WHEN coalesce(sum(miles), 0) = 0 THEN 0 ELSE {jr('100e0 * coalesce(sum(miles) FILTER (completed), 0) / sum(miles)', 3)} END AS miles_percent, CASE WHEN count(*) = 0 THEN 0 ELSE {jr('100e0 * count(*) FILTER (completed) / count(*)', 3)} END AS segments_percent"
HIT = lambda q: f"(contains(lower(trail_name), '{q}') OR contains(lower(segment_name), '{q}') OR contains(lower(region), '{q}'))"
ORACLE_SQL["filter_segments"] = f"{SERVED} SELECT l_orderkey, l_linenumber, l_partkey, miles FROM sv WHERE region = 'ASIA' AND completed AND {HIT('urgent')}"
ORACLE_SQL["available_regions"] = f"{SERVED} SELECT DISTINCT region FROM sv WHERE region IS NOT NULL"
ORACLE_SQL["progress_overall"] = f"{SERVED} SELECT {PROGRESS} FROM sv"
ORACLE_SQL["progress_filtered"] = f"{SERVED} SELECT {PROGRESS} FROM sv WHERE {HIT('high')}"
ORACLE_SQL["progress_by_region"] = f"{SERVED} SELECT region, {PROGRESS} FROM sv GROUP BY region"
ORACLE_SQL["api_view"] = "SELECT l_orderkey AS trail_id, l_linenumber, l_partkey, l_quantity, 't-' || o_orderkey AS trail_slug, o_orderpriority AS trail_name, o_orderstatus AS trail_region FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND l_returnflag = 'N' AND o_orderstatus <> 'P'"
ORACLE_SQL["rls_own_rows"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P'"
ORACLE_SQL["policy_exists"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_returnflag = 'N')"
ORACLE_SQL["top_page"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100"
ORACLE_SQL["workspace_search"] = "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name || ' ' || s_nationkey), 'upplier#00000001')"

# decisions
LOG = "lg AS (SELECT 'segment' AS target_type, user_id AS target_key, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'needs_review' END AS decision, ts, event_id FROM events)"
LAST = f"{LOG}, la AS (SELECT target_key, decision, event_id FROM lg QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY ts DESC, event_id DESC) = 1)"
ORACLE_SQL["latest_decision"] = f"WITH {LAST} SELECT * FROM la"
ORACLE_SQL["decision_override"] = f"""WITH {LOG}, o AS (SELECT target_key, decision, event_id FROM lg WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY ts DESC, event_id DESC) = 1
), n AS (SELECT target_key, decision, event_id FROM lg WHERE event_id % 2 = 1 AND decision <> 'needs_review' QUALIFY row_number() OVER (PARTITION BY target_key ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE target_key NOT IN (SELECT target_key FROM n)"""
ORACLE_SQL["duplicate_decisions"] = f"WITH {LOG} SELECT target_key, event_id, row_number() OVER (PARTITION BY target_key, decision ORDER BY ts, event_id) AS occurrence FROM lg QUALIFY occurrence > 1"
ORACLE_SQL["unknown_targets"] = "SELECT c_custkey AS target_key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"
ELIGIBLE = f"""WITH {LAST}, sg AS (SELECT o_orderkey::VARCHAR AS segment_key, 'c' || o_custkey AS start_key, 'p' || substr(o_orderpriority, 1, 1) AS end_key FROM orders
), d AS (
  SELECT 'segment' AS t, target_key::VARCHAR AS k, decision FROM la UNION ALL SELECT 'junction', 'c' || target_key, CASE WHEN target_key % 2 = 0 THEN 'accepted' ELSE decision END FROM la UNION ALL SELECT 'junction', 'p' || r_regionkey, 'accepted' FROM region
), x AS (
  SELECT sg.*, a.decision AS own, b.decision AS at_start, c.decision AS at_end FROM sg LEFT JOIN d a ON a.t = 'segment' AND a.k = segment_key LEFT JOIN d b ON b.t = 'junction' AND b.k = start_key LEFT JOIN d c ON c.t = 'junction' AND c.k = end_key)"""
ORACLE_SQL["eligible_segments"] = f"{ELIGIBLE} SELECT segment_key, start_key, end_key FROM x WHERE own = 'accepted' AND at_start = 'accepted' AND at_end = 'accepted'"
ORACLE_SQL["eligibility_warnings"] = f"{ELIGIBLE} SELECT segment_key, concat_ws(',', CASE WHEN own IS NULL THEN 'own' END, CASE WHEN at_start IS NULL THEN 'at_start' END, CASE WHEN at_end IS NULL THEN 'at_end' END) AS missing FROM x WHERE own IS NULL OR at_start IS NULL OR at_end IS NULL"

# publication
CAND = """WITH ca AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS seq, l_quantity / 16e0 AS miles,
    CASE l_returnflag WHEN 'N' THEN 'verified_for_publication' WHEN 'R' THEN 'rejected' ELSE 'needs_review' END AS segment_decision,
    CASE o_orderstatus WHEN 'F' THEN 'verified_for_publication' WHEN 'P' THEN 'rejected' ELSE 'needs_review' END AS trail_decision, o_orderkey
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)"""
OK = "segment_decision = 'verified_for_publication' AND coalesce(trail_decision = 'verified_for_publication' AND o_orderkey IS NOT NULL, false)"
ORACLE_SQL["gate_publish"] = f"{CAND} SELECT l_orderkey, seq, miles FROM ca WHERE {OK}"
ORACLE_SQL["gate_errors"] = f"{CAND} SELECT trail_decision, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN NULL ELSE trail_decision END AS trail_decision, segment_decision FROM ca) WHERE segment_decision = 'verified_for_publication' AND NOT coalesce(trail_decision = 'verified_for_publication', false) GROUP BY 1"
ORACLE_SQL["trail_rollup"] = f"{CAND} SELECT l_orderkey AS candidate_trail_key, count(*) AS segments, {jr('sum(miles)', 6)} AS miles, array_to_string(list_sort(list(DISTINCT segment_decision)), '|') AS ids, array_to_string(list_sort(list(DISTINCT lpad(seq::VARCHAR, 4, '0'))), '|') AS segment_keys FROM ca GROUP BY 1"
ORACLE_SQL["publication_diagnostics"] = f"{CAND} SELECT " + ", ".join(f"count(*) FILTER (segment_decision = '{k}') AS {k}" for k in ("verified_for_publication", "rejected", "needs_review")) + f", count(*) FILTER ({OK}) AS published_segments, count(DISTINCT l_orderkey) FILTER ({OK}) AS published_trails, {jr(f'sum(miles) FILTER ({OK})', 4)} AS published_miles FROM ca"
ORACLE_SQL["upsert_latest"] = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 <> 0 DESC, event_id DESC) = 1"
ORACLE_SQL["conflict_check"] = "SELECT 'conflict_o_orderkey' AS rule, 'conflict_o_orderkey:' || o_orderkey AS message FROM orders WHERE (o_orderkey % 11 = 0 AND o_orderstatus IS DISTINCT FROM 'X') OR (o_orderkey % 13 = 0 AND o_orderpriority IS NOT NULL)"
J = lambda *p: "'[' || " + " || ',' || ".join(f"'\"' || {x} || '\"'" for x in p) + " || ']'"
ORACLE_SQL["stable_keys"] = f"""WITH k AS (SELECT *, 'candidate_trail_' || substr(sha1({J('p_brand', norm('p_name'))}), 1, 16) AS candidate_key FROM part)
SELECT p_partkey, {key('junction', "'segment-construction-v1'", 'p_brand', 'p_name')} AS junction_key, candidate_key, 'trail_' || substr(sha1({J("'production-trail-key-v1'", 'candidate_key')}), 1, 16) AS trail_key, {key('activity_match', "'activity-matching-v1'", 'p_name', 'p_brand')} AS match_key FROM k"""
ORACLE_SQL["stable_uuid"] = "SELECT s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT s_suppkey, sha1(s_name) AS h FROM supplier)"
ORACLE_SQL["slugify"] = r"SELECT p_partkey, regexp_replace(regexp_replace(lower('  ' || p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(p_name || '.gpx', '[^A-Za-z0-9._-]', '_', 'g') AS file FROM part"
NUM = lambda x, p: f"(CASE WHEN {x} = 0 THEN '0' ELSE rtrim(rtrim(printf('%.{p}f', {jr(x, p)}), '0'), '.') END)"
LINE = lambda p, a, b: f"{NUM(f'x{a}', p)} || ',' || {NUM(f'y{a}', p)} || ';' || {NUM(f'x{b}', p)} || ',' || {NUM(f'y{b}', p)}"
ORACLE_SQL["fingerprint"] = f"WITH {SEGMENTS} SELECT segment_key, least({LINE(6, 1, 2)}, {LINE(6, 2, 1)}) AS fingerprint, sha256({LINE(7, 2, 1)}) AS reverse_sha256 FROM seg"

# open data
ORACLE_SQL["json_extract"] = "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.none') IS NULL AS absent FROM events"
ORACLE_SQL["coerce_numbers"] = f"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 0e0 WHEN 1 THEN (p_size || '.50')::DOUBLE WHEN 2 THEN NULL ELSE p_size::DOUBLE END AS number, {NUM('(p_retailprice / 7e0)', 3)} AS text FROM part"
ORACLE_SQL["validate_rows"] = "SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END, CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'name' END) AS failed FROM customer WHERE failed <> ''"
ORACLE_SQL["timestamp_valid"] = "SELECT o_orderkey, o_orderkey % 7 <> 0 AS ok FROM orders"
ORACLE_SQL["redact_paths"] = "SELECT s_suppkey, 'private path omitted' AS sourcePath, 'private path omitted' AS folder, 'a/b ' || s_name AS note, 'private path omitted' AS home, '/data/' || s_name AS root, 'x/' || s_name AS profile, 'private path omitted' AS disk FROM supplier"

#: Three sides of a triangle, or two: the second and third part each go behind the end where they touch it, else before the start.
_SIDES = ", ".join(f"CASE WHEN (c + {i}) % 4 < 2 THEN [(c // 7 + {i} * (1 + c % 2)) % 3, (c // 7 + {i} * (1 + c % 2) + 1) % 3] ELSE [(c // 7 + {i} * (1 + c % 2) + 1) % 3, (c // 7 + {i} * (1 + c % 2)) % 3] END AS p{i}" for i in range(3))
_ATTACH = "CASE WHEN {line}[-1] = {p}[1] THEN {line} || {p}[2:] WHEN {line}[-1] = {p}[2] THEN {line} || [{p}[1]] WHEN {line}[1] = {p}[2] THEN [{p}[1]] || {line} WHEN {line}[1] = {p}[1] THEN [{p}[2]] || {line} END"
ORACLE_SQL["chain_order"] = f"""WITH s AS (SELECT c_custkey AS c, {_SIDES} FROM (SELECT c_custkey, c_custkey AS c FROM customer)
), two AS (SELECT *, {_ATTACH.format(line='p0', p='p1')} AS l2 FROM s
), three AS (SELECT *, CASE WHEN c % 3 = 0 THEN l2 ELSE {_ATTACH.format(line='l2', p='p2')} END AS l FROM two)
SELECT 'c' || c AS item_key, array_to_string([round((-71e0 + 1e-3 * (c % 1000) + CASE k WHEN 1 THEN 4e-4 WHEN 2 THEN 2e-4 ELSE 0e0 END) * 10000)::BIGINT || ':' || round(CASE k WHEN 2 THEN 44.0003e0 ELSE 44e0 END * 10000)::BIGINT FOR k IN l], ' ') AS line FROM three"""

_INVENTORY = """WITH r AS (SELECT p_partkey + 2 AS row_no, CASE WHEN p_partkey % 50 = 7 THEN '' ELSE p_name || '-' || p_size END AS item_key, CASE WHEN p_partkey % 70 = 3 THEN '' ELSE p_name END AS name FROM part
), w AS (SELECT *, item_key <> '' AND row_number() OVER (PARTITION BY item_key ORDER BY row_no) > 1 AS again FROM r"""
_ITEMS = f"{_INVENTORY}), i AS (SELECT row_no, item_key, name, {norm('name')} AS normalized FROM w WHERE item_key <> '' AND name <> '' AND NOT again)"
ORACLE_SQL["inventory_items"] = f"{_ITEMS} SELECT * FROM i"
ORACLE_SQL["inventory_repeats"] = f"{_ITEMS} SELECT normalized, count(*) AS n, min(row_no) AS first_row FROM i GROUP BY 1 HAVING count(*) > 1"
ORACLE_SQL["repeated_key_issues"] = "SELECT 'duplicate_part' AS rule, 'duplicate_part:' || p_name || '|' || p_type AS message FROM part GROUP BY p_name, p_type HAVING count(*) > 1"
ORACLE_SQL["unknown_key_issues"] = "SELECT 'unknown_user' AS rule, 'unknown_user:' || user_id AS message, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY user_id"
_DECIDED = "CASE WHEN l_orderkey % 7 = 0 THEN 'needs_review' ELSE segment_decision END"
_OUT = "l_orderkey % 7 <> 0 AND segment_decision = 'verified_for_publication' AND trail_decision = 'verified_for_publication'"
ORACLE_SQL["publication_summary"] = f"{CAND} SELECT " + ", ".join(f"count(*) FILTER ({_DECIDED} = '{k}') AS {k}" for k in ("verified_for_publication", "rejected", "needs_review")) + f", count(*) FILTER ({_OUT}) AS published_segments, count(DISTINCT l_orderkey) FILTER ({_OUT}) AS published_trails, {jr(f'coalesce(sum(miles) FILTER ({_OUT}), 0)', 6)} AS published_miles FROM ca"
ORACLE_SQL["activity_span"] = "SELECT count(DISTINCT user_id) AS activities, count(*) AS points, min(ts::VARCHAR) AS earliest, max(ts::VARCHAR) AS latest FROM events"
_LOG = "SELECT user_id AS target_key, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'needs_review' END AS decision, ts, event_id FROM events"
_AT = "'%Y-%m-%d %H:%M:%S.%f'"
ORACLE_SQL["decision_intervals"] = f"""WITH l AS ({_LOG}), u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY target_key, ts ORDER BY event_id DESC) = 1
), r AS (SELECT *, lag(decision) OVER (PARTITION BY target_key ORDER BY ts) AS p FROM u), c AS (SELECT * FROM r WHERE p IS NULL OR p <> decision)
SELECT target_key, decision, strftime(ts, {_AT}) AS valid_from, strftime(lead(ts) OVER (PARTITION BY target_key ORDER BY ts), {_AT}) AS valid_to FROM c"""
ORACLE_SQL["decision_as_of"] = f"""WITH l AS ({_LOG}) SELECT e.event_id, e.user_id AS target_key,
(SELECT arg_max(l.decision, (l.ts, l.event_id)) FROM l WHERE l.target_key = e.user_id AND l.decision <> 'needs_review' AND l.ts <= e.ts) AS decision
FROM events e WHERE event_type IN ('view', 'click')"""
ORACLE_SQL["updated_at"] = "SELECT key, strftime(max(changed), '%Y-%m-%d') AS updated_at FROM (SELECT o_orderkey AS key, o_orderdate AS changed FROM orders UNION ALL SELECT l_orderkey, l_shipdate FROM lineitem) GROUP BY key"
ORACLE_SQL["user_completions"] = """WITH f AS (SELECT o_custkey AS user_id, l_partkey AS segment_key, o_orderkey AS activity_key, strftime(o_orderdate, '%Y-%m-%d') AS completed_on, 'gpx_match' AS completion_method, 1 - l_discount AS match_confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'
UNION ALL SELECT c_custkey, c_custkey % 200, NULL, '1997-06-01', CASE WHEN c_nationkey % 5 = 0 THEN 'admin' ELSE 'manual' END, NULL FROM customer WHERE c_nationkey % 5 <> 1)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, segment_key ORDER BY completed_on, completion_method <> 'admin', completion_method <> 'manual', match_confidence DESC, activity_key) = 1"""
ORACLE_SQL["load_plan"] = """SELECT o_orderkey AS trail_key, CASE WHEN o_orderkey % 3 = 0 THEN 'insert'
WHEN (o_orderkey % 11 = 0 AND o_orderstatus IS DISTINCT FROM 'X') OR o_orderkey % 13 = 0 THEN 'refuse' ELSE 'update' END AS action FROM orders"""
ORACLE_SQL["load_refusals"] = """SELECT 'trail_conflict' AS rule, 'trail_conflict:' || s_suppkey AS message FROM supplier WHERE s_suppkey % 9 = 4
UNION ALL SELECT 'segment_conflict', 'segment_conflict:' || p_partkey FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'trail_unknown', 'trail_unknown:' || p_partkey % 12 FROM part WHERE p_partkey % 12 NOT IN (SELECT s_suppkey FROM supplier)"""
_K = "json_extract_string(props, '$.k')"
_GONE = '"private path omitted"'
ORACLE_SQL["redact_nested"] = f"""SELECT event_id, '{{"a":{{"deep":[[{{"p":{_GONE}}}]],"note":"a/b"}},"importFolder":{_GONE},"n":1.5,"z":[{{"k":' || {_K} || '}},{{"file":[{_GONE},"a/b","plain"]}}]}}' AS doc FROM events"""
ORACLE_SQL["stable_documents"] = f"""SELECT event_id, sha256('{{"a":[1,1000],"b":{{"k":' || {_K} || '}}}}') AS sha256, true AS same FROM events"""
ORACLE_SQL["json_elements"] = """SELECT event_id, pos, ['/home/u' || user_id, 'a/b', 'plain'][pos + 1] AS element, '{"id":' || event_id || ',"pos":' || pos || ',"none":null}' AS object FROM events, range(3) t(pos)"""
_MATCHES = "WITH m AS (SELECT l_orderkey AS activity_key, CASE WHEN l_returnflag = 'R' THEN 'insufficient_coverage' WHEN l_linestatus = 'F' THEN 'candidate' ELSE 'strong_candidate' END AS c FROM lineitem)"
ORACLE_SQL["visible_matches"] = f"""{_MATCHES}, u AS (SELECT 'matched_segments' AS shown, activity_key FROM m WHERE c <> 'insufficient_coverage'
UNION ALL SELECT 'candidate', activity_key FROM m WHERE c = 'candidate'
UNION ALL SELECT 'unmatched_activities', activity_key FROM m WHERE activity_key NOT IN (SELECT activity_key FROM m WHERE c <> 'insufficient_coverage'))
SELECT shown, activity_key, count(*) AS n FROM u GROUP BY ALL"""
ORACLE_SQL["visible_publication"] = """SELECT p_partkey::VARCHAR AS segment_key, 'verified_for_publication' AS decision FROM part
WHERE CASE WHEN p_size % 4 = 0 THEN p_size % 8 <> 0 ELSE p_size > 30 END"""
ORACLE_SQL["decode_rows"] = """SELECT p_partkey::VARCHAR AS id, p_brand AS region, p_size + 0.5e0 AS miles, p_size::DOUBLE AS y1, 44.25e0 AS y2, 2 AS width,
CASE WHEN p_partkey % 3 = 1 THEN 'OSM' ELSE 'other' END AS provider, CASE WHEN p_partkey % 3 = 2 THEN p_brand ELSE p_type END AS dataset, 'a' || p_partkey || ',b' AS ids,
p_partkey % 5 = 0 OR p_partkey % 3 = 1 AS manually_modified, CASE WHEN p_partkey % 3 = 2 THEN '2024-01-01' END AS reviewed_at FROM part WHERE p_partkey % 7 > 1"""
ORACLE_SQL["error_messages"] = """SELECT event_id, CASE event_type WHEN 'error' THEN 'That username is already taken.' WHEN 'signup' THEN 'Username does not match the required public format.'
ELSE 'Profile update failed. Please try again.' END AS shown FROM events"""
ORACLE_SQL["default_names"] = """SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN left(repeat(c_name, 9), 120) ELSE c_mktsegment END AS display_name FROM customer"""
ORACLE_SQL["stage_changes"] = """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT 'u' || user_id AS key, CASE WHEN user_id % 13 = 5 THEN 'added' ELSE 'changed' END AS change FROM u WHERE user_id % 13 = 5 OR user_id % 11 = 3 AND n > 3
UNION ALL SELECT 's' || n_nationkey, CASE WHEN n_nationkey = 3 THEN 'added' ELSE 'changed' END FROM nation WHERE n_nationkey IN (3, 4, 9)"""
ORACLE_SQL["incremental_matches"] = f"{FULL} SELECT activity_key, segment_key, match_key, classification, samples, covered, coverage{ORACLE_SQL['classify_matches'].rpartition('blocked')[2]}"
_PARTS = "SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 0"
ORACLE_SQL["match_references"] = f"""WITH s AS ({_PARTS}), i AS (SELECT 'segment_not_accepted' AS rule, p_partkey::VARCHAR AS k FROM s WHERE p_size % 7 = 0
UNION ALL SELECT 'start_junction_not_accepted', p_partkey::VARCHAR FROM s WHERE p_size % 11 = 0 UNION ALL SELECT 'end_junction_not_accepted', p_partkey::VARCHAR FROM s WHERE p_size % 13 = 0
UNION ALL SELECT 'construction_version', p_partkey::VARCHAR FROM s WHERE p_size >= 45
UNION ALL SELECT 'unknown_activity', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
UNION ALL SELECT 'unknown_segment', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM s)
UNION ALL SELECT 'duplicate_pair', l_orderkey || '|' || l_partkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)
SELECT rule, rule || ':' || k AS message, count(*) AS n FROM i GROUP BY ALL"""
_NAMED = "CASE WHEN p_partkey % 5 <> 0 THEN p_name END"
ORACLE_SQL["paged_features"] = f"SELECT p_partkey + 1 AS source_index, p_partkey::VARCHAR AS id, {_NAMED} AS trail_name, p_size::DOUBLE AS gis_miles, p_size::DOUBLE AS x1, 45.5e0 AS y2 FROM part WHERE p_partkey % 17 <> 0 AND p_size BETWEEN 9 AND 30"
ORACLE_SQL["staging_summary"] = f"""SELECT count(*) FILTER (ok) AS features, count(n) FILTER (ok) AS named, count(*) FILTER (ok AND n IS NULL) AS unnamed, count(DISTINCT n) FILTER (ok) AS unique_names,
sum(p_size) FILTER (ok)::DOUBLE AS gis_miles, count(*) FILTER (NOT ok) AS skipped FROM (SELECT p_size, {_NAMED} AS n, p_partkey % 17 <> 0 AS ok FROM part)"""
#: The damage to published segments that remainders 0, 1, ... by 64 stand for, by the rule that finds it.
_BROKEN = """data_status verification_status completed trail_trail_name trail_region candidate_provider candidate_ids candidate_miles candidate_line
production_key_unstable provenance_item_key provenance_start_key provenance_end_key provenance_version provenance_lineage source_metres
source_modification decision_differs trail_decision_differs upstream_start_not_accepted upstream_end_target""".split()
ORACLE_SQL["network_issues"] = "SELECT 'segment_' || rule AS rule, 'segment_' || rule || ':' || p_partkey AS message FROM part JOIN (VALUES " + ", ".join(f"({k}, '{r}')" for k, r in enumerate(_BROKEN)) + ") d(k, rule) ON p_partkey % 64 = k"
ORACLE_SQL["guarded_decisions"] = """SELECT o_orderkey, 'a' || o_orderkey AS "activityKey", CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' ELSE 'needs_review' END AS decision, CASE WHEN o_orderkey % 5 = 1 THEN 'seen' END AS notes
FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 11 <> 0)"""
