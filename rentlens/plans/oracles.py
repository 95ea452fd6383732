"""The same results as ``queries.QUERIES`` in plain DuckDB SQL, written from the definitions."""

from __future__ import annotations

from ..schemas import MODE_IDS
from .views import oracle

_RENT = """CASE frequency WHEN 'monthly' THEN CAST(amount AS DOUBLE) WHEN 'weekly' THEN CAST(amount AS DOUBLE) * 52 / 12
  WHEN 'daily' THEN CAST(amount AS DOUBLE) * 365 / 12 WHEN 'yearly' THEN CAST(amount AS DOUBLE) / 12 END"""
_SQFT = "CASE WHEN display_size LIKE '% sq. ft.' THEN CAST(replace(replace(display_size, ' sq. ft.', ''), ',', '') AS INTEGER) END"
_SQM = f"CAST(trunc(CAST({_SQFT} AS DOUBLE) * 0.092903::DOUBLE) AS INTEGER)"
_DAYS = "CAST(floor((epoch_us(TIMESTAMP '2000-01-01 12:00:00') - epoch_us(first_visible_date)) / 86400000000.0) AS BIGINT)"
_IN_BOX = "longitude >= min_lon AND longitude < max_lon AND latitude >= min_lat AND latitude < max_lat"

_RULES = {
    "residential": ("commercial OR development OR students OR auction", "'not a residential letting'"),
    "has_price": ("amount IS NULL", "'no price'"),
    "min_area": (f"{_SQM} < 40", f"'too small: ' || {_SQFT} || ' sq. ft.'"),
    "available": ("let_agreed", "'let agreed'"),
    "max_rent": (f"coalesce(nullif({_RENT}, 0), 'infinity'::DOUBLE) > 2200", "'too expensive: ' || amount || ' ' || frequency"),
    "recent": (f"{_DAYS} > 900", f"'added ' || {_DAYS} || ' days ago'"),
}


def _case(names, part: int) -> str:
    branches = " ".join(
        f"WHEN {_RULES[n][0]} THEN " + (f"'{n}'" if part == 0 else _RULES[n][1]) for n in names
    )
    return f"CASE {branches} END"


def _classified(names=tuple(_RULES)) -> str:
    return f"SELECT *, {_case(names, 0)} AS skip_rule, {_case(names, 1)} AS skip_reason FROM wl_listings"


_MEANS = f"""means AS (SELECT region, avg({_RENT}) AS mean_rent, count({_RENT}) AS priced,
  CAST(count(*) - count({_RENT}) AS BIGINT) AS unpriced
  FROM wl_listings JOIN wl_regions ON {_IN_BOX} GROUP BY region HAVING count({_RENT}) > 0)"""
_RENT_BY_REGION = f"WITH {_MEANS} SELECT region, round(mean_rent, 6) AS mean_rent, priced, unpriced FROM means"

_COMMUTE = """SELECT l.id, coalesce(r.n, 0) = (SELECT count(DISTINCT name) FROM wl_places) AS commute_ok FROM wl_listings l
  LEFT JOIN (SELECT id, count(DISTINCT name) AS n FROM (SELECT id, name, min(duration) AS d FROM wl_journeys GROUP BY id, name)
    WHERE d <= 45 AND name IN (SELECT name FROM wl_places) GROUP BY id) r ON r.id = l.id"""

_DISTANCE = "sqrt((latitude - 51.5e0) * (latitude - 51.5e0) + (longitude + 0.5e0) * (longitude + 0.5e0))"
_SEARCH_ORDER = {
    "lowest_price": "monthly_rent ASC NULLS LAST", "highest_price": "monthly_rent DESC NULLS LAST",
    "nearest_first": "distance ASC", "most_recent": "first_visible_date DESC", "oldest_listed": "first_visible_date ASC",
}


def _search(order: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY {order}, id) AS INTEGER) AS row_no, id, round(monthly_rent, 6) AS monthly_rent,
  round(distance, 6) AS distance, first_visible_date FROM (SELECT *, {_RENT} AS monthly_rent, {_DISTANCE} AS distance FROM wl_listings)
WHERE bedrooms BETWEEN 2 AND 4 AND bathrooms BETWEEN 1 AND 3 AND monthly_rent BETWEEN 1000 AND 6000
  AND property_type IN ('flat', 'detached', 'semi-detached', 'terraced') AND NOT let_agreed AND NOT students
  AND first_visible_date >= TIMESTAMP '2000-01-01 12:00:00' - INTERVAL 900 DAY
ORDER BY {order}, id LIMIT 1008"""


_STATIONS = """SELECT s_suppkey AS station_id, s_name AS name, s_suppkey || ' Station Road' AS address,
  CAST('-0.' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS DOUBLE) AS longitude, CAST('51.' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS DOUBLE) AS latitude,
  CASE WHEN s_suppkey % 2 = 0 THEN 12.5e0 ELSE 0e0 END AS altitude FROM supplier"""
_DEFAULT_MATCH = """bedrooms BETWEEN 1 AND 10 AND bathrooms BETWEEN 1 AND 5
  AND property_type IN ('flat', 'detached', 'semi-detached', 'terraced') AND NOT students"""
_MILES = """2 * 3958.7613e0 * asin(sqrt(least(1e0, sin((radians(p.latitude) - radians(l.latitude)) / 2) ** 2
  + cos(radians(l.latitude)) * cos(radians(p.latitude)) * sin((radians(p.longitude) - radians(l.longitude)) / 2) ** 2)))"""
_LOOKUP = """found AS (SELECT q.query, p.name, p.identifier,
    CASE WHEN lower(p.name) = lower(trim(q.query)) THEN 0 WHEN starts_with(lower(p.name), lower(trim(q.query))) THEN 1 ELSE 2 END AS match_class
  FROM wl_lookups q JOIN wl_search_places p ON contains(lower(p.name), lower(trim(q.query))) WHERE trim(q.query) <> ''),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY match_class, name, identifier) AS INTEGER) AS rank FROM found)"""

# Postcode codes. The text has no space inside once packed; the last three characters are inward.
_PACKED = "replace(upper(trim(postcode)), ' ', '')"
_CODES = f"""codes AS (SELECT *, left(packed, greatest(length(packed) - 3, 0)) AS outward, right(packed, 3) AS inward
  FROM (SELECT *, {_PACKED} AS packed FROM wl_postcodes)),
valid AS (SELECT *, regexp_extract(outward, '^(.*[0-9])', 1) AS district, regexp_extract(outward, '^(.*[0-9].?)', 1) AS longer FROM codes
  WHERE length(inward) = 3 AND length(outward) BETWEEN 2 AND 4 AND regexp_matches(outward, '^[A-Z]')
    AND regexp_matches(outward, '[0-9]') AND regexp_matches(inward, '^[0-9]')),
parts AS (SELECT *, outward || ' ' || inward AS canonical, regexp_extract(packed, '^([^0-9]*)', 1) AS area,
  CASE WHEN longer <> district THEN longer END AS sub_district, outward || ' ' || left(inward, 1) AS sector,
  right(packed, 2) AS unit FROM valid)"""
_PROBLEM = """CASE WHEN length(inward) <> 3 THEN 'inward length' WHEN length(outward) NOT BETWEEN 2 AND 4 THEN 'outward length'
  WHEN NOT regexp_matches(outward, '^[A-Z]') THEN 'outward start' WHEN NOT regexp_matches(outward, '[0-9]') THEN 'outward digit'
  WHEN NOT regexp_matches(inward, '^[0-9]') THEN 'inward start'"""

_SITES = "sites AS (SELECT min(site_key) AS site_id, longitude AS x, latitude AS y FROM wl_postcodes GROUP BY longitude, latitude)"
# 0.1 is the margin of the envelope around the sites.
_ENVELOPE_AREA = """(SELECT (max(x) - min(x) + 2 * g) * (max(y) - min(y) + 2 * g) FROM sites,
  (SELECT 0.1 * greatest(max(x) - min(x), max(y) - min(y)) AS g FROM sites) GROUP BY g)"""

# Cells by definition: the envelope cut by the bisector to every other site, nearest first,
# until the next is twice as far as the farthest corner. ``s`` is the signed side of each corner.
_SIDE = "((v.x - (c.x + p.ox) / 2) * (p.ox - c.x) + (v.y - (c.y + p.oy) / 2) * (p.oy - c.y))"
_NEXT = "k % len(ring) + 1"
_CELLS = f"""grow AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
    0.1e0 * greatest(max(x) - min(x), max(y) - min(y)) AS g FROM sites),
pairs AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY d2, ox, oy) AS n FROM (
    SELECT a.site_id, b.x AS ox, b.y AS oy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
    FROM sites a JOIN sites b ON a.site_id <> b.site_id)),
clip AS (SELECT site_id, x, y, CAST(0 AS BIGINT) AS n, [{{'x': x0 - g, 'y': y0 - g}}, {{'x': x1 + g, 'y': y0 - g}},
    {{'x': x1 + g, 'y': y1 + g}}, {{'x': x0 - g, 'y': y1 + g}}] AS ring FROM sites, grow
  UNION ALL
  SELECT site_id, x, y, n, flatten(list_transform(range(1, len(ring) + 1), lambda k:
      CASE WHEN s[k] <= 0 THEN [ring[k]] ELSE [] END || CASE WHEN (s[k] <= 0) <> (s[{_NEXT}] <= 0) THEN
        [{{'x': ring[k].x + s[k] / (s[k] - s[{_NEXT}]) * (ring[{_NEXT}].x - ring[k].x),
          'y': ring[k].y + s[k] / (s[k] - s[{_NEXT}]) * (ring[{_NEXT}].y - ring[k].y)}}] ELSE [] END)) AS ring
  FROM (SELECT c.site_id, c.x, c.y, p.n, c.ring, list_transform(c.ring, lambda v: {_SIDE}) AS s
    FROM clip c JOIN pairs p ON p.site_id = c.site_id AND p.n = c.n + 1
    WHERE p.d2 < 4 * list_max(list_transform(c.ring, lambda v: (v.x - c.x) * (v.x - c.x) + (v.y - c.y) * (v.y - c.y))))),
cells AS (SELECT site_id, any_value(x) AS x, any_value(y) AS y, arg_max(ring, n) AS ring FROM clip GROUP BY site_id)"""
_AREA = f"""round(abs(list_sum(list_transform(range(1, len(ring) + 1), lambda k:
  ring[k].x * ring[{_NEXT}].y - ring[{_NEXT}].x * ring[k].y))) / 2 * 1e6, 3) AS area"""
_BORDER = f"""round(list_sum(list_transform(range(1, len(ring) + 1), lambda k: sqrt((ring[k].x - ring[{_NEXT}].x) ** 2
  + (ring[k].y - ring[{_NEXT}].y) ** 2))), 6) AS border"""

_TILES = """boxes AS (SELECT region, min_lon, min_lat, max_lon, max_lat FROM wl_regions),
inside AS (SELECT id, region, min_lon, min_lat, max_lon, max_lat,
    CAST(least(greatest(floor((longitude - min_lon) / (max_lon - min_lon) * 64e0), 0), 63) AS BIGINT) AS x,
    CAST(least(greatest(floor((latitude - min_lat) / (max_lat - min_lat) * 64e0), 0), 63) AS BIGINT) AS y
  FROM wl_listings JOIN boxes ON longitude BETWEEN min_lon AND max_lon AND latitude BETWEEN min_lat AND max_lat),
depths AS (SELECT unnest(range(0, 7)) AS depth),
counts AS (SELECT region, depth, x >> (6 - depth)::BIGINT AS ix, y >> (6 - depth)::BIGINT AS iy, count(*) AS n
  FROM inside, depths GROUP BY ALL),
tiles AS (SELECT c.* FROM counts c LEFT JOIN counts p ON p.region = c.region AND p.depth = c.depth - 1
    AND p.ix = c.ix >> 1 AND p.iy = c.iy >> 1
  WHERE (c.depth = 0 OR p.n > 120) AND (c.n <= 120 OR c.depth = 6))"""

_MODES = "[" + ", ".join(f"'{m}'" for m in MODE_IDS) + "]"


def _mode(shift: int) -> str:
    return f"{_MODES}[CAST((l_partkey + {shift}) % {len(MODE_IDS)} + 1 AS BIGINT)]"


def _minutes(shift: int) -> str:
    return f"CAST(5 + (l_suppkey * 7 + l_linenumber + {shift}) % 40 AS INTEGER)"


_LINE = "l_orderkey AS id, l_linenumber AS line, l_partkey AS part"
_LEGS = """legs AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 1), (1, 0, 2)) t(position, leg_no, shift))"""

_BODIES = {
    "rent_by_region": _RENT_BY_REGION,
    "region_files": _RENT_BY_REGION,
    "assign_regions": f"SELECT id, region FROM wl_listings JOIN wl_regions ON {_IN_BOX}",
    # Inside a diamond: the sum of the distances to its middle is below its half diagonal.
    "assign_regions_diamond": """SELECT region, count(*) AS listings, CAST(sum(id) AS BIGINT) AS id_sum
FROM wl_listings JOIN wl_regions ON abs(longitude - (min_lon + max_lon) / 2) + abs(latitude - (min_lat + max_lat) / 2) < 0.2003e0
GROUP BY region""",
    # United, the hole's area counts as inside; counted together, it is outside.
    "assign_regions_holed": f"""WITH t AS (SELECT *, longitude >= min_lon + 0.05e0 AND longitude < max_lon - 0.05e0
    AND latitude >= min_lat + 0.05e0 AND latitude < max_lat - 0.05e0 AS in_hole FROM wl_listings JOIN wl_regions ON {_IN_BOX})
SELECT region, 'union' AS rule, count(*) AS listings, CAST(sum(id) AS BIGINT) AS id_sum FROM t GROUP BY region
UNION ALL SELECT region, 'even_odd', count(*), CAST(sum(id) AS BIGINT) FROM t WHERE NOT in_hole GROUP BY region""",
    "rent_map_table": f"""WITH {_MEANS}, cap AS (SELECT least(max(mean_rent), 2000e0) AS cap FROM means)
SELECT r.region, round(m.mean_rent, 6) AS mean_rent, CASE WHEN m.mean_rent IS NOT NULL THEN round(least(m.mean_rent / cap, 1e0), 6) END AS shade,
  CASE WHEN m.mean_rent IS NULL THEN r.region ELSE r.region || chr(10) || '£' || format('{{:.2f}}', m.mean_rent) || ' pcm' END AS label
FROM wl_regions r LEFT JOIN means m ON m.region = r.region, cap""",
    "rent_range": f"""WITH {_MEANS} SELECT round(min(mean_rent), 6) AS min_price, round(max(mean_rent), 6) AS observed_max,
  round(least(max(mean_rent), 2000e0), 6) AS max_price FROM means HAVING count(*) > 0""",
    "bounding_boxes": """WITH t AS (SELECT *, CAST(CAST(min_lon AS DECIMAL(9,6)) AS VARCHAR) AS w, CAST(CAST(max_lon AS DECIMAL(9,6)) AS VARCHAR) AS e,
  CAST(CAST(min_lat AS DECIMAL(9,6)) AS VARCHAR) AS s, CAST(CAST(max_lat AS DECIMAL(9,6)) AS VARCHAR) AS n FROM wl_regions)
SELECT region, min_lon AS min_x, min_lat AS min_y, max_lon AS max_x, max_lat AS max_y,
  w || ' ' || s || ',' || e || ' ' || s || ',' || e || ' ' || n || ',' || w || ' ' || n || ',' || w || ' ' || s AS box FROM t""",
    "orient_clockwise": """WITH t AS (SELECT *, CAST(CAST(min_lon AS DECIMAL(9,6)) AS VARCHAR) AS w, CAST(CAST(max_lon AS DECIMAL(9,6)) AS VARCHAR) AS e,
  CAST(CAST(min_lat AS DECIMAL(9,6)) AS VARCHAR) AS s, CAST(CAST(max_lat AS DECIMAL(9,6)) AS VARCHAR) AS n FROM wl_regions)
SELECT region, w || ' ' || s || ',' || w || ' ' || n || ',' || e || ' ' || n || ',' || e || ' ' || s || ',' || w || ' ' || s AS ring FROM t""",
    "region_edges": """SELECT region, 0 AS edge_no, min_lon AS x1, min_lat AS y1, max_lon AS x2, min_lat AS y2 FROM wl_regions
UNION ALL SELECT region, 1, max_lon, min_lat, max_lon, max_lat FROM wl_regions
UNION ALL SELECT region, 2, max_lon, max_lat, min_lon, max_lat FROM wl_regions
UNION ALL SELECT region, 3, min_lon, max_lat, min_lon, min_lat FROM wl_regions""",
    "monthly_rent": f"SELECT id, round({_RENT}, 6) AS monthly_rent FROM wl_listings",
    "floor_area": f"SELECT id, CAST({_SQFT} AS DOUBLE) AS square_feet, CAST({_SQM} AS DOUBLE) AS square_metres FROM wl_listings",
    **{f"rule_{n}": f"SELECT id, skip_rule, skip_reason FROM ({_classified((n,))})" for n in _RULES},
    "classify": f"SELECT id, skip_rule, skip_reason FROM ({_classified()})",
    "suitable": f"SELECT id, amount, frequency FROM ({_classified()}) WHERE skip_rule IS NULL",
    "stream_suitable_listings": f"""SELECT id, amount, frequency FROM ({_classified()})
WHERE skip_rule IS NULL AND id NOT IN (SELECT id FROM wl_history)""",
    "funnel": f"""SELECT coalesce(skip_rule, 'accepted') AS outcome, count(*) AS listings FROM ({_classified()})
WHERE id NOT IN (SELECT id FROM wl_history) GROUP BY 1""",
    "exclude_seen": "SELECT id FROM wl_listings WHERE id NOT IN (SELECT id FROM wl_history)",
    "drop_let_agreed": "SELECT id FROM wl_listings WHERE id NOT IN (SELECT id FROM wl_history WHERE let_agreed)",
    "price_caps": f"""SELECT r.region AS name, coalesce(c.cap, 2200) AS cap, count(*) AS listings,
  CAST(count(*) FILTER (WHERE coalesce(nullif({_RENT}, 0), 'infinity'::DOUBLE) <= coalesce(c.cap, 2200)) AS BIGINT) AS within_cap
FROM wl_listings JOIN wl_regions r ON {_IN_BOX} LEFT JOIN wl_caps c ON c.name = r.region GROUP BY 1, 2""",
    "suitable_with_commute": f"""WITH ok AS ({_COMMUTE})
SELECT t.id, CASE WHEN skip_rule IS NOT NULL THEN skip_rule WHEN NOT commute_ok THEN 'commute' END AS skip_rule,
  CASE WHEN skip_rule IS NOT NULL THEN skip_reason WHEN NOT commute_ok THEN 'commute too long' END AS skip_reason
FROM ({_classified()}) t JOIN ok ON ok.id = t.id WHERE t.id NOT IN (SELECT id FROM wl_history)""",
    "commute_ok": _COMMUTE,
    "accepted_listings": f"""WITH ok AS ({_COMMUTE}), a AS (SELECT t.id, {_DISTANCE} AS d, coalesce(-epoch_us(first_visible_date), 0) AS recency_key
  FROM ({_classified()}) t JOIN ok ON ok.id = t.id WHERE skip_rule IS NULL AND commute_ok AND t.id NOT IN (SELECT id FROM wl_history))
SELECT row_number() OVER (ORDER BY d, recency_key, id) AS rank, id, round(d, 6) AS distance, recency_key FROM a""",
    "best_journeys": """SELECT id, name, duration, position, mode FROM wl_journeys
QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY duration, position, tie, mode) = 1""",
    "od_pairs": """SELECT l.id, l.latitude AS src_lat, l.longitude AS src_lon, p.name, p.latitude AS dst_lat, p.longitude AS dst_lon
FROM wl_listings l CROSS JOIN wl_places p""",
    "missing_pairs": """SELECT l.id, p.name FROM wl_listings l CROSS JOIN wl_places p
WHERE NOT EXISTS (SELECT 1 FROM wl_journeys j WHERE j.id = l.id AND j.name = p.name)""",
    "gate_places": """WITH reach AS (SELECT station, count(DISTINCT name) AS n FROM wl_journeys WHERE duration <= 16 GROUP BY station)
SELECT s.position AS station, s.name, s.identifier FROM wl_search_places s LEFT JOIN reach r ON r.station = s.position
WHERE NOT starts_with(s.identifier, 'STATION^') OR coalesce(r.n, 0) = (SELECT count(*) FROM wl_places)""",
    "target_arrival": """WITH t AS (SELECT id, first_visible_date + to_minutes(id % 1440) AS as_of FROM wl_listings),
d AS (SELECT *, CAST(timezone('Europe/London', timezone('UTC', as_of)) AS DATE) + 1 AS tomorrow FROM t),
w AS (SELECT *, tomorrow + CASE isodow(tomorrow) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS day FROM d),
a AS (SELECT *, timezone('UTC', timezone('Europe/London', CAST(day AS TIMESTAMP) + INTERVAL 9 HOUR)) AS target_arrival FROM w)
SELECT id, as_of, target_arrival, strftime(target_arrival, '%Y%m%d') AS arrival_date, strftime(target_arrival, '%H%M') AS arrival_time FROM a""",
    "latest_per_listing": """SELECT * FROM wl_snapshots
QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_ts DESC, tie1, tie2, tie3, amount) = 1""",
    "stream_latest_per_listing": """SELECT * FROM wl_snapshots
QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_ts DESC, tie1, tie2, tie3, amount) = 1""",
    "stream_new_ids": "SELECT DISTINCT id FROM wl_snapshots",
    "stream_unseen_ids": "SELECT DISTINCT id FROM wl_snapshots WHERE id NOT IN (SELECT id FROM wl_history)",
    "append_unseen": """SELECT id, let_agreed FROM wl_history
UNION ALL SELECT id, let_agreed FROM wl_listings WHERE id NOT IN (SELECT id FROM wl_history)""",
    "merge_journeys": """WITH o AS (SELECT id, name, min(duration) AS d FROM wl_journeys WHERE position <= 4 GROUP BY id, name),
n AS (SELECT id, name, min(duration) AS d FROM wl_journeys WHERE position >= 3 GROUP BY id, name)
SELECT id, name, coalesce(n.d, o.d) AS duration, CASE WHEN n.d IS NULL THEN 'kept' WHEN o.d IS NULL THEN 'new'
  WHEN n.d = o.d THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n USING (id, name)""",
    "journey_updates": """WITH o AS (SELECT id, name, min(duration) AS d FROM wl_journeys WHERE position <= 4 GROUP BY id, name),
n AS (SELECT id, name, min(duration) AS d FROM wl_journeys WHERE position >= 3 GROUP BY id, name)
SELECT id, name, CASE WHEN n.d IS NOT NULL AND id % 50 = 0 THEN n.d + 1 ELSE coalesce(n.d, o.d) END AS duration,
  n.d IS NOT NULL AND id % 50 = 0 AS late FROM o FULL JOIN n USING (id, name)""",
    "changed_journeys": """WITH o AS (SELECT id, name, min(duration) AS d FROM wl_journeys WHERE position <= 4 GROUP BY id, name),
n AS (SELECT id, name, min(duration) AS d FROM wl_journeys WHERE position >= 3 GROUP BY id, name)
SELECT id, name, n.d AS duration, CASE WHEN o.d IS NULL THEN 'new' ELSE 'changed' END AS change
FROM n LEFT JOIN o USING (id, name) WHERE o.d IS NULL OR o.d <> n.d""",
    "merge_places": """WITH k AS (SELECT 'P' || position AS name, identifier, position FROM wl_search_places),
added AS (SELECT name, row_number() OVER (ORDER BY name) - 1 + (SELECT max(position) + 1 FROM k WHERE position % 3 <> 0) AS place
  FROM k WHERE position % 3 = 0)
SELECT k.name, CASE WHEN position % 2 = 0 OR position % 3 = 0 THEN 'REGION^' || position ELSE identifier END AS identifier,
  CAST(coalesce(place, position) AS DOUBLE) AS position,
  CASE WHEN position % 3 = 0 THEN 'new' WHEN position % 2 = 0 THEN 'replaced' ELSE 'kept' END AS change
FROM k LEFT JOIN added ON added.name = k.name""",
    "lookup": f"""WITH {_LOOKUP} SELECT query, rank, name, identifier, match_class,
  regexp_replace(name, '(' || trim(query) || ')', '[\\1]', 'gi') AS marked FROM ranked WHERE rank <= 20""",
    "ambiguous_places": f"""WITH {_LOOKUP}, top AS (SELECT * FROM ranked WHERE rank <= 20)
SELECT query, rank, identifier FROM top WHERE query IN (SELECT query FROM top GROUP BY query HAVING count(*) > 1)""",
    **{f"search_{sort}": _search(order) for sort, order in _SEARCH_ORDER.items()},
    "place_results": f"""WITH t AS (SELECT l.*, p.name, coalesce(c.cap, 2200) AS cap, {_MILES} AS miles, {_RENT} AS rent
    FROM wl_listings l CROSS JOIN wl_places p LEFT JOIN wl_place_caps c ON c.name = p.name),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY miles, id) AS INTEGER) AS row_no FROM t
  WHERE miles <= 12 AND rent <= cap AND {_DEFAULT_MATCH} AND NOT let_agreed)
SELECT name, row_no, CAST((row_no - 1) // 24 AS INTEGER) AS page_no, id, round(miles, 6) AS miles_away, cap FROM r WHERE row_no <= 1008""",
    "search_keywords": f"""SELECT id, round({_RENT}, 6) AS monthly_rent FROM wl_listings WHERE {_DEFAULT_MATCH} AND NOT let_agreed
  AND id % 6 <> 0 AND id % 10 <> 0 AND id % 2 = 0 AND id % 7 <> 0 AND id % 4 < 2""",
    "search_pages": f"""WITH t AS (SELECT id, CAST(row_number() OVER (ORDER BY first_visible_date DESC, id) AS INTEGER) AS row_no
  FROM wl_listings WHERE {_DEFAULT_MATCH} AND NOT let_agreed)
SELECT row_no, CAST((row_no - 1) // 24 AS INTEGER) AS page_no, CAST((row_no - 1) // 24 * 24 AS INTEGER) AS page_index, id FROM t WHERE row_no <= 1008""",
    "map_page": f"SELECT id, latitude, longitude FROM wl_listings WHERE {_DEFAULT_MATCH} ORDER BY first_visible_date DESC, id LIMIT 499",
    "map_total": f"SELECT count(*) AS total FROM wl_listings WHERE {_DEFAULT_MATCH}",
    "by_ids": "SELECT id, CAST(amount AS DOUBLE) AS amount, property_type FROM wl_listings WHERE id IN (SELECT id FROM wl_history WHERE let_agreed)",
    "within_miles": f"""SELECT id, name, round(m, 6) AS miles_away FROM (SELECT l.id, p.name, {_MILES} AS m FROM wl_listings l CROSS JOIN wl_places p)
WHERE m <= 5""",
    "area_ids": f"""SELECT id FROM (SELECT l.id, {_MILES} AS m FROM wl_listings l CROSS JOIN wl_places p) WHERE m <= 5
UNION SELECT id FROM wl_history""",
    "within_area": f"""SELECT id, region AS name, 0e0 AS miles_away FROM wl_listings JOIN wl_regions ON {_IN_BOX}
WHERE region IN (SELECT name FROM wl_caps)""",
    "rank_for_review": f"SELECT id, round({_DISTANCE}, 6) AS distance, coalesce(-epoch_us(first_visible_date), 0) AS recency_key, row_number() OVER (ORDER BY {_DISTANCE}, coalesce(-epoch_us(first_visible_date), 0), id) AS rank FROM wl_listings",
    "review_sheet": """SELECT id, 'advert' AS kind, CAST(NULL AS VARCHAR) AS place, 'https://listings.example/properties/' || id AS link
FROM wl_listings WHERE id % 9 <> 0
UNION ALL SELECT l.id, 'route', p.name, 'https://www.google.com/maps/dir/?api=1&origin=' || p.latitude || '%2C' || p.longitude
  || '&destination=' || l.latitude || '%2C' || l.longitude || '&travelmode=transit' FROM wl_listings l CROSS JOIN wl_places p""",
    "postcode_hierarchy": f"""WITH {_CODES} SELECT site_key, canonical, outward, inward, area, district, sub_district, sector, unit FROM parts""",
    # A four-character outward code puts the space fifth, which only the strict check minds.
    "postcode_validity": f"""WITH {_CODES} SELECT site_key, {_PROBLEM} END AS lax_problem,
  {_PROBLEM} WHEN length(outward) = 4 THEN 'position' END AS strict_problem FROM codes""",
    "postcode_rollup": f"""WITH {_CODES}, g AS (SELECT area, district, sub_district, sector, canonical, latitude FROM parts),
s AS (SELECT 'area' AS level, area AS code, latitude FROM g UNION ALL SELECT 'district', district, latitude FROM g
  UNION ALL SELECT 'sub_district', sub_district, latitude FROM g WHERE sub_district IS NOT NULL
  UNION ALL SELECT 'sector', sector, latitude FROM g UNION ALL SELECT 'postcode', canonical, latitude FROM g)
SELECT level, code, count(*) AS sites, round(avg(latitude), 6) AS mean_latitude FROM s GROUP BY level, code""",
    "distinct_sites": """SELECT longitude AS x, latitude AS y, min(postcode) AS first_code, count(DISTINCT postcode) AS n_codes
FROM wl_postcodes GROUP BY longitude, latitude""",
    "site_fan_out": """SELECT postcode, longitude AS x, latitude AS y, min(postcode) OVER (PARTITION BY longitude, latitude) AS first_code
FROM wl_postcodes""",
    "postcode_directory": f"""WITH {_CODES} SELECT outward || ' ' || inward AS postcode,
  CAST(CAST(round(latitude, 6) AS DECIMAL(9,6)) AS DOUBLE) AS latitude, CAST(CAST(round(longitude, 6) AS DECIMAL(9,6)) AS DOUBLE) AS longitude FROM codes
WHERE site_key % 5 <> 4 AND site_key % 23 <> 0 AND site_key % 11 <> 0 AND site_key % 13 <> 0 AND site_key % 17 <> 0
  AND site_key % 19 <> 0 AND site_key % 37 BETWEEN 1 AND 33""",
    "nearest_site": f"""WITH {_SITES}, d AS (SELECT l.id, s.site_id,
  (l.longitude - s.x) * (l.longitude - s.x) + (l.latitude - s.y) * (l.latitude - s.y) AS d2 FROM wl_listings l CROSS JOIN sites s),
best AS (SELECT id, min(d2) AS d2 FROM d GROUP BY id)
SELECT d.id, min(d.site_id) AS site_id, round(sqrt(any_value(d.d2)), 6) AS site_distance
FROM d JOIN best ON best.id = d.id AND best.d2 = d.d2 GROUP BY d.id""",
    "site_cells": f"WITH RECURSIVE {_SITES}, {_CELLS} SELECT site_id, {_BORDER} FROM cells",
    "rings": f"WITH RECURSIVE {_SITES}, {_CELLS} SELECT site_id, {_AREA}, true AS closed FROM cells",
    "postcode_rings": f"""WITH RECURSIVE {_CODES},
sites AS (SELECT min(site_key) AS site_id, longitude AS x, latitude AS y FROM parts GROUP BY longitude, latitude), {_CELLS}
SELECT p.postcode AS region, {_AREA} FROM parts p JOIN cells c ON c.x = p.longitude AND c.y = p.latitude""",
    "cell_cover": f"""WITH {_SITES} SELECT count(*) AS cells, round({_ENVELOPE_AREA}, 6) AS area, count(*) AS clockwise, count(*) AS closed FROM sites""",
    "adaptive_tiles": f"""WITH {_TILES} SELECT t.region, CAST(depth AS INTEGER) AS depth, ix, iy, n, n > 120 AS overflow,
  round(min_lon + ix * ((max_lon - min_lon) / 2e0 ** depth), 6) AS tile_min_x, round(min_lat + iy * ((max_lat - min_lat) / 2e0 ** depth), 6) AS tile_min_y,
  round(min_lon + (ix + 1) * ((max_lon - min_lon) / 2e0 ** depth), 6) AS tile_max_x, round(min_lat + (iy + 1) * ((max_lat - min_lat) / 2e0 ** depth), 6) AS tile_max_y
FROM tiles t JOIN boxes b ON b.region = t.region""",
    "tile_ids": f"WITH {_TILES} SELECT DISTINCT id FROM inside",
    "batch_keys": """WITH t AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 25 AS batch_no FROM (SELECT DISTINCT id FROM wl_listings))
SELECT batch_no, count(*) AS n_keys, min(id) AS first_key, max(id) AS last_key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS keys
FROM t GROUP BY batch_no""",
    "listing_records": """SELECT id, bedrooms, CAST(bathrooms AS DOUBLE) AS bathrooms, CAST(amount AS DOUBLE) AS amount, CASE WHEN amount IS NOT NULL THEN frequency END AS frequency, latitude, longitude,
  let_agreed, students, display_size, property_type, epoch_us(first_visible_date) AS first_visible_micros FROM wl_listings""",
    "snapshot_files": """SELECT id, CAST(tie1 AS BIGINT) AS snapshot_ts, amount FROM wl_snapshots
QUALIFY row_number() OVER (PARTITION BY id ORDER BY tie1 DESC, amount) = 1""",
    "bad_listings": """SELECT CASE WHEN id % 17 = 0 THEN 'without heading' WHEN id % 19 = 0 THEN 'unreadable' ELSE 'good' END AS problem,
  count(*) AS records FROM wl_listings GROUP BY 1""",
    "broken_json_files": """WITH t AS (
  SELECT id, CASE WHEN floor(id / 4000) % 3 = 1 AND id = max(id) OVER (PARTITION BY floor(id / 4000)) THEN 'unreadable'
    WHEN id % 17 = 0 THEN 'without heading' WHEN id % 19 = 0 THEN 'unreadable' ELSE 'good' END AS problem FROM wl_listings)
SELECT problem, count(*) AS records, CAST(sum(CASE WHEN problem = 'good' THEN id ELSE 0 END) AS BIGINT) AS id_sum FROM t GROUP BY 1""",
    "bad_journeys": """SELECT CASE WHEN l_partkey % 17 = 0 THEN 'without a journey''s times, duration, legs or fare'
  WHEN l_partkey % 19 = 0 THEN 'unreadable' WHEN l_partkey % 23 = 0 THEN 'without a leg''s stop names' ELSE 'good' END AS problem,
  count(*) AS records FROM lineitem GROUP BY 1""",
    "snapshot_json": """SELECT id, CAST(time AS BIGINT) AS snapshot_ts, CAST(time AS INTEGER) AS bedrooms
FROM wl_listings, (SELECT unnest([1, 2, 3]) AS time) WHERE id % time = 0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY time DESC) = 1""",
    "named_maps": """SELECT 'place' AS kind, name, round(latitude, 6) || ' ' || round(longitude, 6) AS value FROM wl_places
UNION ALL SELECT 'cap', name, CAST(cap AS VARCHAR) FROM wl_caps
UNION ALL SELECT 'search', name || ' ' || position, identifier FROM wl_search_places""",
    "region_maps": """SELECT kind, region, round(min_lon, 6) AS min_x, round(min_lat, 6) AS min_y, round(max_lon, 6) AS max_x, round(max_lat, 6) AS max_y
FROM wl_regions, (SELECT unnest(['ring', 'multi']) AS kind)""",
    "location_matches": f"""WITH {_LOOKUP} SELECT identifier, name FROM ranked WHERE rank <= 20""",
    "journey_facts": f"""SELECT {_LINE}, 0 AS position, {_minutes(0)} + {_minutes(1)} AS duration, 2 AS n_legs, CAST(l_partkey % 500 AS INTEGER) AS total_cost,
  {_mode(0)} || ',' || {_mode(1)} AS modes, epoch_us(l_shipdate) AS start_micros FROM lineitem
UNION ALL SELECT {_LINE}, 1, {_minutes(2)}, 1, CAST(l_partkey % 500 AS INTEGER), {_mode(2)}, epoch_us(l_shipdate) FROM lineitem""",
    "leg_facts": f"""WITH {_LEGS} SELECT {_LINE}, position, leg_no, {_mode(0).replace('+ 0', '+ shift')} AS mode,
  {_minutes(0).replace('+ 0', '+ shift')} AS duration, 'Stop ' || l_suppkey AS from_name,
  epoch_us(l_shipdate) AS departure_micros, epoch_us(l_shipdate) - 3600000000 AS arrival_micros FROM lineitem, legs""",
    "step_facts": f"""WITH {_LEGS} SELECT {_LINE}, position, leg_no, 0 AS step_no, 'Walk on' AS description, 'Street ' || l_suppkey AS street_name,
  CAST(l_linenumber * 10 + shift AS INTEGER) AS distance FROM lineitem, legs""",
    "station_dim": _STATIONS,
    "station_feed": _STATIONS,
    "station_lines": """SELECT s_suppkey AS station_id, 'Line ' || s_nationkey AS line FROM supplier WHERE s_suppkey % 4 <> 0
UNION ALL SELECT s_suppkey, 'Second Line' FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 2 = 0""",
    "station_zones": "SELECT s_suppkey AS station_id, CAST(s_suppkey % 6 + 1 AS VARCHAR) AS zone FROM supplier",
    "station_facilities": """SELECT s_suppkey AS station_id, 'Lifts' AS facility, CAST(s_suppkey % 3 AS VARCHAR) AS value FROM supplier
UNION ALL SELECT s_suppkey, 'WiFi', CASE WHEN s_suppkey % 2 = 0 THEN 'yes' ELSE 'no' END FROM supplier""",
    "station_entrances": "SELECT s_suppkey AS station_id, 0 AS entrance_no, 'Main ' || s_suppkey AS entrance, CAST(s_suppkey % 30 AS VARCHAR) AS steps FROM supplier",
    "station_paths": "SELECT s_suppkey AS station_id, 'Platform 1' AS point_name, 'To platform' AS heading, 'Stairs ' || s_suppkey AS path_description FROM supplier",
    "station_trains": "SELECT s_suppkey AS station_id, 'Train ' || s_suppkey AS train FROM supplier",
    "station_hours": "SELECT s_suppkey AS station_id, 'Main ' || s_suppkey AS entrance, 'weekday' AS day_type, '0500' AS from_time, '2330' AS to_time FROM supplier",
}

ORACLES = {name: oracle(body) for name, body in _BODIES.items()}
