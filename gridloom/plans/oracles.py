"""DuckDB SQL for the queries of this package, written apart from them: joins and frames where they use windows and folds."""

from __future__ import annotations

from gridloom.config import BANDS, LABEL_COST, LAND_USE, SOFT_FACTOR
from gridloom.operators.focal import kernel

G = "g AS MATERIALIZED (SELECT CAST(vec_id AS INT) AS row, CAST(unnest(range(len(embedding))) AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) * 1000 AS z FROM embeddings), dim AS MATERIALIZED (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM g)"
P = "p AS MATERIALIZED (SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, 120 + (event_id % 2000) / 1000.0::DOUBLE AS lon, 21.9::DOUBLE + 3.5::DOUBLE * value / 500 AS lat, value AS z, event_id FROM events)"
T = "p AS MATERIALIZED (SELECT path_id, seq, 120 + seq * 0.002::DOUBLE + (event_id % 11) * 0.0002::DOUBLE AS lon, 22 + path_id * 0.01::DOUBLE + 0.004::DOUBLE * value / 500 AS lat, value AS z FROM (SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, value, event_id FROM events))"
W = "WINDOW w AS (PARTITION BY path_id ORDER BY seq)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def cells(source: str, *columns: str) -> str:
    return f"SELECT row, col, {', '.join(f'{r6(c)} AS {c}' for c in columns)} FROM {source}"


def _diff(layer: str, axis: str, cell: float) -> str:
    other = "col" if axis == "row" else "row"
    w = f"OVER (PARTITION BY {other} ORDER BY {axis})"
    return f"(coalesce(lead({layer}) {w}, {layer}) - coalesce(lag({layer}) {w}, {layer})) / ({cell} * ((lead({layer}) {w} IS NOT NULL)::INT + (lag({layer}) {w} IS NOT NULL)::INT))"


def gradients(source: str = "g", name: str = "d", cell: float = 30.0) -> str:
    return f"{name} AS MATERIALIZED (SELECT *, {_diff('z', 'col', cell)} AS dx, {_diff('z', 'row', cell)} AS dy FROM {source})"


SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"


def _place(i: str, n: str, mode: str) -> str:
    if mode == "reflect":
        return f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
    return f"least(greatest({i}, 0), {n} - 1)"


def separable(source: str, layer: str, weights: list[float], out: str, mode: str = "reflect") -> str:
    """CTEs out_k, out_c, out: layer of source filtered along columns, then rows, as column out."""
    k = len(weights) // 2
    values = ", ".join(f"({j - k}, {w!r}::DOUBLE)" for j, w in enumerate(weights))
    return (
        f"{out}_k(o, wt) AS (VALUES {values}), "
        f"{out}_c AS MATERIALIZED (SELECT a.row, a.col, sum(b.{layer} * wt) AS v FROM {source} a, dim, {out}_k JOIN {source} b ON b.row = a.row AND b.col = {_place('a.col + o', 'dim.w', mode)} GROUP BY a.row, a.col), "
        f"{out} AS MATERIALIZED (SELECT a.row, a.col, sum(b.v * wt) AS {out} FROM {out}_c a, dim, {out}_k JOIN {out}_c b ON b.col = a.col AND b.row = {_place('a.row + o', 'dim.h', mode)} GROUP BY a.row, a.col)"
    )


def box(source: str, layer: str, size: int, out: str) -> str:
    return separable(source, layer, [1 / size] * size, out)


def case(code: str, values: dict[int, float], default: float) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


def clip(x: str, lo: float = 0, hi: float = 1) -> str:
    return f"least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE)"


CURVE = gradients() + f", e AS MATERIALIZED (SELECT *, {_diff('dx', 'col', 30.0)} AS dxx, {_diff('dx', 'row', 30.0)} AS dxy, {_diff('dy', 'row', 30.0)} AS dyy, greatest(dx * dx + dy * dy, 1e-6::DOUBLE) AS pp FROM d)"
PROFILE = "-(dxx * dx * dx + 2 * dxy * dx * dy + dyy * dy * dy) / pow(pp, 1.5)"
PLAN = "-(dxx * dy * dy - 2 * dxy * dx * dy + dyy * dx * dx) / pow(pp, 1.5)"
TRI = "abs(z - (9 * m - z) / 8)"

_CODE = "CAST(((floor(z / 25) % 8) + 8) % 8 + 1 AS INT)"
_LABEL_CTE = f"l AS MATERIALIZED (SELECT row, col, z, {_CODE} AS landuse, {SLOPE} AS slope, abs(z) * 10 AS dist_line, abs(z - 50) * 4 AS dist_water FROM d)"
_MASK = "CASE WHEN slope > 45 OR z > 3000 THEN 0 ELSE 1 END"
_LABEL = clip(
    "0.65::DOUBLE * (1 - exp(-dist_line / 2000)) + 0.15::DOUBLE * (CASE WHEN slope > 20 THEN slope / 28 * 1.5 ELSE slope / 28 END)"
    f" + 0.04::DOUBLE * (0.5 * {case('landuse', LABEL_COST, 0.3)} + 0.3 * 0.1::DOUBLE + 0.2 * 0.3::DOUBLE) + 0.02::DOUBLE * 0.3 + 0.02::DOUBLE * 0.3 + 0.08::DOUBLE * exp(-dist_water / 200) + 0.04::DOUBLE * 0.2"
)
_LABELLED = f"WITH {G}, {gradients()}, {_LABEL_CTE}, x AS MATERIALIZED (SELECT *, {_MASK} AS hard_mask, CASE WHEN {_MASK} = 1 THEN {_LABEL} END AS label FROM l)"

_HAV = lambda a, b, c, d: f"CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))) END"
_NEXT = f"n AS MATERIALIZED (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM p {W}), nd AS MATERIALIZED (SELECT *, {_HAV('lon', 'lat', 'lon1', 'lat1')} AS d FROM n)"
_SMOOTH = f"c AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS k FROM p), s AS MATERIALIZED (SELECT path_id, seq, CASE WHEN seq > 2 AND seq <= k - 2 THEN avg(lon) OVER v ELSE lon END AS lon, CASE WHEN seq > 2 AND seq <= k - 2 THEN avg(lat) OVER v ELSE lat END AS lat FROM c WINDOW v AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"


def densified(source: str, name: str, step: float) -> str:
    return (
        f"{name}_n AS (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM {source} {W}), "
        f"{name}_d AS (SELECT *, greatest(1, CAST(floor(({_HAV('lon', 'lat', 'lon1', 'lat1')}) / {step}) AS INT)) AS parts FROM {name}_n WHERE lon1 IS NOT NULL), "
        f"{name}_i AS (SELECT *, unnest(range(1, parts + 1)) AS i FROM {name}_d), "
        f"{name}_a AS (SELECT path_id, seq AS o, i, lon + (lon1 - lon) * i / parts AS lon, lat + (lat1 - lat) * i / parts AS lat FROM {name}_i UNION ALL SELECT path_id, seq, 0, lon, lat FROM (SELECT *, row_number() OVER w AS rn FROM {source} {W}) WHERE rn = 1), "
        f"{name} AS MATERIALIZED (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY o, i) - 1 AS seq, lon, lat FROM {name}_a)"
    )


def nearest(a: str, b: str) -> str:
    return f"(SELECT a.path_id, a.seq, min({_HAV('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS d FROM {a} a JOIN {b} b ON a.path_id = b.path_id GROUP BY a.path_id, a.seq)"


_TURN = "t AS (SELECT path_id, seq, lon - lag(lon) OVER w AS x0, lat - lag(lat) OVER w AS y0, lead(lon) OVER w - lon AS x1, lead(lat) OVER w - lat AS y1, cos(radians(lat)) AS k FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)), u AS MATERIALIZED (SELECT path_id, seq, CASE WHEN sqrt(x0*k*x0*k + y0*y0) * sqrt(x1*k*x1*k + y1*y1) > 0 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (x0*k*x1*k + y0*y1) / (sqrt(x0*k*x0*k + y0*y0) * sqrt(x1*k*x1*k + y1*y1)))))) END AS turn FROM t)"
_CLIMB = """f AS (
  SELECT path_id, seq, z AS last, 0 AS way, z AS low, z AS high, 0.0::DOUBLE AS most FROM p WHERE seq = 1
  UNION ALL
  SELECT q.path_id, q.seq, q.z,
    CASE WHEN abs(q.z - f.last) < 2 THEN f.way WHEN f.way = 0 OR (f.way <> (CASE WHEN q.z > f.last THEN 1 ELSE -1 END) AND f.high - f.low > 50) THEN (CASE WHEN q.z > f.last THEN 1 ELSE -1 END) ELSE f.way END,
    CASE WHEN abs(q.z - f.last) < 2 THEN f.low WHEN f.way <> 0 AND f.way <> (CASE WHEN q.z > f.last THEN 1 ELSE -1 END) AND f.high - f.low > 50 THEN least(f.last, q.z) ELSE least(f.low, q.z) END,
    CASE WHEN abs(q.z - f.last) < 2 THEN f.high WHEN f.way <> 0 AND f.way <> (CASE WHEN q.z > f.last THEN 1 ELSE -1 END) AND f.high - f.low > 50 THEN greatest(f.last, q.z) ELSE greatest(f.high, q.z) END,
    CASE WHEN abs(q.z - f.last) >= 2 AND f.way <> 0 AND f.way <> (CASE WHEN q.z > f.last THEN 1 ELSE -1 END) AND f.high - f.low > 50 THEN greatest(f.most, f.high - f.low) ELSE f.most END
  FROM f JOIN p q ON q.path_id = f.path_id AND q.seq = f.seq + 1),
cl AS (SELECT path_id, CASE WHEN max(seq) > 10 THEN max_by(greatest(most, high - low), seq) ELSE 0.0 END AS climb FROM f GROUP BY path_id)"""
_STATS = f"""{_NEXT}, sd AS (SELECT *, lead(z) OVER w - z AS dz FROM nd {W}),
st AS MATERIALIZED (SELECT path_id, count(*) AS n_vertices, coalesce(sum(d), 0) / 1000 AS length_km, ({_HAV('min_by(lon, seq)', 'min_by(lat, seq)', 'max_by(lon, seq)', 'max_by(lat, seq)')}) / 1000 AS straight_km,
  min(z) AS elevation_min, max(z) AS elevation_max, avg(z) AS elevation_mean, sum(greatest(0, coalesce(dz, 0))) AS ascent, sum(greatest(0, -coalesce(dz, 0))) AS descent,
  avg(z / 10) AS slope_mean, avg((z / 10 > 25)::INT) * 100 AS slope_over_25_pct, sum(z / 500) AS cost_sum, count(*) FILTER (event_id % 9 = 0) AS crossings FROM sd GROUP BY path_id)"""
_GATE = f"""{P}, {_STATS}, {_TURN}, {_CLIMB}, md AS (SELECT quantile_cont(z / 100, 0.5) AS median FROM p),
ly AS (SELECT path_id, max(z / 10) AS slope, avg((z * 2 < 30)::INT) AS water, count(*) FILTER (event_id % 500 = 0) AS forbidden, avg(z / 100) AS cost FROM p GROUP BY path_id),
tm AS (SELECT path_id, max(turn) AS turn FROM u GROUP BY path_id),
j AS (SELECT path_id, slope, water, forbidden, cost / median AS ratio, turn, climb, CASE WHEN straight_km > 0 THEN length_km / straight_km ELSE 1.0 END AS sinuosity FROM ly JOIN st USING (path_id) JOIN tm USING (path_id) JOIN cl USING (path_id), md),
ck AS MATERIALIZED (
  SELECT path_id, 'slope' AS check_id, coalesce(slope <= 45, true) AS passed, slope AS value, 45.0::DOUBLE AS threshold FROM j
  UNION ALL SELECT path_id, 'water', coalesce(water <= 0.25, true), water, 0.25 FROM j
  UNION ALL SELECT path_id, 'protected', forbidden = 0, forbidden, 0.0 FROM j
  UNION ALL SELECT path_id, 'curvature', coalesce(turn <= 50, true), turn, 50.0 FROM j
  UNION ALL SELECT path_id, 'sinuosity', sinuosity <= 3, sinuosity, 3.0 FROM j
  UNION ALL SELECT path_id, 'elevation', climb <= 2500, climb, 2500.0 FROM j
  UNION ALL SELECT path_id, 'cost', coalesce(ratio <= 3, true), ratio, 3.0 FROM j),
qs AS (SELECT path_id, bool_and(passed) AS quality_passed, count(*) FILTER (passed) AS n_passed, count(*) AS n_total, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (NOT passed), 'NONE') AS fail_reason FROM ck GROUP BY path_id)"""
_CLASSIFY = "CASE " + " ".join(f"WHEN contains(lower(landuse), '{w}') OR contains(nature, '{w}') THEN {c}" for w, c in LAND_USE) + " ELSE 8 END"
_ANGLE = "((degrees(atan2(-dy, dx)) + 360) % 360)"

_SIMILAR = f"""WITH {T}, thin AS (SELECT path_id - 1 AS path_id, seq, lon, lat FROM p WHERE seq % 3 = 1 AND path_id - 1 IN (SELECT path_id FROM p)),
c AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS k, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS place FROM thin),
s AS MATERIALIZED (SELECT path_id, seq, CASE WHEN place > 2 AND place <= k - 2 THEN avg(lon) OVER v ELSE lon END AS lon, CASE WHEN place > 2 AND place <= k - 2 THEN avg(lat) OVER v ELSE lat END AS lat FROM c WINDOW v AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
{densified('s', 'a', 100.0)}, {densified('p', 'b', 100.0)}, ae AS (SELECT * FROM a WHERE seq % 2 = 0), be AS (SELECT * FROM b WHERE seq % 2 = 0),
h1 AS (SELECT path_id, max(d) AS there FROM {nearest('ae', 'be')} GROUP BY 1), h2 AS (SELECT path_id, max(d) AS back FROM {nearest('be', 'ae')} GROUP BY 1),
o AS (SELECT path_id, avg(d) AS mean, avg((d < 500)::INT) * 100 AS o500, avg((d < 1000)::INT) * 100 AS o1, avg((d < 2000)::INT) * 100 AS o2 FROM {nearest('a', 'b')} GROUP BY 1),
sim AS MATERIALIZED (SELECT * FROM h1 JOIN h2 USING (path_id) JOIN o USING (path_id))"""
# the same over all points
_SIMILAR_WHOLE = _SIMILAR.replace(" WHERE seq % 2 = 0", "")
_EVEN = """a AS (SELECT *, coalesce(sqrt(pow(lead(lon) OVER w - lon, 2) + pow(lead(lat) OVER w - lat, 2)), 0) AS d FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
b AS MATERIALIZED (SELECT *, coalesce(sum(d) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM a WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
t AS (SELECT path_id, sum(d) AS total, greatest(CAST(floor(sum(d) / (30 / 111000.0::DOUBLE)) AS BIGINT), count(*)) AS n FROM a GROUP BY 1),
k AS (SELECT path_id, n, unnest(range(n)) AS k, total FROM t), m AS (SELECT path_id, k, n, CASE WHEN n > 1 THEN total * k / (n - 1) ELSE 0 END AS x FROM k)
SELECT m.path_id, CAST(k AS INT) AS seq, round(CASE WHEN k = n - 1 THEN (SELECT max_by(lon, seq) FROM p q WHERE q.path_id = m.path_id) ELSE lon + coalesce((x - s) / d * (lon1 - lon), 0) END, 5) AS lon, round(CASE WHEN k = n - 1 THEN (SELECT max_by(lat, seq) FROM p q WHERE q.path_id = m.path_id) ELSE lat + coalesce((x - s) / d * (lat1 - lat), 0) END, 5) AS lat FROM m ASOF JOIN (SELECT * FROM b WHERE d > 0) b ON m.path_id = b.path_id AND m.x >= b.s"""
_STEPS = "f AS MATERIALIZED (SELECT path_id * 100000 + (seq - 1) // 3 AS feature_id, CAST((seq - 1) % 3 AS INT) AS seq, lon, lat FROM p), st AS (SELECT feature_id, seq, lon AS x0, lat AS y0, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1 FROM f WINDOW w AS (PARTITION BY feature_id ORDER BY seq))"


def _cut(west: str, south: str, east: str, north: str) -> str:
    """CTE cut: steps with the share of each, t0 to t1, that lies in the box."""
    enter = lambda p, q: f"CASE WHEN {p} < 0 THEN ({q}) / ({p}) ELSE 0.0::DOUBLE END"
    leave = lambda p, q: f"CASE WHEN {p} > 0 THEN ({q}) / ({p}) ELSE 1.0::DOUBLE END"
    sides = [("(x0 - x1)", f"x0 - {west}"), ("(x1 - x0)", f"{east} - x0"), ("(y0 - y1)", f"y0 - {south}"), ("(y1 - y0)", f"{north} - y0")]
    outside = " OR ".join(f"({p} = 0 AND {q} < 0)" for p, q in sides)
    return f"cut AS MATERIALIZED (SELECT * FROM (SELECT *, greatest(0.0::DOUBLE, {', '.join(enter(*x) for x in sides)}) AS t0, least(1.0::DOUBLE, {', '.join(leave(*x) for x in sides)}) AS t1, {outside} AS gone FROM st WHERE x1 IS NOT NULL) WHERE NOT gone AND t0 <= t1)"


#: Whether a step (x0, y0, x1, y1) meets the closed cell (row, col).
_MEETS = "greatest(0.0::DOUBLE, CASE WHEN x1 > x0 THEN (col - x0) / (x1 - x0) WHEN x1 < x0 THEN (col + 1 - x0) / (x1 - x0) WHEN x0 < col OR x0 > col + 1 THEN 2 ELSE 0 END, CASE WHEN y1 > y0 THEN (row - y0) / (y1 - y0) WHEN y1 < y0 THEN (row + 1 - y0) / (y1 - y0) WHEN y0 < row OR y0 > row + 1 THEN 2 ELSE 0 END) <= least(1.0::DOUBLE, CASE WHEN x1 > x0 THEN (col + 1 - x0) / (x1 - x0) WHEN x1 < x0 THEN (col - x0) / (x1 - x0) ELSE 1 END, CASE WHEN y1 > y0 THEN (row + 1 - y0) / (y1 - y0) WHEN y1 < y0 THEN (row - y0) / (y1 - y0) ELSE 1 END)"


def _snapped(reach: int) -> str:
    """CTE k: for each cell (row, col) of u, the nearest (r, c) with z under 100 by rings."""
    return f"k AS MATERIALIZED (SELECT u.row, u.col, (arg_min({{'r': g.row, 'c': g.col}}, (greatest(abs(g.row - u.row), abs(g.col - u.col))::BIGINT * 100000 + g.row) * 1000 + g.col)).r AS r, (arg_min({{'r': g.row, 'c': g.col}}, (greatest(abs(g.row - u.row), abs(g.col - u.col))::BIGINT * 100000 + g.row) * 1000 + g.col)).c AS c FROM u JOIN g ON g.row BETWEEN u.row - {reach} AND u.row + {reach} AND g.col BETWEEN u.col - {reach} AND u.col + {reach} WHERE g.z < 100 GROUP BY u.row, u.col)"


_SIMPLE = """ends AS (SELECT path_id, min(seq) AS i, max(seq) AS j FROM p GROUP BY 1),
sp AS (
  SELECT path_id, i, j FROM ends
  UNION ALL
  SELECT path_id, unnest([i, k]) AS i, unnest([k, j]) AS j FROM (
    SELECT s.path_id, s.i, s.j, arg_max(m.seq, m.off) AS k, max(m.off) AS most FROM sp s, LATERAL (
      SELECT q.seq, sqrt(pow(q.lon - a.lon - t * (b.lon - a.lon), 2) + pow(q.lat - a.lat - t * (b.lat - a.lat), 2)) AS off FROM p q, p a, p b,
        LATERAL (SELECT least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((q.lon - a.lon) * (b.lon - a.lon) + (q.lat - a.lat) * (b.lat - a.lat)) / nullif(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2), 0))) AS t)
      WHERE q.path_id = s.path_id AND q.seq > s.i AND q.seq < s.j AND a.path_id = s.path_id AND a.seq = s.i AND b.path_id = s.path_id AND b.seq = s.j) m
    GROUP BY s.path_id, s.i, s.j) WHERE most > 90 / 111000.0::DOUBLE)"""

_BOXES = "bw AS (SELECT s_suppkey AS box_id, 120 + (s_suppkey * 37 % 187) / 100.0::DOUBLE AS west, 21.9::DOUBLE + (s_suppkey * 53 % 331) / 100.0::DOUBLE AS south FROM supplier), bx AS MATERIALIZED (SELECT *, west + 0.05::DOUBLE + (box_id % 11) / 100.0::DOUBLE AS east, south + 0.04::DOUBLE + (box_id % 7) / 100.0::DOUBLE AS north FROM bw)"

#: CTEs e, the ends of the routes, and s, what it costs at least to reach each cell of each route.
_REACHED = f"""WITH RECURSIVE {G}, c AS MATERIALIZED (SELECT row, col, (z + 1000) / 1000 AS cost FROM g WHERE z < 250),
m AS MATERIALIZED (SELECT a.row AS r0, a.col AS c0, b.row, b.col, b.cost * CASE WHEN a.row <> b.row AND a.col <> b.col THEN 1.414::DOUBLE ELSE 1 END AS w
  FROM c a JOIN c b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.row <> b.row OR a.col <> b.col)
  WHERE a.row = b.row OR a.col = b.col OR (EXISTS (SELECT 1 FROM c x WHERE x.row = a.row AND x.col = b.col) AND EXISTS (SELECT 1 FROM c x WHERE x.row = b.row AND x.col = a.col))),
e AS MATERIALIZED (SELECT n_nationkey::BIGINT AS path_id, CAST(floor((n_nationkey * 17 % 60) * (h - 1) / 99.0::DOUBLE) AS INT) AS r0, CAST(n_nationkey * 11 % 60 AS INT) AS c0, CAST(floor((n_nationkey * 29 % 60 + 40) * (h - 1) / 99.0::DOUBLE) AS INT) AS r1, CAST(n_nationkey * 7 % 60 AS INT) AS c1 FROM nation, dim),
s(path_id, row, col, g) USING KEY (path_id, row, col) AS (
  SELECT path_id, r0, c0, 0.0::DOUBLE FROM e JOIN c ON c.row = r0 AND c.col = c0
  UNION
  SELECT s.path_id, m.row, m.col, min(s.g + m.w) FROM s JOIN m ON m.r0 = s.row AND m.c0 = s.col LEFT JOIN recurring.s k ON k.path_id = s.path_id AND k.row = m.row AND k.col = m.col
  WHERE k.g IS NULL OR s.g + m.w < k.g GROUP BY 1, 2, 3)"""

ORACLES: dict[str, str] = {
    "grid_slope_by_row": f"WITH {G}, {gradients()} SELECT row, count(*) AS n, {r6(f'avg({SLOPE})')} AS slope_mean, {r6(f'max({SLOPE})')} AS slope_max FROM d GROUP BY row",
    "grid_aspect": f"WITH {G}, {gradients()} SELECT row, col, {r6('cos(atan2(-dy, dx))')} AS aspect_cos, {r6('sin(atan2(-dy, dx))')} AS aspect_sin FROM d",
    "grid_curvature": f"WITH {G}, {CURVE} SELECT row, col, {r6(PROFILE)} AS curvature_profile, {r6(PLAN)} AS curvature_plan FROM e",
    "grid_tri": f"WITH {G}, {box('g', 'z', 3, 'm')} SELECT row, col, {r6(TRI)} AS tri FROM g JOIN m USING (row, col)",
    "grid_tpi": f"WITH {G}, {box('g', 'z', 11, 'm')} SELECT row, col, {r6('z - m')} AS tpi FROM g JOIN m USING (row, col)",
    "grid_roughness": f"WITH {G}, q AS (SELECT row, col, z * z AS z2 FROM g), {box('g', 'z', 9, 'm')}, {box('q', 'z2', 9, 'm2')} SELECT row, col, {r6('sqrt(greatest(0, m2 - m * m))')} AS roughness FROM m JOIN m2 USING (row, col)",
    "grid_gaussian": f"WITH {G}, {separable('g', 'z', kernel(2.0), 'blurred')} {cells('blurred', 'blurred')}",
    "grid_masked_gaussian": f"WITH {G}, x AS (SELECT row, col, (z > -100)::INT AS mask, CASE WHEN z > -100 THEN z ELSE 0 END AS a, CASE WHEN z > -100 THEN 1.0 ELSE 0.0 END AS b FROM g), {separable('x', 'a', kernel(1.0), 'ga', 'nearest')}, {separable('x', 'b', kernel(1.0), 'gb', 'nearest')} SELECT row, col, CASE WHEN mask = 1 THEN {r6('ga / greatest(gb, 1e-6)')} END AS blurred FROM x JOIN ga USING (row, col) JOIN gb USING (row, col)",
    "hillshade_strided": f"WITH {G}, k AS (SELECT row // 4 AS row, col // 4 AS col, z FROM g WHERE row % 4 = 0 AND col % 4 = 0), {gradients('k', 'd', 120.0)} SELECT row, col, {r6(clip('sin(radians(45)) * cos(atan(sqrt(dx*dx + dy*dy))) + cos(radians(45)) * sin(atan(sqrt(dx*dx + dy*dy))) * cos(radians(135) - atan2(-dy, dx))'))} AS shade FROM d",
    "risk_typhoon": f"WITH {G}, {gradients()}, x AS (SELECT row, col, 0.4 * {clip(SLOPE + ' / 45')} + 0.35 * (CASE WHEN {_ANGLE} >= 45 AND {_ANGLE} < 225 THEN 1.0 ELSE 0.3 END) + 0.25 * (1 - {clip('z / 3000')}) AS v FROM d), {separable('x', 'v', kernel(2.0), 'typhoon')} {cells('typhoon', 'typhoon')}",
    "risk_seismic": f"WITH {G}, {gradients()} SELECT row, col, {r6(clip('0.6 + 0.3 * ' + clip(SLOPE + ' / 40')))} AS seismic FROM d",
    "risk_landslide": f"WITH {G}, {CURVE}, {box('g', 'z', 3, 'm')}, x AS (SELECT row, col, 0.45 * {clip('(' + SLOPE + ' - 15) / 30')} + 0.30 * {clip(TRI + ' / 200')} + 0.25 * {clip('((' + PROFILE + ') + 0.01) / 0.02')} AS v FROM e JOIN m USING (row, col)), {separable('x', 'v', kernel(2.0), 'landslide')} {cells('landslide', 'landslide')}",
    "hard_mask": f"WITH {G}, {gradients()} SELECT row, sum(CASE WHEN {SLOPE} > 45 OR z > 3000 THEN 0 ELSE 1 END)::BIGINT AS passable, count(*) AS n FROM d GROUP BY row",
    "soft_mask": f"WITH {G}, {gradients()} SELECT {_CODE} AS landuse, count(*) AS n, {r6('avg(' + case(_CODE, SOFT_FACTOR, 0.2) + ')')} AS soft_mask FROM g GROUP BY 1 UNION ALL SELECT 0, count(*), {r6('avg(1 - 0.7 * ' + clip(SLOPE + ' / 45') + ')')} FROM d",
    "mask_dilate": f"WITH {G}, o AS (SELECT a.i, b.j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) + abs(j) <= 2) SELECT DISTINCT CAST(row + i AS INT) AS row, CAST(col + j AS INT) AS col FROM g, o, dim WHERE z > 300 AND row + i BETWEEN 0 AND h - 1 AND col + j BETWEEN 0 AND w - 1",
    "distance_field": f"WITH {G}, b AS MATERIALIZED (SELECT row, col FROM g WHERE z > 300), n AS (SELECT g.row, g.col, min((g.row - b.row) * (g.row - b.row) + (g.col - b.col) * (g.col - b.col)) AS d2 FROM g, b GROUP BY 1, 2) SELECT g.row, g.col, round(least(5000.0::DOUBLE, coalesce(sqrt(d2) * 30, 5000.0)), 6) + 0.0 AS dist FROM g LEFT JOIN n ON g.row = n.row AND g.col = n.col",
    "building_density": f"WITH {G}, x AS (SELECT row, col, CASE WHEN z > 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM g), {separable('x', 'v', kernel(16), 'q')} SELECT row, col, {r6('q / (0.03 * 0.03)')} AS density FROM q",
    "landuse_classify": f"WITH x AS (SELECT ['Farmland', 'dense WOOD', 'salt_pond', 'muddy', 'Urban', 'quarry', 'sandy beach', 'military', 'none'][p_partkey % 9 + 1] AS landuse, lower(p_type) AS nature FROM part) SELECT landuse, nature, {_CLASSIFY} AS code, count(*) AS n FROM x GROUP BY ALL",
    "landuse_raster_max": f"WITH {G}, m AS (SELECT CAST(l_orderkey % 500 AS INT) AS row, CAST(l_partkey % 64 AS INT) AS col, max(CAST(l_suppkey % 7 + 1 AS INT)) AS code FROM lineitem GROUP BY 1, 2) SELECT g.row, g.col, coalesce(code, 8) AS code FROM g LEFT JOIN m ON g.row = m.row AND g.col = m.col",
    "geo_to_grid": f"WITH {P}, q AS (SELECT event_id, CAST(trunc((lat - 25.4) / -0.001) AS INT) AS row, CAST(trunc((lon - 120.0) / 0.001) AS INT) AS col FROM p) SELECT event_id, row, col, {r6('120.0 + col * 0.001::DOUBLE + 0.001::DOUBLE / 2')} AS lon, {r6('25.4 - row * 0.001::DOUBLE - 0.001::DOUBLE / 2')} AS lat FROM q",
    "resample_grid": f"WITH {G} SELECT CAST(row // 3 AS INT) AS row, CAST(col // 3 AS INT) AS col, {r6('sum(z)')} AS z FROM g, dim WHERE row % 3 = 1 AND col % 3 = 1 AND row // 3 < h // 3 AND col // 3 < w // 3 GROUP BY 1, 2",
    "bilinear_sample": f"WITH {G}, e AS (SELECT event_id, value % 400 AS fr, (event_id % 630) / 10.0::DOUBLE AS fc FROM events), c AS (SELECT event_id, fr, fc, CAST(floor(fr) AS INT) + i AS row, CAST(floor(fc) AS INT) + j AS col FROM e, range(2) a(i), range(2) b(j)), k AS (SELECT *, (1 - abs(fr - row)) * (1 - abs(fc - col)) AS wt FROM c) SELECT event_id, CASE WHEN count(*) = count(z) THEN {r6('sum(wt * z)')} END AS z FROM k LEFT JOIN g USING (row, col) WHERE wt > 0 GROUP BY event_id",
    "feature_stack": f"WITH {G}, {gradients()} SELECT CAST({_CODE} AS DOUBLE) AS landuse_code, count(*) AS n, {r6('avg(z)')} AS elevation_mean, {r6(f'avg({SLOPE})')} AS slope_mean, {r6('avg(cos(atan2(-dy, dx)))')} AS aspect_cos_mean, {r6('avg(sin(atan2(-dy, dx)))')} AS aspect_sin_mean, "
    + ", ".join(f"0.0::DOUBLE AS {b}_mean" for b in BANDS if b not in ("elevation", "slope", "aspect_cos", "aspect_sin", "landuse_code"))
    + " FROM d GROUP BY 1",
    "pseudo_label": f"{_LABELLED} SELECT row, col, {r6('label')} AS label FROM x",
    "fuse_cost": f"{_LABELLED}, y AS MATERIALIZED (SELECT row, col, hard_mask, CASE WHEN hard_mask = 1 THEN coalesce(label, 0) * (0.02 + 0.98 * {clip('dist_line / 1000')}) * {clip(case('landuse', SOFT_FACTOR, 0.2), 0.01)} ELSE 0 END AS a, hard_mask::DOUBLE AS b FROM x), {separable('y', 'a', kernel(1.0), 'ga', 'nearest')}, {separable('y', 'b', kernel(1.0), 'gb', 'nearest')} SELECT row, col, CASE WHEN hard_mask = 1 THEN {r6('ga / greatest(gb, 1e-6)')} END AS cost FROM y JOIN ga USING (row, col) JOIN gb USING (row, col)",
    "path_length": f"WITH {P}, {_NEXT} SELECT path_id, {r6('sum(d) / 1000')} AS length_km, count(*) AS n_points FROM nd GROUP BY path_id",
    "path_dense_sample": f"WITH {T}, {densified('p', 'q', 100.0)} SELECT path_id, count(*) AS n, {r6('avg(lon)')} AS lon, {r6('avg(lat)')} AS lat, CAST(max(seq) AS INT) AS last FROM q GROUP BY path_id",
    "path_resample": f"WITH {T}, {_EVEN}",
    "waypoint_paths": f"WITH {T}, {_NEXT}, k AS (SELECT *, greatest(2, CAST(floor(d / 30) AS INT)) AS n FROM nd WHERE d IS NOT NULL), i AS (SELECT path_id, lon + j / n * (lon1 - lon) AS lon, lat + j / n * (lat1 - lat) AS lat FROM (SELECT *, unnest(range(n))::DOUBLE AS j FROM k) UNION ALL SELECT path_id, lon, lat FROM nd WHERE d IS NULL) SELECT path_id, count(*) AS n, {r6('avg(lon)')} AS lon, {r6('avg(lat)')} AS lat, CAST(count(*) - 1 AS INT) AS last FROM i GROUP BY path_id",
    "path_moving_avg": f"WITH {P}, {_SMOOTH} SELECT path_id, seq, {r6('lon')} AS lon, {r6('lat')} AS lat FROM s",
    "path_turn_angle": f"WITH {P}, {_TURN} SELECT path_id, round(max(turn), 4) AS turn_max, round(avg(turn), 4) AS turn_mean FROM u GROUP BY path_id",
    "path_monotone_climb": f"WITH RECURSIVE {P}, {_CLIMB} SELECT path_id, {r6('climb')} AS climb FROM cl",
    "path_similarity": f"{_SIMILAR_WHOLE} SELECT path_id, round(greatest(there, back), 3) AS hausdorff_m, round(mean, 3) AS mean_distance_m, {r6('o500')} AS overlap_500m_pct, {r6('o1')} AS overlap_1km_pct, {r6('o2')} AS overlap_2km_pct FROM sim",
    "acceptable_v1": f"{_SIMILAR}, lr AS (SELECT path_id, sum({_HAV('lon', 'lat', 'lon1', 'lat1')}) / 1000 AS km FROM (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM p {W}) GROUP BY 1), lo AS (SELECT path_id, sum({_HAV('lon', 'lat', 'lon1', 'lat1')}) / 1000 AS km FROM (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM thin {W}) GROUP BY 1), jd AS MATERIALIZED (SELECT path_id, CASE WHEN lr.km > 0 THEN abs(lo.km - lr.km) / lr.km * 100 END AS e, greatest(there, back) < 5000 AND mean < 2000 AND o500 > 30 AND CASE WHEN lr.km > 0 THEN abs(lo.km - lr.km) / lr.km * 100 END < 30 AS ok FROM sim JOIN lr USING (path_id) JOIN lo USING (path_id)) SELECT path_id, round(e, 4) AS length_error_pct, coalesce(ok, false) AS acceptable FROM jd UNION ALL SELECT -1, NULL, count(*) FILTER (ok) >= count(*) * 0.67 FROM jd",
    "path_one_sided": f"WITH {P}, {_SMOOTH} SELECT path_id, round(max(d), 3) AS directed_hausdorff_m, {r6('avg((d < 500)::INT) * 100')} AS overlap_500m_pct FROM {nearest('s', 'p')} GROUP BY path_id",
    "path_stats": f"WITH {P}, {_STATS} SELECT path_id, n_vertices, crossings, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("length_km", "straight_km", "elevation_min", "elevation_max", "elevation_mean", "ascent", "descent", "slope_mean", "slope_over_25_pct", "cost_sum")) + ", round(CASE WHEN straight_km > 0 THEN length_km / straight_km ELSE 1 END, 5) AS sinuosity FROM st",
    "elevation_profile": f"WITH {P}, {_NEXT} SELECT path_id, seq, round(coalesce(sum(d) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000, 5) AS dist_km, {r6('z')} AS z FROM nd",
    "deviation_profile": f"WITH {P}, {_SMOOTH}, k AS (SELECT * FROM s WHERE (seq - 1) % 5 = 0) SELECT path_id, seq, round(d, 3) AS d FROM {nearest('k', 'p')}",
    "line_progress": f"WITH {P}, e AS (SELECT path_id, min_by(lon, seq) AS ax, min_by(lat, seq) AS ay, max_by(lon, seq) AS bx, max_by(lat, seq) AS by_ FROM p GROUP BY path_id) SELECT path_id, seq, {r6('CASE WHEN (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) > 0 THEN ' + clip('((lon-ax)*(bx-ax) + (lat-ay)*(by_-ay)) / ((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay))') + ' ELSE 0 END')} AS t FROM p JOIN e USING (path_id)",
    "quality_gate": f"WITH RECURSIVE {_GATE} SELECT path_id, check_id, passed, round(value, 4) AS value, threshold FROM ck",
    "quality_summary": f"WITH RECURSIVE {_GATE} SELECT * FROM qs",
    "fail_reasons": f"WITH RECURSIVE {_GATE} SELECT path_id, CASE WHEN path_id % 10 = 3 THEN 'ENDPOINT_INVALID' WHEN path_id % 7 = 1 THEN 'ASTAR_FAILED' ELSE fail_reason END AS fail_reason FROM qs",
    "anti_join_exclusion": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "case_lookup": "WITH l AS (SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) SELECT s_suppkey, s_suppkey * 40 AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN l.c_name ELSE c.c_name END AS c_name, CASE WHEN c.c_custkey IS NULL THEN l.c_acctbal ELSE c.c_acctbal END AS c_acctbal, c.c_custkey IS NULL AS fell_back FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey * 40, l",
    "summary_stats": "WITH x AS (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) SELECT metric, count(v) AS n, round(min(v), 4) AS least, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(max(v), 4) AS most FROM x GROUP BY metric",
    "rollup_summary": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 5) AS mean, round(stddev_pop(l_quantity), 5) AS std, count(l_quantity) AS n_valid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "paired_t": """WITH x AS (SELECT l_returnflag, l_linestatus, l_quantity - l_tax * 300 AS d FROM lineitem WHERE l_linenumber % 3 <> 0
      UNION ALL SELECT l_returnflag, l_linestatus || ' few', l_quantity - 13 - l_tax * 300 FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_orderkey % 200 = 0),
    y AS MATERIALIZED (SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN count(*) >= 5 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM x GROUP BY ALL),
    k AS (SELECT unnest(range(0, 4001)) AS k),
    i AS (SELECT l_returnflag, l_linestatus, sum(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-n / 2.0 * ln(1 + pow(t * k / 4000, 2) / (n - 1)))) * abs(t) / 4000 / 3 * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi() * (n - 1)) AS half FROM y, k WHERE t IS NOT NULL GROUP BY l_returnflag, l_linestatus, n, t),
    z AS (SELECT y.*, greatest(0, 1 - 2 * half) AS p FROM y LEFT JOIN i USING (l_returnflag, l_linestatus))
    SELECT l_returnflag, l_linestatus, n, round(t, 4) AS t, abs(round(p, 5)) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p IS NOT NULL THEN 'n.s.' END AS significance FROM z""",
    "report_union": f"WITH {P} SELECT 'actual' AS type, count(DISTINCT path_id) AS n, count(DISTINCT path_id) AS names FROM p UNION ALL SELECT 'predicted', count(DISTINCT path_id), count(DISTINCT path_id) FROM p",
    "remaining_cost": f"WITH {P}, r AS (SELECT path_id, seq, CAST(floor(lat * 100) AS INT) AS row, CAST(floor(lon * 100) AS INT) AS col, z AS cost FROM p), s AS (SELECT path_id, seq, coalesce(lead(cost) OVER w * (CASE WHEN lead(row) OVER w <> row AND lead(col) OVER w <> col THEN 1.414::DOUBLE ELSE 1.0 END), 0) AS step FROM r {W}) SELECT path_id, seq, round(sum(step) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS remaining FROM s",
    "osm_sources": "WITH v AS (SELECT l_orderkey AS id, list({'y': l_suppkey % 10, 'x': l_partkey % 100} ORDER BY l_linenumber, l_partkey, l_suppkey) AS g0 FROM lineitem GROUP BY 1), r AS (SELECT id, CASE WHEN id % 2 = 0 THEN list_append(g0, g0[1]) ELSE g0 END AS g FROM v), o AS MATERIALIZED (SELECT r.*, len(g) AS n, o_orderpriority, o_orderstatus, o_custkey AS c FROM r JOIN orders ON id = o_orderkey), s AS (SELECT 'roads' AS source, n FROM o WHERE n >= 2 AND o_orderpriority = '1-URGENT' UNION ALL SELECT 'water', n FROM o WHERE n >= 2 AND o_orderstatus = 'F' UNION ALL SELECT 'railways', n FROM o WHERE n >= 2 AND c % 7 = 0 UNION ALL SELECT k.source, n FROM o JOIN (VALUES ('landuse', 2), ('protected', 3), ('buildings', 5), ('airports', 11)) k(source, m) ON c % m = 0 WHERE n >= 4 AND g[1] = g[n]) SELECT k.source, count(n) AS n, CAST(coalesce(sum(n), 0) AS BIGINT) AS vertices FROM (VALUES ('roads'), ('water'), ('protected'), ('landuse'), ('buildings'), ('railways'), ('airports')) k(source) LEFT JOIN s USING (source) GROUP BY k.source",
    "tile_mosaic": f"WITH {G}, rs AS (SELECT DISTINCT greatest(0, least(i * 32, h - 48)) AS r FROM (SELECT h, unnest(range(h // 32 + 1)) AS i FROM dim)), cs AS (SELECT DISTINCT greatest(0, least(i * 32, w - 48)) AS c FROM (SELECT w, unnest(range(w // 32 + 1)) AS i FROM dim)) SELECT row, col, {r6('greatest(0, avg(z + r + c))')} AS predicted FROM g JOIN rs ON row BETWEEN r AND r + 47 JOIN cs ON col BETWEEN c AND c + 47 GROUP BY row, col",
    "endpoint_snap": f"WITH {G}, q AS (SELECT event_id AS path_id, CAST(event_id % h AS INT) AS row, CAST(user_id % 64 AS INT) AS col FROM events, dim), u AS MATERIALIZED (SELECT DISTINCT row, col FROM q), {_snapped(50)} SELECT path_id, k.r AS row, k.c AS col FROM q JOIN k USING (row, col)",
    "waypoint_repair": f"WITH {G}, q AS (SELECT user_id AS path_id, event_id AS seq, CAST(event_id % (h + 3) AS INT) AS row, CAST(user_id % 64 AS INT) AS col FROM events, dim), u AS MATERIALIZED (SELECT DISTINCT row, col FROM q JOIN g USING (row, col) WHERE z >= 100), {_snapped(30)} SELECT path_id, seq, coalesce(k.r, row) AS row, coalesce(k.c, col) AS col FROM q LEFT JOIN k USING (row, col)",
    "event_windows": "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS starts, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 3600 AS ends, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, date_trunc('hour', ts)",
    "event_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS starts, CAST(floor(epoch(max(ts))) AS BIGINT) + 21600 AS ends, count(*) AS n FROM y GROUP BY user_id, s",
    "terrain_factors": f"WITH {G}, {CURVE}, q AS (SELECT row, col, z * z AS z2 FROM g), {box('g', 'z', 3, 'm')}, {box('g', 'z', 11, 'mt')}, {box('g', 'z', 9, 'mr')}, {box('q', 'z2', 9, 'm2')} SELECT row, col, {r6(SLOPE)} AS slope, {r6('cos(atan2(-dy, dx))')} AS aspect_cos, {r6('sin(atan2(-dy, dx))')} AS aspect_sin, {r6(TRI)} AS tri, {r6('z - mt')} AS tpi, {r6(PROFILE)} AS curvature_profile, {r6(PLAN)} AS curvature_plan, {r6('sqrt(greatest(0, m2 - mr * mr))')} AS roughness FROM e JOIN m USING (row, col) JOIN mt USING (row, col) JOIN mr USING (row, col) JOIN m2 USING (row, col)",
    "nearest_sample": f"WITH {G}, {P} SELECT event_id, g.row, g.col, {r6('g.z')} AS z FROM p JOIN g ON g.row = CAST(trunc((lat - 25.4) / -0.032) AS INT) AND g.col = CAST(trunc((lon - 120.0) / 0.032) AS INT)",
    "channel_normalisation": f"WITH {G}, {gradients()}, x AS MATERIALIZED (SELECT row, col, z, {SLOPE} AS slope FROM d), s AS (SELECT avg(z) AS zm, stddev_pop(z) + 1e-8 AS zs, avg(slope) AS sm, stddev_pop(slope) + 1e-8 AS ss FROM x) SELECT row, col, {r6('(z - zm) / zs')} AS z, {r6('(slope - sm) / ss')} AS slope FROM x, s",
    "lines_touching_box": f"WITH {P}, {_STEPS}, {_cut('120.5', '23.0', '120.8', '23.5')} SELECT feature_id, CAST(n AS INT) AS n FROM (SELECT feature_id, count(*) AS n FROM f GROUP BY 1) WHERE feature_id IN (SELECT feature_id FROM cut)",
    "lines_clipped": f"WITH {P}, {_STEPS}, {_cut('120.5', '22.5', '121.5', '24.5')}, w AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY feature_id ORDER BY seq) AS part FROM (SELECT *, coalesce(lag(seq) OVER v = seq - 1 AND lag(t1) OVER v = 1 AND t0 = 0, false) AS ok FROM cut WHERE t1 > t0 AND (x0 <> x1 OR y0 <> y1) WINDOW v AS (PARTITION BY feature_id ORDER BY seq))) SELECT feature_id, CAST(part AS INT) AS part, CAST(count(*) + 1 AS INT) AS n, {r6('min(least(x0 + t0 * (x1 - x0), x0 + t1 * (x1 - x0)))')} AS west, {r6('max(greatest(x0 + t0 * (x1 - x0), x0 + t1 * (x1 - x0)))')} AS east FROM w GROUP BY feature_id, part",
    "lines_in_boxes": f"WITH {P}, {_STEPS.replace('st AS (', 's0 AS (')}, {_BOXES}, st AS (SELECT * FROM s0, bx), {_cut('west', 'south', 'east', 'north')} SELECT feature_id, box_id, count(*) AS n_steps, {r6('sum((t1 - t0) * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))')} AS degrees FROM cut GROUP BY feature_id, box_id",
    "reproject_grid": f"WITH {G}, t AS (SELECT a.i AS row, b.j AS col, degrees((120.0::DOUBLE * 111319.49079327358::DOUBLE + b.j * 115.0 + 57.5) / 6378137.0) AS lon, (2922947.0::DOUBLE - a.i * 115.0 - 57.5) / 6378137.0 AS y FROM dim, range(10000) a(i), range(64) b(j) WHERE a.i < h AND b.j < w), f AS (SELECT row, col, (25.4::DOUBLE - degrees(atan((exp(y) - exp(-y)) / 2))) / 0.001::DOUBLE - 0.5 AS fr, (lon - 120.0::DOUBLE) / 0.001::DOUBLE - 0.5 AS fc FROM t), k AS (SELECT f.*, CAST(floor(fr) AS INT) + i AS r, CAST(floor(fc) AS INT) + j AS c FROM f, range(2) a(i), range(2) b(j), dim WHERE fr >= -0.5 AND fr < h - 0.5 AND fc >= -0.5 AND fc < w - 0.5), m AS (SELECT k.row, k.col, sum((1 - abs(fr - r)) * (1 - abs(fc - c)) * z) / sum((1 - abs(fr - r)) * (1 - abs(fc - c))) AS z FROM k JOIN g ON g.row = r AND g.col = c WHERE (1 - abs(fr - r)) * (1 - abs(fc - c)) > 0 GROUP BY 1, 2) SELECT CAST(t.row AS INT) AS row, CAST(t.col AS INT) AS col, round(m.z, 3) + 0.0 AS z FROM t LEFT JOIN m USING (row, col)",
    "align_layers": f"WITH {G}, {gradients()}, {T}, k AS (SELECT CAST(round(h / 3.0) AS INT) AS kh, CAST(round(w / 3.0) AS INT) AS kw FROM dim), n AS (SELECT lon, lat, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM p {W}), s AS (SELECT (lon - 120) / 0.003::DOUBLE AS x0, (25.4 - (lat + 3)) / 0.003::DOUBLE AS y0, (lon1 - 120) / 0.003::DOUBLE AS x1, (25.4 - (lat1 + 3)) / 0.003::DOUBLE AS y1 FROM n WHERE lon1 IS NOT NULL), r AS (SELECT s.*, unnest(range(CAST(greatest(floor(least(y0, y1)), 0) AS BIGINT), CAST(least(floor(greatest(y0, y1)), kh - 1) AS BIGINT) + 1)) AS row, kw FROM s, k), c AS (SELECT *, unnest(range(CAST(greatest(floor(least(x0, x1)), 0) AS BIGINT), CAST(least(floor(greatest(x0, x1)), kw - 1) AS BIGINT) + 1)) AS col FROM r), b AS MATERIALIZED (SELECT DISTINCT row, col FROM c WHERE {_MEETS}), o AS (SELECT row // 3 AS row, col // 3 AS col, z, {SLOPE} AS slope FROM d, k WHERE row % 3 = 1 AND col % 3 = 1 AND row // 3 < kh AND col // 3 < kw), m AS (SELECT o.row, o.col, min((o.row - b.row) * (o.row - b.row) + (o.col - b.col) * (o.col - b.col)) AS d2 FROM o, b GROUP BY 1, 2) SELECT CAST(o.row AS INT) AS row, CAST(o.col AS INT) AS col, {r6('z')} AS z, {r6('slope')} AS slope, round(least(5000.0::DOUBLE, coalesce(sqrt(d2) * 90, 5000.0)), 6) + 0.0 AS dist_line FROM o LEFT JOIN m USING (row, col)",
    "quality_reports": f"WITH RECURSIVE {_GATE} SELECT path_id, " + ", ".join(f"CAST(bool_and(passed) FILTER (check_id = '{c}') AS VARCHAR) AS {c}" for c in ("slope", "water", "protected", "curvature", "sinuosity", "elevation", "cost")) + ", round(max(value) FILTER (check_id = 'slope'), 4) AS slope_value FROM ck GROUP BY path_id",
    "grid_percentiles": f"WITH {G} SELECT 'z' AS metric, s::DOUBLE AS share, {r6('v')} AS value FROM (SELECT unnest([0.01, 0.02, 0.05, 0.5, 0.98]) AS s, unnest(quantile_cont(z, [0.01, 0.02, 0.05, 0.5, 0.98])) AS v FROM g)",
    "best_by_group": "SELECT l_returnflag, l_linestatus, l_extendedprice, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1",
    "case_comparison": "SELECT o_custkey % 10 AS case_id, count(*) FILTER (o_orderkey % 3 = 0) AS astar, count(*) FILTER (o_orderkey % 3 = 1) AS ipso_sa, count(*) FILTER (o_orderkey % 3 = 2) AS dbo FROM orders GROUP BY 1",
    "validation_summary": "WITH r AS (SELECT o_custkey % 10 AS c, o_orderkey % 3 AS a, round(max(o_totalprice), 2) AS h, count(*) AS n, count(*) FILTER (o_totalprice > 100000) > 50 AS ok FROM orders GROUP BY 1, 2) SELECT count(*) AS n, count(*) FILTER (ok) AS n_passed, round(avg(h), 4) AS hausdorff_m_mean, round(avg(n), 4) AS n_mean, round(median(h), 4) AS hausdorff_m_median, round(median(n), 4) AS n_median FROM r",
    "rasterize_lines": f"WITH {P}, {_NEXT}, s AS (SELECT (lon - 120) / 0.01::DOUBLE AS x0, (25.4 - lat) / 0.01::DOUBLE AS y0, (lon1 - 120) / 0.01::DOUBLE AS x1, (25.4 - lat1) / 0.01::DOUBLE AS y1 FROM n WHERE lon1 IS NOT NULL), r AS (SELECT *, unnest(range(CAST(greatest(floor(least(y0, y1)), 0) AS BIGINT), CAST(least(floor(greatest(y0, y1)), 349) AS BIGINT) + 1)) AS row FROM s), c AS (SELECT *, unnest(range(CAST(greatest(floor(least(x0, x1)), 0) AS BIGINT), CAST(least(floor(greatest(x0, x1)), 199) AS BIGINT) + 1)) AS col FROM r), h AS (SELECT DISTINCT row, col FROM c WHERE {_MEETS}) SELECT CAST(row AS INT) AS row, count(*) AS cells, CAST(min(col) AS INT) AS first, CAST(max(col) AS INT) AS last FROM h GROUP BY row",
    "polygons_raster": f"WITH t AS (SELECT c_custkey AS id, [(c_custkey * 7 % 1000) / 500.0, (c_custkey * 11 % 1000) / 500.0, (c_custkey * 3 % 1000) / 500.0] AS xs, [(c_custkey * 13 % 1000) / 300.0, (c_custkey * 5 % 1000) / 300.0, (c_custkey * 17 % 1000) / 300.0] AS ys FROM customer), e AS MATERIALIZED (SELECT id, (120.00037::DOUBLE + xs[k]::DOUBLE - 120) / 0.05::DOUBLE AS x0, (25.4 - (22.00041::DOUBLE + ys[k]::DOUBLE)) / 0.05::DOUBLE AS y0, (120.00037::DOUBLE + xs[k % 3 + 1]::DOUBLE - 120) / 0.05::DOUBLE AS x1, (25.4 - (22.00041::DOUBLE + ys[k % 3 + 1]::DOUBLE)) / 0.05::DOUBLE AS y1 FROM t, range(1, 4) i(k)), g AS (SELECT a.row, b.col FROM range(70) a(row), range(40) b(col)), h AS (SELECT DISTINCT row, col FROM e, g WHERE {_MEETS} UNION SELECT row, col FROM e, g WHERE (y0 <= row + 0.5) <> (y1 <= row + 0.5) AND x0 + (row + 0.5 - y0) / (y1 - y0) * (x1 - x0) > col + 0.5 GROUP BY id, row, col HAVING count(*) % 2 = 1) SELECT CAST(row AS INT) AS row, count(*) AS cells, CAST(min(col) AS INT) AS first, CAST(max(col) AS INT) AS last FROM (SELECT DISTINCT row, col FROM h) GROUP BY row",
    "astar_routes": f"""{_REACHED}
SELECT e.path_id, CASE WHEN s.g IS NULL THEN 'NO_ROUTE' ELSE 'OK' END AS status, round(s.g, 6) + 0.0 AS total FROM e LEFT JOIN s ON s.path_id = e.path_id AND s.row = e.r1 AND s.col = e.c1""",
    "opened_cells": f"""{_REACHED},
k AS (SELECT e.*, t.g AS total, low FROM e JOIN c a ON a.row = r0 AND a.col = c0 JOIN c b ON b.row = r1 AND b.col = c1 LEFT JOIN s t ON t.path_id = e.path_id AND t.row = r1 AND t.col = c1, (SELECT min(cost) AS low FROM c)),
f AS (SELECT k.path_id, total, g, g + low * (greatest(abs(row - r1), abs(col - c1)) + 0.414::DOUBLE * least(abs(row - r1), abs(col - c1))) AS least FROM k JOIN s USING (path_id)),
n AS (SELECT path_id, count(*) FILTER (total IS NULL OR least < total - 1e-9) AS yes, count(*) FILTER (total IS NULL OR g < total - 1e-9) AS no FROM f GROUP BY path_id)
SELECT e.path_id, i.informed, coalesce(CASE WHEN i.informed THEN n.yes ELSE n.no END, 0) AS opened FROM e LEFT JOIN n USING (path_id), (VALUES (true), (false)) i(informed)""",
    "rdp_simplify": f"WITH RECURSIVE {T}, {_SIMPLE} SELECT path_id, CAST(seq AS BIGINT) AS seq, {r6('lon')} AS lon, {r6('lat')} AS lat FROM p WHERE (path_id, seq) IN (SELECT path_id, i FROM sp UNION SELECT path_id, j FROM sp)",
}
