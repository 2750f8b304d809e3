"""The same results in DuckDB's SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

# ---- shared views ------------------------------------------------------------------------------------------------

TRAJ = """traj AS (SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS x, event_type AS state FROM events)"""
OTRAJ = """otraj AS (SELECT o_custkey AS traj, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx, o_totalprice AS x, o_orderstatus || o_orderpriority AS state FROM orders)"""
CLUSTER = "CASE {0} WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"
SEG = (
    TRAJ
    + """, seg0 AS (SELECT traj, idx, lag(x) OVER w AS p0, x AS p1, lag(state) OVER w AS from_label, state AS to_label FROM traj WINDOW w AS (PARTITION BY traj ORDER BY idx)),
seg AS (SELECT traj % 3 AS file_idx, idx AS n_iter, traj AS seg_id, traj AS parent_id, p0, p1, from_label, to_label, """
    + CLUSTER.format("from_label")
    + " AS from_cluster, "
    + CLUSTER.format("to_label")
    + """ AS to_cluster, 1.0::DOUBLE / count(*) OVER (PARTITION BY idx) AS weight FROM seg0 WHERE idx >= 1),
st AS (SELECT *, CASE WHEN p0 > 0 AND p0 < 5 THEN 5 ELSE from_cluster END::BIGINT AS from_state, CASE WHEN p1 > 0 AND p1 < 5 THEN 5 WHEN p1 > 150 AND p1 < 1000 THEN 6 ELSE to_cluster END::BIGINT AS to_state FROM seg)"""
)
LAST = "(SELECT max(n_iter) FROM seg)"
EDGES = SEG + f", used AS (SELECT * FROM st WHERE n_iter >= 2 AND n_iter < {LAST}), edges AS (SELECT from_state, to_state, sum(weight) / greatest(1, {LAST} - 2) AS w FROM used GROUP BY ALL), states AS (SELECT range AS state FROM range(7))"
TM = (
    EDGES
    + """, live AS (SELECT * FROM edges WHERE w > 0 AND from_state <> 6),
t AS (SELECT from_state, to_state, w / sum(w) OVER (PARTITION BY from_state) AS p FROM live
UNION ALL SELECT state, CASE WHEN state = 6 THEN 5 ELSE state END, 1.0 FROM states WHERE state NOT IN (SELECT from_state FROM live))"""
)
PI = """, v AS (SELECT 0 AS k, state, 1.0::DOUBLE / 7 AS value FROM states UNION ALL SELECT k + 1, to_state, sum(value * p) FROM v JOIN t ON from_state = v.state WHERE k < 200 GROUP BY k, to_state),
pi AS (SELECT s.state, coalesce(v.value, 0) AS value FROM states s LEFT JOIN v ON v.state = s.state AND k = 200)"""
CENTRES = """, centres AS (SELECT s.state, CASE s.state WHEN 5 THEN 2.5 WHEN 6 THEN 575 ELSE avg(p1) END AS centre, min(p1) AS low, max(p1) AS high FROM states s LEFT JOIN st ON st.to_state = s.state GROUP BY s.state)"""
NET = """, net AS (SELECT state, sum(x) AS net FROM (SELECT to_state AS state, w AS x FROM edges UNION ALL SELECT from_state, -w FROM edges) GROUP BY state)"""
AB = "CASE WHEN state = 'signup' THEN 'A' WHEN state = 'purchase' THEN 'B' END"
BOXES = "CASE WHEN x >= 0 AND x < 5 THEN 'A' WHEN x >= 150 AND x < 1000 THEN 'B' END"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def passages(source: str, lab: str, lag: int = 1) -> str:
    return f""", lab AS (SELECT traj, idx // {lag} AS i, {lab} AS lab FROM {source} WHERE idx % {lag} = 0),
col AS (SELECT traj, i, last_value(lab IGNORE NULLS) OVER w AS color, max(CASE WHEN lab IS NOT NULL THEN i END) OVER (PARTITION BY traj ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_in FROM lab WINDOW w AS (PARTITION BY traj ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chg AS (SELECT *, lag(color) OVER (PARTITION BY traj ORDER BY i) AS before FROM col WHERE color IS NOT NULL),
kept AS (SELECT * FROM chg WHERE before IS NULL OR before <> color),
fpt AS (SELECT * FROM (SELECT traj, i * {lag} AS idx, before || color AS direction, (i - lag(i) OVER (PARTITION BY traj ORDER BY i)) * {lag} AS fpt, i - last_in - 1 AS k, before FROM kept) WHERE before IS NOT NULL)"""


MEANS = f"SELECT direction, count(*) AS n, {r6('avg(fpt)')} AS mean, {r6('stddev_pop(fpt) / sqrt(count(*))')} AS std_err FROM fpt GROUP BY direction"


def pairs(source: str, lag: int, sliding: bool = True) -> str:
    where = "" if sliding else f" AND idx % {lag} = 0"
    return f", prs AS (SELECT from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state, {lag}) OVER (PARTITION BY traj ORDER BY idx) AS from_state FROM {source}) WHERE idx >= {lag}{where} GROUP BY ALL)"


def coloured(lab: str, lag: int, sliding: bool = True) -> str:
    where = "" if sliding else "WHERE idx % {0} = 0".format(lag)
    return f""", ch AS (SELECT traj, idx % {lag} AS r, idx, state, CASE WHEN idx >= {lag} THEN {lab} END AS lab, lag(state) OVER (PARTITION BY traj, idx % {lag} ORDER BY idx) AS from_state FROM traj {where}),
cc AS (SELECT *, last_value(lab IGNORE NULLS) OVER (PARTITION BY traj, r ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS to_color FROM ch),
cd AS (SELECT *, lag(to_color) OVER (PARTITION BY traj, r ORDER BY idx) AS from_color FROM cc),
colored AS (SELECT from_state, from_color, state AS to_state, to_color, count(*) AS n FROM cd WHERE idx >= {lag} AND to_color IS NOT NULL AND from_color IS NOT NULL GROUP BY ALL)"""


HISTORY = f""", hc0 AS (SELECT traj, idx, state, {AB} AS lab FROM traj),
hc1 AS (SELECT *, lag(state, 2) OVER (PARTITION BY traj ORDER BY idx) AS from_state, last_value(lab IGNORE NULLS) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS fc FROM hc0),
hist AS (SELECT from_state, coalesce(fc, 'U') AS from_color, state AS to_state, coalesce(lab, fc, 'U') AS to_color, count(*) AS n FROM hc1 WHERE idx >= 2 GROUP BY ALL)"""
PATHS = f""", pl AS (SELECT traj, idx, state, {BOXES} AS lab FROM traj),
pc AS (SELECT *, last_value(lab IGNORE NULLS) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS color FROM pl),
pb AS (SELECT *, lag(color) OVER (PARTITION BY traj ORDER BY idx) AS before FROM pc),
pi AS (SELECT *, sum(CASE WHEN color = 'A' AND before IS DISTINCT FROM 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS path_id FROM pb),
pk AS (SELECT *, color = 'B' AND before IS NOT DISTINCT FROM 'A' AS closes FROM pi),
path AS (SELECT traj, path_id, idx, state FROM (SELECT *, bool_or(closes) OVER (PARTITION BY traj, path_id) AS closed FROM pk WHERE color = 'A' OR closes) WHERE closed)"""


def correlation(symmetric: bool) -> str:
    p = "(avg(a * b1) + avg(b * a1)) / 2" if symmetric else "avg(a * b1)"
    parts = " UNION ALL ".join(f"SELECT {d} AS delta, a, b, lead(a, {d}) OVER w AS a1, lead(b, {d}) OVER w AS b1 FROM ab WINDOW w AS (PARTITION BY traj ORDER BY idx)" for d in (1, 2, 5))
    return f"WITH {TRAJ}, ab AS (SELECT traj, idx, (x >= 0 AND x < 5)::INT AS a, (x >= 150 AND x < 1000)::INT AS b FROM traj), l AS ({parts}) SELECT delta::BIGINT AS delta, {r6(p)} AS p FROM l WHERE b1 IS NOT NULL GROUP BY delta"


LEDGES = f", le AS (SELECT {CLUSTER.format('from_state')}::BIGINT AS from_state, {CLUSTER.format('to_state')}::BIGINT AS to_state, n / sum(n) OVER (PARTITION BY from_state) AS p FROM prs)"
CEDGES = ", ce AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state, from_color) AS p FROM colored)"
VEC = "vec AS (SELECT vec_id, label::BIGINT AS bin, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), cen AS (SELECT bin, k, avg(v) AS c FROM vec GROUP BY ALL)"


def one_way(color: str, end: str) -> str:
    return f"""WITH {TRAJ}{coloured(AB, 1)}{CEDGES}, ow AS (SELECT from_state, to_state, sum(p) AS p FROM ce WHERE from_color = '{color}' GROUP BY ALL),
nn AS (SELECT from_state, to_state, p / sum(p) OVER (PARTITION BY from_state) AS p FROM ow UNION ALL SELECT '{end}', '{end}', 1.0)
SELECT from_state, to_state, {r6('p')} AS p FROM nn"""


def iterated(matrix: str, source: int, sink: int) -> str:
    """q after 40 steps of q <- M q with both ends fixed."""
    return f""", q AS (SELECT 0 AS k, state, (state = {sink})::INT::DOUBLE AS value FROM states
UNION ALL SELECT k + 1, s.state, CASE s.state WHEN {sink} THEN 1.0 WHEN {source} THEN 0.0 ELSE sum(s.p * q.value) END FROM q JOIN (SELECT st.state, to_state, p FROM states st LEFT JOIN {matrix} ON from_state = st.state) s ON s.to_state = q.state OR (s.to_state IS NULL AND q.state = s.state) WHERE k < 40 GROUP BY k, s.state)"""


COMPLETE = ", c AS (SELECT *, max(n_iter) OVER (PARTITION BY file_idx) AS last FROM st), done AS (SELECT * FROM c WHERE n_iter < last)"
#: The coloured chain (codes 2s and 2s + 1 for state s in colours A and B) and its steady state after 300 steps.
CODED = f", cn AS (SELECT 2 * {CLUSTER.format('from_state')} + (from_color = 'B')::INT AS f, 2 * {CLUSTER.format('to_state')} + (to_color = 'B')::INT AS t, p FROM ce)"
STEADY = """, cv AS (SELECT 0 AS k, f AS s, 1.0::DOUBLE / count(*) OVER () AS v FROM (SELECT DISTINCT f FROM cn) UNION ALL SELECT k + 1, t, sum(v * p) FROM cv JOIN cn ON f = s WHERE k < 300 GROUP BY k, t),
cpi AS (SELECT s, v FROM cv WHERE k = 300)"""
#: Reversible counts over two rows, their chain with colours added, and its flux after 300 steps.
PSEUDO = """, pn AS (SELECT a, b, sum(n) AS n FROM (SELECT from_state AS a, to_state AS b, n FROM prs UNION ALL SELECT to_state, from_state, n FROM prs) GROUP BY ALL),
pt AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM pn),
pl AS (SELECT a, c AS ca, b, CASE b WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'B' ELSE c END AS cb, p FROM pt, (VALUES ('A'), ('B')) x(c) WHERE NOT (c = 'A' AND a = 'purchase') AND NOT (c = 'B' AND a = 'signup')),
pv AS (SELECT 0 AS k, a AS s, ca AS c, 1.0::DOUBLE / count(*) OVER () AS v FROM (SELECT DISTINCT a, ca FROM pl) UNION ALL SELECT k + 1, b, cb, sum(v * p) FROM pv JOIN pl ON a = s AND ca = c WHERE k < 300 GROUP BY k, b, cb),
pf AS (SELECT a AS from_state, ca AS from_color, b AS to_state, cb AS to_color, v * p AS f FROM pl JOIN pv ON a = s AND ca = c WHERE k = 300)"""


def passage_shares(matrix: str, start: int, end: int, n: int) -> str:
    """Shares of first passages at times 1 to n from one state to another of a matrix (f, t, p)."""
    return f""", fp AS (SELECT 0 AS k, f AS s, p AS v FROM {matrix} WHERE t = {end} UNION ALL SELECT k + 1, f, sum(p * v) FROM fp JOIN {matrix} ON t = s AND s <> {end} WHERE k < {n - 1} GROUP BY k, f),
fs AS (SELECT n.k, coalesce(v, 0) AS v FROM (SELECT range AS k FROM range({n})) n LEFT JOIN (SELECT k, v FROM fp WHERE s = {start}) x ON x.k = n.k)
SELECT 0.0::DOUBLE AS t, 0.0::DOUBLE AS density UNION ALL SELECT (k + 1)::DOUBLE, {r6('v / (SELECT sum(v) FROM fs)')} FROM fs"""


def directed(color: str, start: int, end: int) -> str:
    return f"WITH RECURSIVE {TRAJ}{coloured(AB, 1)}{CEDGES}{CODED}, ow AS (SELECT f // 2 AS f, t // 2 AS t, sum(p) AS p FROM cn WHERE f % 2 = {'AB'.index(color)} AND f // 2 <> {end} AND (t // 2 = {end} OR t % 2 = {'AB'.index(color)}) GROUP BY ALL)" + passage_shares("ow", start, end, 40)


def lagged(lag: int) -> str:
    """Pairs over one or two parents, recycled walkers among them."""
    s = f"WITH {SEG}, s AS (SELECT file_idx, n_iter, seg_id, weight, p0, p1, CASE WHEN p1 > 150 THEN -1 ELSE parent_id END AS parent_id FROM seg), z AS (SELECT file_idx, n_iter, min_by(p0, seg_id) AS p0 FROM s GROUP BY ALL), "
    up = "b.file_idx = a.file_idx AND b.n_iter = a.n_iter - 1 AND b.seg_id = a.parent_id AND a.parent_id >= 0"
    if lag == 1:
        h = f"h AS (SELECT a.*, CASE WHEN a.parent_id < 0 THEN a.weight END AS warp, b.p0 AS far FROM s a LEFT JOIN s b ON {up})"
    else:
        h = f"h AS (SELECT a.*, CASE WHEN a.parent_id < 0 THEN a.weight WHEN b.parent_id < 0 THEN b.weight END AS warp, c.p0 AS far FROM s a LEFT JOIN s b ON {up} LEFT JOIN s c ON c.file_idx = b.file_idx AND c.n_iter = b.n_iter - 1 AND c.seg_id = b.parent_id AND b.parent_id >= 0)"
    return f"{s}{h}, o AS (SELECT far AS x, p1 AS y, weight FROM h WHERE warp IS NULL AND far IS NOT NULL UNION ALL SELECT -1, p1, weight FROM h WHERE warp IS NOT NULL UNION ALL SELECT z.p0, -2, warp FROM h JOIN z ON z.file_idx = h.file_idx AND z.n_iter = h.n_iter - {lag} WHERE warp IS NOT NULL) SELECT count(*) AS n, {r6('sum(weight)')} AS w, {r6('sum(x)')} AS start_sum, {r6('sum(y)')} AS end_sum FROM o"


def chained(depth: int) -> str:
    """Histories step by step: c (keys, step, at, up), a row for each ancestor that the table has."""
    return f"""WITH RECURSIVE {SEG}, s AS (SELECT file_idx, n_iter, seg_id, weight, p0, p1, CASE WHEN p1 > 150 THEN -1 WHEN (seg_id + n_iter) % 4 = 0 THEN seg_id + 3 ELSE seg_id END AS parent_id FROM seg),
c AS (SELECT file_idx, n_iter, seg_id, 0 AS step, seg_id AS at, parent_id AS up FROM s UNION ALL SELECT c.file_idx, c.n_iter, c.seg_id, step + 1, s.seg_id, s.parent_id FROM c JOIN s ON s.file_idx = c.file_idx AND s.n_iter = c.n_iter - step - 1 AND s.seg_id = up WHERE up >= 0 AND step < {depth})"""


def lagged_far(lag: int) -> str:
    return f"""{chained(lag)}, z AS (SELECT file_idx, n_iter, min_by(p0, seg_id) AS p0 FROM s GROUP BY ALL),
h AS (SELECT s.*, f.p0 AS far, w.weight AS warp FROM s LEFT JOIN c a ON a.file_idx = s.file_idx AND a.n_iter = s.n_iter AND a.seg_id = s.seg_id AND a.step = {lag} LEFT JOIN s f ON f.file_idx = s.file_idx AND f.n_iter = s.n_iter - {lag} AND f.seg_id = a.at
LEFT JOIN c r ON r.file_idx = s.file_idx AND r.n_iter = s.n_iter AND r.seg_id = s.seg_id AND r.step < {lag} AND r.up < 0 LEFT JOIN s w ON w.file_idx = s.file_idx AND w.n_iter = s.n_iter - r.step AND w.seg_id = r.at),
o AS (SELECT far AS x, p1 AS y, weight FROM h WHERE warp IS NULL AND far IS NOT NULL UNION ALL SELECT -1, p1, weight FROM h WHERE warp IS NOT NULL UNION ALL SELECT z.p0, -2, warp FROM h JOIN z ON z.file_idx = h.file_idx AND z.n_iter = h.n_iter - {lag} WHERE warp IS NOT NULL)
SELECT floor(x / 10)::BIGINT AS from_bin, floor(y / 10)::BIGINT AS to_bin, count(*) AS n, {r6('sum(weight)')} AS w FROM o GROUP BY ALL"""


PARTS = """WITH RECURSIVE pe AS (SELECT a, b, sum(q)::DOUBLE AS w FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS a, l_partkey AS b, l_quantity AS q FROM lineitem) WHERE a IS NOT NULL AND q <= 3 GROUP BY a, b),
pr AS (SELECT a AS i, a AS j FROM pe UNION SELECT b, b FROM pe UNION SELECT i, b FROM pr JOIN pe ON a = j)"""


FINE = f"""WITH RECURSIVE {SEG}, fc AS (SELECT 4 * from_cluster + (CASE WHEN p0 >= 60 THEN 3 WHEN p0 >= 20 THEN 2 WHEN p0 >= 5 THEN 1 ELSE 0 END) AS a, 4 * to_cluster + (CASE WHEN p1 >= 60 THEN 3 WHEN p1 >= 20 THEN 2 WHEN p1 >= 5 THEN 1 ELSE 0 END) AS b FROM seg WHERE p0 IS NOT NULL AND p1 IS NOT NULL),
ft AS (SELECT a, b, count(*) / sum(count(*)) OVER (PARTITION BY a) AS p FROM fc WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b), fs AS (SELECT a AS s FROM ft UNION SELECT b FROM ft)"""


GIVEN = f"""{SEG}, gs AS (SELECT 4 * from_cluster + (CASE WHEN p0 >= 60 THEN 3 WHEN p0 >= 20 THEN 2 WHEN p0 >= 5 THEN 1 ELSE 0 END) AS state, p1 FROM seg WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND from_cluster IS NOT NULL),
g AS (SELECT state, avg(p1) AS h, stddev_pop(p1) AS v, count(*) / sum(count(*)) OVER () AS pi FROM gs GROUP BY state)"""
FLUX_T = "sum(CASE WHEN p1 > 150 AND p1 < 1000 THEN weight ELSE 0 END)"

#: Mean steps between labels after 600 rounds of value <- 1 + T value.
PASSAGE = f"WITH RECURSIVE {TRAJ}{pairs('traj', 1)}{LEDGES}, g AS (SELECT 0 AS k, i, j, 0.0::DOUBLE AS v FROM (SELECT range AS i FROM range(5)), (SELECT range AS j FROM range(5)) UNION ALL SELECT k + 1, le.from_state, j, CASE WHEN le.from_state = j THEN 0 ELSE 1 + sum(CASE WHEN to_state = j THEN 0 ELSE p * v END) END FROM g JOIN le ON to_state = i WHERE k < 600 GROUP BY k, le.from_state, j)"
COMMUTE = f"{PASSAGE}, c AS (SELECT a.i, a.j, a.v + b.v AS c FROM g a JOIN g b ON b.i = a.j AND b.j = a.i AND b.k = 600 WHERE a.k = 600 AND a.i < a.j)"

#: Segments' values, and what a bin of them holds: centres are in e (k, c).
VALUED = f"WITH {SEG}, vr AS (SELECT p1 AS value, weight AS pi, (p1 - p0) * (p1 - p0) AS var FROM seg WHERE p1 IS NOT NULL), vm AS (SELECT min(value) AS lo, max(value) AS hi FROM vr)"
IN_BINS = f"""vb AS (SELECT value, pi, var, (SELECT count(*) FROM (SELECT (c + lead(c) OVER (ORDER BY k)) / 2 AS edge FROM e) WHERE edge < value) AS bin FROM vr),
va AS (SELECT bin, count(*) AS n, sum(pi) AS weight, var_pop(value) AS variance, sqrt(sum(pi) * sum(pi * var)) AS a FROM vb GROUP BY bin)
SELECT bin, n, {r6('weight')} AS weight, {r6('variance')} AS variance, {r6('a / sum(a) OVER ()')} AS share FROM va"""

SQL: dict[str, str] = {
    "load_segments": f"WITH {SEG}, c AS (SELECT *, max(n_iter) OVER (PARTITION BY file_idx) AS last FROM seg) SELECT file_idx, seg_id, {r6('p0')} AS p0, {r6('p1')} AS p1, from_label, to_label, {r6('weight')} AS weight FROM c WHERE n_iter = 3 AND n_iter < last",
    "iteration_counts": f"WITH {SEG}, c AS (SELECT n_iter, count(*) AS n_segments, row_number() OVER (ORDER BY n_iter) AS place FROM seg GROUP BY n_iter) SELECT n_iter, n_segments FROM c WHERE n_iter = place",
    "iteration_counts_range": f"WITH {SEG} SELECT n_iter, count(*) AS n_segments FROM seg WHERE n_iter BETWEEN 5 AND 20 GROUP BY n_iter",
    "drop_last_iteration": f"WITH {SEG}, c AS (SELECT *, max(n_iter) OVER (PARTITION BY file_idx) AS last FROM seg) SELECT file_idx, count(*) AS n, max(n_iter) AS last_iter FROM c WHERE n_iter < last GROUP BY file_idx",
    "pick_iterations": f"WITH {SEG} SELECT n_iter, count(*) AS n, {r6('sum(p1)')} AS p1_sum FROM seg WHERE n_iter IN (2, 4, 8) GROUP BY n_iter",
    "until_budget": f"WITH {SEG}, c AS (SELECT n_iter, count(*) AS n FROM seg GROUP BY n_iter), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n_iter DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT n_iter, n FROM b WHERE before < 500",
    "parent_history_k3": f"WITH {SEG} SELECT a.n_iter, count(d.seg_id) AS n, {r6('sum(d.weight)')} AS w3, {r6('sum(b.p1)')} AS p1_sum, {r6('sum(d.p1)')} AS p3_sum FROM seg a LEFT JOIN seg b ON b.file_idx = a.file_idx AND b.n_iter = a.n_iter - 1 AND b.seg_id = a.parent_id LEFT JOIN seg c ON c.file_idx = b.file_idx AND c.n_iter = b.n_iter - 1 AND c.seg_id = b.parent_id LEFT JOIN seg d ON d.file_idx = c.file_idx AND d.n_iter = c.n_iter - 1 AND d.seg_id = c.parent_id WHERE a.n_iter >= 4 GROUP BY a.n_iter",
    "start_from_parent": f"WITH {SEG} SELECT a.n_iter, count(*) AS n, {r6('sum(coalesce(b.p1, -1))')} AS start_sum FROM seg a LEFT JOIN seg b ON b.file_idx = a.file_idx AND b.n_iter = a.n_iter - 1 AND b.seg_id = a.parent_id GROUP BY a.n_iter",
    "masked_transitions": f"WITH {SEG} SELECT n_iter, count(*) AS n, {r6('sum(CASE WHEN p1 > 100 THEN 0 ELSE weight END)')} AS w FROM seg GROUP BY n_iter",
    "warped_segments": f"WITH {SEG} SELECT n_iter, count(*) AS n, {r6('sum(weight)')} AS w FROM seg WHERE p1 > 150 AND p1 < 1000 GROUP BY n_iter",
    "structure_references": f"WITH {SEG}{COMPLETE} SELECT seg_id, 'hdf:f' || file_idx || ':' || n_iter || ':' || seg_id AS ref FROM done",
    "box_basis_target": "SELECT event_id, value > 0 AND value < 5 AS in_basis, value > 150 AND value < 1000 AS in_target FROM events",
    "interval_union_nd": "SELECT event_id, (value >= 1 AND value < 2) OR (value >= 3 AND value < 4) OR (value >= 10 AND value < 40) AS in_union, (value >= 0 AND value < 20 AND user_id >= 0 AND user_id < 5) OR (value >= 20 AND value < 50 AND user_id >= 5 AND user_id < 15) AS in_product FROM events WHERE value IS NOT NULL",
    "label_dictionary": f"WITH {TRAJ}, f AS (SELECT DISTINCT ON (state) state, traj, idx FROM traj ORDER BY state, traj, idx) SELECT state AS label, row_number() OVER (ORDER BY traj, idx) - 1 AS code FROM f",
    "coarse_macrostates": f"WITH {OTRAJ} SELECT CASE WHEN state IN ('F1-URGENT', 'O1-URGENT') THEN 'F1-URGENT' WHEN state IN ('F5-LOW', 'O5-LOW') THEN 'F5-LOW' ELSE state END AS state, count(*) AS n FROM otraj GROUP BY 1",
    "rectilinear_bins": "SELECT bin::BIGINT AS bin, count(*) AS n FROM (SELECT CASE WHEN value >= 0 AND value < 600 AND user_id >= 0 THEN 3 * (CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 80 THEN 2 ELSE 3 END) + CASE WHEN user_id < 4 THEN 0 WHEN user_id < 9 THEN 1 ELSE 2 END END AS bin FROM events) GROUP BY bin",
    "bin_counts": "SELECT label::BIGINT AS bin, count(*) AS n, count(*) >= 50 AS filled FROM embeddings GROUP BY label",
    "flux_matrix": f"WITH {EDGES} SELECT from_state, to_state, {r6('w')} AS w FROM edges",
    "flux_matrix_total_one": f"WITH {EDGES} SELECT from_state, to_state, {r6('w / (SELECT sum(w) FROM edges)')} AS w FROM edges",
    "flux_matrix_by_iter": f"WITH {EDGES} SELECT n_iter, from_state, to_state, {r6('sum(weight)')} AS w FROM used GROUP BY ALL",
    "flux_special_states": f"WITH {SEG} SELECT from_state, to_state, count(*) AS n FROM st GROUP BY ALL",
    "flux_pcoord1d": f"WITH {SEG}{COMPLETE}, b AS (SELECT n_iter, CASE WHEN p0 < 0 THEN -1 WHEN p0 >= 200 THEN 10 ELSE floor(p0 / 20) END::BIGINT AS from_state, CASE WHEN p1 < 0 THEN -1 WHEN p1 >= 200 THEN 10 ELSE floor(p1 / 20) END::BIGINT AS to_state, weight / sum(weight) OVER (PARTITION BY n_iter) AS w FROM done) SELECT from_state, to_state, {r6('sum(w) / (SELECT count(DISTINCT n_iter) FROM done)')} AS w FROM b GROUP BY ALL",
    "cluster_centers_stats": f"WITH {EDGES}{CENTRES} SELECT state, {r6('centre')} AS centre, {r6('low')} AS low, {r6('high')} AS high FROM centres",
    "sorted_states": f"WITH {EDGES}{CENTRES} SELECT state, row_number() OVER (ORDER BY state >= 5, centre NULLS LAST, state) - 1 AS place FROM centres",
    "flux_sorted": f"WITH {EDGES}{CENTRES}, s AS (SELECT state, row_number() OVER (ORDER BY state >= 5, centre NULLS LAST, state) - 1 AS place FROM centres) SELECT a.place AS from_state, b.place AS to_state, {r6('w')} AS w FROM edges JOIN s a ON a.state = from_state JOIN s b ON b.state = to_state",
    "flux_profile": f"WITH {EDGES}{CENTRES}{NET}, s AS (SELECT state, row_number() OVER (ORDER BY centre NULLS FIRST, state) - 1 AS place FROM centres) SELECT place, s.state, {r6('sum(coalesce(net, 0)) OVER (ORDER BY place)')} AS flux FROM s LEFT JOIN net ON net.state = s.state",
    "flux_profile_committor": f"WITH RECURSIVE {TM}{NET}{iterated('t', 5, 6)}, s AS (SELECT state, row_number() OVER (ORDER BY round(value, 9) DESC, state) - 1 AS place FROM q WHERE k = 40) SELECT place, s.state, {r6('sum(coalesce(net, 0)) OVER (ORDER BY place)')} AS flux FROM s LEFT JOIN net ON net.state = s.state",
    "coarse_flux_profile": f"WITH {EDGES}{CENTRES}, b AS (SELECT state, CASE WHEN centre < 0 THEN -1 WHEN centre >= 100 THEN 20 ELSE floor(centre / 5) END::BIGINT AS bin FROM centres WHERE state < 5 AND centre IS NOT NULL), e AS (SELECT x.bin AS f, y.bin AS t, w FROM edges JOIN b x ON x.state = from_state JOIN b y ON y.state = to_state), n AS (SELECT bin, sum(v) AS net FROM (SELECT t AS bin, w AS v FROM e UNION ALL SELECT f, -w FROM e) GROUP BY bin) SELECT bin, {r6('sum(net) OVER (ORDER BY bin)')} AS flux FROM n",
    "flux_profile_fit": f"WITH {EDGES}{CENTRES}{NET}, s AS (SELECT state, centre, row_number() OVER (ORDER BY centre NULLS FIRST, state) - 1 AS place FROM centres), p AS (SELECT centre, sum(coalesce(net, 0)) OVER (ORDER BY place) AS flux FROM s LEFT JOIN net ON net.state = s.state) SELECT {r6('regr_slope(flux, centre)')} AS slope, {r6('regr_intercept(flux, centre)')} AS intercept, {r6('corr(flux, centre)')} AS r, {r6('sqrt((1 - corr(flux, centre) ^ 2) * regr_syy(flux, centre) / regr_sxx(flux, centre) / (regr_count(flux, centre) - 2))')} AS stderr, regr_slope(flux, centre) > 0 AS overcorrected FROM p",
    "smoothed_flux": f"WITH {SEG}, f AS (SELECT n_iter, {FLUX_T} AS flux FROM seg GROUP BY n_iter) SELECT n_iter, {r6('avg(flux) OVER w')} AS mean, {r6('stddev_pop(flux) OVER w')} AS std FROM f WINDOW w AS (ORDER BY n_iter ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
    "direct_target_flux": f"WITH {SEG} SELECT n_iter, {r6(FLUX_T + ' / 2')} AS flux FROM seg GROUP BY n_iter",
    "windowed_direct_flux": f"WITH {SEG}, f AS (SELECT n_iter, {FLUX_T} AS flux FROM seg GROUP BY n_iter) SELECT n_iter, {r6('avg(flux) OVER (ORDER BY n_iter ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS flux FROM f",
    "block_validation_flux": f"WITH {SEG}, g AS (SELECT *, (n_iter - 1) // ({LAST} // 4) AS b FROM st WHERE n_iter < {LAST}), u AS (SELECT *, b % 2 AS group_id FROM g WHERE b < 4), k AS (SELECT group_id, count(DISTINCT n_iter) AS n FROM u GROUP BY ALL) SELECT group_id, from_state, to_state, {r6('sum(weight) / any_value(n)')} AS w FROM u JOIN k USING (group_id) GROUP BY ALL",
    "start_state_weights": f"WITH RECURSIVE {TM}{PI}{COMPLETE} SELECT n_iter, seg_id, to_state, {r6('weight * value / sum(weight) OVER (PARTITION BY to_state)')} AS start_weight FROM done JOIN pi ON pi.state = to_state WHERE to_state < 5 AND value > 0",
    "transition_matrix": f"WITH {TM} SELECT from_state, to_state, {r6('p')} AS p FROM t",
    "eq_transition_matrix": f"WITH {EDGES} SELECT from_state, to_state, {r6('w / sum(w) OVER (PARTITION BY from_state)')} AS p FROM edges WHERE from_state < 5 AND to_state < 5 AND w > 0",
    "steady_state_power": f"WITH RECURSIVE {TM}{PI} SELECT state, {r6('value')} AS value FROM pi",
    "target_flux": f"WITH RECURSIVE {TM}{PI} SELECT {r6('coalesce(sum(p * value), 0) / 2')} AS flux FROM t JOIN pi ON pi.state = from_state WHERE from_state <> 6 AND to_state = 6",
    "vector_step": f"WITH {TM}, a AS (SELECT to_state AS state, sum(p / 7) AS value FROM t GROUP BY to_state) SELECT to_state AS state, {r6('sum(p * value)')} AS value FROM t JOIN a ON a.state = from_state GROUP BY to_state",
    "committor_iter": f"WITH RECURSIVE {TM}{iterated('t', 5, 6)} SELECT state, {r6('value')} AS value FROM q WHERE k = 40",
    "backward_committor_iter": f"WITH RECURSIVE {TM}{PI}, bt AS (SELECT to_state AS from_state, from_state AS to_state, p * value / sum(p * value) OVER (PARTITION BY to_state) AS p FROM t JOIN pi ON pi.state = from_state WHERE p * value > 0){iterated('bt', 6, 5)} SELECT state, {r6('value')} AS value FROM q WHERE k = 40",
    "evolve_target_flux": f"WITH RECURSIVE {TM}, e AS (SELECT 0 AS k, 5::BIGINT AS state, 1.0::DOUBLE AS value UNION ALL SELECT k + 1, to_state, sum(value * p) FROM e JOIN t ON from_state = e.state WHERE k < 20 GROUP BY k, to_state), s AS (SELECT range AS step FROM range(21)) SELECT step, {r6('coalesce(sum(value * p), 0) / 2')} AS flux FROM s LEFT JOIN (SELECT k, value, p FROM e JOIN t ON from_state = e.state AND from_state <> 6 AND to_state = 6) x ON x.k = step GROUP BY step",
    "is_reachable": f"WITH RECURSIVE {EDGES}, r AS (SELECT state AS i, state AS j FROM states UNION SELECT i, to_state FROM r JOIN edges ON from_state = j WHERE w > 0) SELECT a.state AS i, b.state AS j, (a.state, b.state) IN (SELECT (i, j) FROM r) AS reached FROM states a, states b",
    "fpt_events": f"WITH {TRAJ}{passages('traj', BOXES)} SELECT traj, idx, direction, fpt FROM fpt",
    "mean_fpt": f"WITH {TRAJ}{passages('traj', BOXES)} {MEANS}",
    "mean_fpt_lag2": f"WITH {TRAJ}{passages('traj', BOXES, 2)} {MEANS}",
    "mean_fpt_discrete": f"WITH {TRAJ}{passages('traj', AB)} {MEANS}",
    "event_durations": f"WITH {TRAJ}{passages('traj', BOXES)} SELECT traj, idx, direction, k + 1 AS steps, 2 * k + 1 AS steps_compat FROM fpt",
    "paths_ab": f"WITH {TRAJ}{PATHS} SELECT traj, path_id, idx, state FROM path",
    "path_lengths": f"WITH {TRAJ}{PATHS} SELECT traj, path_id, count(*) - 1 AS steps FROM path GROUP BY ALL",
    "corr_function": correlation(False),
    "corr_function_symmetric": correlation(True),
    "count_matrix": f"WITH {TRAJ}{pairs('traj', 1)} SELECT * FROM prs",
    "count_matrix_orders": f"WITH {OTRAJ}{pairs('otraj', 1)} SELECT * FROM prs",
    "count_matrix_lag3": f"WITH {TRAJ}{pairs('traj', 3)} SELECT * FROM prs",
    "count_matrix_nonsliding": f"WITH {TRAJ}{pairs('traj', 3, False)} SELECT * FROM prs",
    "mle_transition_matrix": f"WITH ttraj AS (SELECT conv_id AS traj, turn AS idx, role AS state FROM conversations), prs AS (SELECT from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state) OVER (PARTITION BY traj ORDER BY idx) AS from_state FROM ttraj) WHERE idx >= 1 AND from_state IS NOT NULL AND state IS NOT NULL GROUP BY ALL) SELECT from_state, to_state, {r6('n / sum(n) OVER (PARTITION BY from_state)')} AS p FROM prs",
    "symmetric_tmatrix": f"WITH {TRAJ}{pairs('traj', 3)}, s AS (SELECT from_state, to_state, sum(n) AS n FROM (SELECT * FROM prs UNION ALL SELECT to_state, from_state, n FROM prs) GROUP BY ALL) SELECT from_state, to_state, {r6('n / sum(n) OVER (PARTITION BY from_state)')} AS p FROM s",
    "colored_count_matrix": f"WITH {TRAJ}{coloured(AB, 3)} SELECT * FROM colored",
    "colored_count_nonsliding": f"WITH {TRAJ}{coloured(AB, 3, False)} SELECT * FROM colored",
    "colored_tmatrix": f"WITH {TRAJ}{coloured(AB, 1)}{CEDGES} SELECT from_state, from_color, to_state, to_color, {r6('p')} AS p FROM ce",
    "history_color_counts": f"WITH {TRAJ}{HISTORY} SELECT * FROM hist",
    "history_color_fractional": f"WITH RECURSIVE {TRAJ}{HISTORY}{pairs('traj', 2)}{PSEUDO}, u AS (SELECT h.from_state, x.from_color, h.to_state, x.to_color, n * f / sum(f) OVER (PARTITION BY h.from_state, h.to_state, h.to_color) AS n FROM hist h JOIN pf x ON x.from_state = h.from_state AND x.to_state = h.to_state AND (h.to_color = 'U' OR h.to_color = x.to_color) WHERE h.from_color = 'U' AND f > 0) SELECT from_state, from_color, to_state, to_color, {r6('sum(n)')} AS n FROM (SELECT from_state, from_color, to_state, to_color, n::DOUBLE AS n FROM hist WHERE from_color <> 'U' UNION ALL SELECT * FROM u) GROUP BY ALL",
    "path_sequences": f"WITH p AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS path FROM conversations WHERE role IS NOT NULL GROUP BY conv_id), c AS (SELECT path, min(conv_id) AS traj, count(*) AS n, count(*) / sum(count(*)) OVER () AS weight FROM p GROUP BY path), s AS (SELECT traj, n, weight, string_split(path, '>') AS x FROM c) SELECT traj, i - 1 AS place, x[i] AS state, n, {r6('weight')} AS weight FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)",
    "nearest_of_many": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT vec_id AS state, x AS c FROM v WHERE vec_id % 20 = 0), p AS (SELECT v.vec_id, state, sqrt(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v, c) SELECT vec_id, min_by(state, struct_pack(d := d, s := state)) AS state, {r6('min(d)')} AS distance FROM p GROUP BY vec_id",
    "value_bins_uniform": f"{VALUED}, e AS (SELECT range AS k, lo + (range + 0.5) * (hi - lo) / 9 AS c FROM range(9), vm), {IN_BINS}",
    "value_bins_equal": f"{VALUED}, f AS (SELECT least(floor((value - lo) / (hi - lo) * 200), 199) AS place, sqrt(sum(pi) * sum(pi * var)) AS m FROM vr, vm GROUP BY place), h AS (SELECT place, sum(m) OVER (ORDER BY place) / sum(m) OVER () AS share FROM f), e AS (SELECT DISTINCT min(place) AS k, (SELECT lo FROM vm) + (min(place) + 0.5) * (SELECT hi - lo FROM vm) / 200 AS c FROM h, range(6) t(i) WHERE share >= (i + 0.5) / 6 GROUP BY i), {IN_BINS}",
    "discrepancy": f"WITH RECURSIVE {TM}{PI.replace('k < 200', 'k < 2000').replace('k = 200', 'k = 2000')}, r AS (SELECT state, (state = 6)::INT - (SELECT value FROM pi WHERE state = 6) AS b FROM states), ph AS (SELECT 0 AS k, state, b AS v FROM r UNION ALL SELECT k + 1, r.state, any_value(b) + sum(p * v) FROM ph JOIN t ON to_state = ph.state JOIN r ON r.state = from_state WHERE k < 2000 GROUP BY k, r.state), hk AS (SELECT state, v AS h FROM ph WHERE k = 2000), o AS (SELECT from_state, sum(p * h) AS th, sum(p * h * h) AS thh FROM t JOIN hk ON to_state = hk.state GROUP BY from_state) SELECT hk.state, {r6('h')} AS h, {r6('sqrt(greatest(thh - th * th, 0))')} AS v, {r6('value')} AS pi FROM hk JOIN o ON from_state = hk.state JOIN pi ON pi.state = hk.state",
    "fine_passage_times": f"{FINE}, w AS (SELECT 0 AS k, s AS source, s AS z, 1.0::DOUBLE AS v FROM (VALUES (12), (3)) x(s) UNION ALL SELECT k + 1, source, b, sum(v * p) FROM w JOIN ft ON a = z WHERE k < 24 AND (k = 0 OR z <> 11) GROUP BY k, source, b) SELECT source::BIGINT AS source, k::BIGINT AS step, {r6('v')} AS p FROM w WHERE k > 0 AND z = 11",
    "path_counts": f"WITH p AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS path FROM conversations GROUP BY conv_id), c AS (SELECT path, count(*) AS n FROM p GROUP BY path) SELECT path, n, {r6('n / sum(n) OVER ()')} AS weight FROM c",
    "ensemble_union": f"WITH {TRAJ}, {OTRAJ} SELECT traj, count(*) AS n, {r6('sum(x)')} AS x_sum FROM (SELECT 'a:' || traj AS traj, x FROM traj UNION ALL SELECT 'b:' || traj, x FROM otraj) GROUP BY traj",
    "pseudo_color_matrix": f"WITH {TRAJ}{pairs('traj', 1)}{LEDGES} SELECT from_state, c AS from_color, to_state, CASE to_state WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE c END AS to_color, {r6('p')} AS p FROM le, (VALUES ('A'), ('B')) x(c) WHERE NOT (c = 'A' AND from_state = 2) AND NOT (c = 'B' AND from_state = 3)",
    "tmatrix_ab": one_way("A", "purchase"),
    "tmatrix_ba": one_way("B", "signup"),
    "entry_flux_distribution": f"WITH {TRAJ}{coloured('CASE WHEN state IN (' + chr(39) + 'signup' + chr(39) + ', ' + chr(39) + 'view' + chr(39) + ') THEN ' + chr(39) + 'A' + chr(39) + ' WHEN state IN (' + chr(39) + 'purchase' + chr(39) + ', ' + chr(39) + 'error' + chr(39) + ') THEN ' + chr(39) + 'B' + chr(39) + ' END', 1)}, e AS (SELECT to_state AS state, sum(n) AS n FROM colored WHERE from_color = 'A' AND to_color = 'B' GROUP BY ALL) SELECT state, {r6('n / (SELECT sum(n) FROM e)')} AS p FROM e",
    "folded_populations": f"WITH RECURSIVE {TRAJ}{coloured(AB, 1)}{CEDGES}{CODED}{STEADY} SELECT range AS state, {r6('coalesce(sum(v), 0)')} AS value FROM range(5) LEFT JOIN cpi ON s // 2 = range GROUP BY range",
    "commute_time_min": f"{COMMUTE} SELECT i, j, {r6('c')} AS commute FROM c ORDER BY c, i, j LIMIT 1",
    "commute_time_max": f"{COMMUTE} SELECT i, j, {r6('c')} AS commute FROM c ORDER BY c DESC, i, j LIMIT 1",
    "nearest_center": f"WITH {VEC}, d AS (SELECT vec_id, cen.bin AS state, sqrt(sum((v - c) ^ 2)) AS d FROM vec JOIN cen USING (k) GROUP BY ALL) SELECT vec_id, state, {r6('d')} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, state) = 1",
    "nearest_center_stratified": f"WITH {VEC}, two AS (SELECT bin, vec_id % 2 AS l, k, avg(v) AS c FROM vec GROUP BY ALL), num AS (SELECT bin, l, row_number() OVER (ORDER BY bin, l) - 1 AS state FROM (SELECT DISTINCT bin, l FROM two)), d AS (SELECT vec_id, state, sqrt(sum((v - c) ^ 2)) AS d FROM vec JOIN two USING (bin, k) JOIN num USING (bin, l) GROUP BY ALL) SELECT vec_id, state, {r6('d')} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, state) = 1",
    "nearest_bin": f"WITH {VEC}, n AS (SELECT label::BIGINT AS bin, count(*) >= ((SELECT count(*) FROM embeddings) + 9) // 10 AS filled FROM embeddings GROUP BY label), d AS (SELECT a.bin, b.bin AS bin_to, sum((a.c - b.c) ^ 2) AS d FROM cen a JOIN cen b USING (k) WHERE a.bin IN (SELECT bin FROM n WHERE NOT filled) AND b.bin IN (SELECT bin FROM n WHERE filled) GROUP BY ALL) SELECT bin, bin AS bin_to FROM n WHERE filled UNION ALL (SELECT bin, bin_to FROM d QUALIFY row_number() OVER (PARTITION BY bin ORDER BY d, bin_to) = 1)",
    "state_offsets": "WITH n AS (SELECT label::BIGINT AS bin, count(*) AS n FROM embeddings GROUP BY label) SELECT bin, n, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM n",
    "optimized_uniform_bins": f"WITH {GIVEN}, c AS (SELECT state, sum(pi * v) OVER (ORDER BY h, state ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM g) SELECT state, greatest(ceil(total / (SELECT max(total) FROM c) * 5) - 1, 0)::BIGINT AS bin FROM c",
    "optimized_bin_lookup": f"WITH {SEG}, b AS (SELECT CASE WHEN p1 > 150 AND p1 < 1000 THEN 4 WHEN p1 > 0 AND p1 < 5 THEN 3 ELSE CASE to_cluster WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE -1 END END::BIGINT AS bin FROM seg) SELECT bin, count(*) AS n FROM b GROUP BY bin",
    "target_reached": f"WITH {SEG}, c AS (SELECT *, max(n_iter) OVER (PARTITION BY file_idx) AS last FROM seg) SELECT count(*) > 0 AS reached FROM c WHERE n_iter < last AND p1 > 150 AND p1 < 1000",
    "end_coordinates": f"WITH {SEG} SELECT n_iter, count(*) AS n, {r6('sum(p1)')} AS x_sum FROM seg WHERE p1 <= 100 GROUP BY n_iter",
    "lagged_pairs": lagged(1),
    "history_trajectories": f"WITH {SEG} SELECT a.file_idx, a.seg_id, count(b.seg_id) AS n, {r6('sum(b.p1)')} AS x_sum FROM seg a JOIN seg b ON b.file_idx = a.file_idx AND b.seg_id = a.seg_id AND b.n_iter BETWEEN 9 AND 12 WHERE a.n_iter = 12 GROUP BY ALL",
    "parsed_labels": f"WITH {SEG}{COMPLETE} SELECT n_iter, 'b' || to_cluster || '_s' || seg_id AS label, to_cluster::BIGINT AS bin, seg_id AS seg, {r6('p1')} AS p1 FROM done",
    "structure_hash_states": f"WITH {SEG}{COMPLETE}, h AS (SELECT n_iter, seg_id, to_state, md5(printf('%.2f', p0) || ',' || printf('%.2f', p1)) AS hash FROM done) SELECT n_iter, seg_id, hash, min(to_state) OVER (PARTITION BY hash) AS state FROM h",
    "normalized_vector": f"WITH {TRAJ}, v AS (SELECT state, sum(x) AS v FROM traj GROUP BY state) SELECT state, {r6('CASE WHEN (SELECT sum(v) FROM v) = 0 THEN v ELSE v / (SELECT sum(v) FROM v) END')} AS value FROM v",
    "checked_tmatrix": f"WITH {TM} SELECT bool_and(ok) AS ok FROM (SELECT min(p) >= 0 AND abs(sum(p) - 1) <= 1e-6 AS ok FROM t GROUP BY from_state)",
    "evolve_probability": f"WITH RECURSIVE {TM}, e AS (SELECT 0 AS k, state, 1.0::DOUBLE / 7 AS value FROM states UNION ALL SELECT k + 1, to_state, sum(value * p) FROM e JOIN t ON from_state = e.state WHERE k < 30 GROUP BY k, to_state), s AS (SELECT range AS step FROM range(0, 31, 10)) SELECT step, states.state, {r6('coalesce(value, 0)')} AS p FROM s CROSS JOIN states LEFT JOIN e ON e.k = step AND e.state = states.state",
    "pseudo_flux": f"WITH RECURSIVE {TRAJ}{pairs('traj', 2)}{PSEUDO} SELECT from_state, from_color, to_state, to_color, {r6('f')} AS f FROM pf WHERE f > 0",
    "trajectory_shapes": f"WITH {TRAJ} SELECT traj, count(*) AS n_snapshots, 1::BIGINT AS n_variables FROM traj GROUP BY traj",
    "sorted_together": f"WITH {TRAJ}, c AS (SELECT traj, count(*) AS n, sum(x) AS x_sum FROM traj GROUP BY traj) SELECT n, traj, {r6('x_sum')} AS x_sum, row_number() OVER (ORDER BY n DESC, traj) - 1 AS place FROM c",
    "macrostate_populations": f"WITH RECURSIVE {TRAJ}{coloured(AB, 1)}{CEDGES}{CODED}{STEADY} SELECT {r6('sum(CASE WHEN s // 2 = 3 THEN v ELSE 0 END)')} AS pop_a, {r6('sum(CASE WHEN s // 2 = 2 THEN v ELSE 0 END)')} AS pop_b FROM cpi",
    "fpt_distribution": f"WITH RECURSIVE {TRAJ}{pairs('traj', 1)}{LEDGES}, m AS (SELECT from_state AS f, to_state AS t, p FROM le)" + passage_shares("m", 3, 2, 50),
    "fpt_distribution_ab": directed("A", 3, 2),
    "fpt_distribution_ba": directed("B", 2, 3),
    "mfpt_matrix": f"{PASSAGE} SELECT i, j, {r6('v')} AS t FROM g WHERE k = 600",
    "path_model_mfpt": f"WITH RECURSIVE {TRAJ}{PATHS.replace(BOXES, AB)}, prs AS (SELECT from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state) OVER (PARTITION BY traj, path_id ORDER BY idx) AS from_state FROM path) WHERE from_state IS NOT NULL GROUP BY ALL){LEDGES}, g AS (SELECT 0 AS k, from_state AS s, 0.0::DOUBLE AS v FROM (SELECT DISTINCT from_state FROM le) UNION ALL SELECT g.k + 1, le.from_state, 1 + sum(CASE WHEN to_state = 2 THEN 0 ELSE p * v END) FROM (SELECT k, s, v FROM g UNION ALL SELECT DISTINCT k, 2::BIGINT, 0.0::DOUBLE FROM g) g JOIN le ON g.s = to_state WHERE g.k < 600 GROUP BY g.k, le.from_state) SELECT {r6('v')} AS mfpt FROM g WHERE k = 600 AND s = 3",
    "lagged_pairs_lag2": lagged(2),
    "fine_stationary": f"{FINE}, v AS (SELECT 0 AS k, s, 1.0::DOUBLE / count(*) OVER () AS v FROM fs UNION ALL SELECT k + 1, b, sum(v * p) FROM v JOIN ft ON a = s WHERE k < 200 GROUP BY k, b) SELECT fs.s AS state, {r6('coalesce(v, 0)')} AS value FROM fs LEFT JOIN v ON v.s = fs.s AND k = 200",
    "fine_committor": f"{FINE}, v AS (SELECT 0 AS k, s, (s = 11)::INT::DOUBLE AS v FROM fs UNION ALL SELECT k + 1, a, CASE a WHEN 11 THEN 1 WHEN 12 THEN 0 ELSE sum(v * p) END FROM v JOIN ft ON b = s WHERE k < 600 GROUP BY k, a) SELECT s AS state, {r6('v')} AS value FROM v WHERE k = 600",
    "fine_passage": f"{FINE}, v AS (SELECT 0 AS k, s, 0.0::DOUBLE AS v FROM fs UNION ALL SELECT k + 1, a, CASE a WHEN 11 THEN 0 ELSE 1 + sum(v * p) END FROM v JOIN ft ON b = s WHERE k < 3000 GROUP BY k, a) SELECT s AS state, {r6('v')} AS value FROM v WHERE k = 3000",
    "part_components": f"{PARTS} SELECT x.i AS state, min(x.j) AS component, count(*) AS size FROM pr x JOIN pr y ON y.i = x.j AND y.j = x.i GROUP BY x.i",
    "part_reach": f"{PARTS} SELECT i AS source, count(*) AS n, max(j) AS last FROM pr WHERE i % 20 = 0 GROUP BY i",
    "lagged_pairs_lag20": lagged_far(20),
    "ancestors_64": f"{chained(63)} SELECT s.file_idx, s.n_iter, s.seg_id, CASE WHEN a.up >= 0 THEN a.up ELSE -1 END AS ancestor, coalesce(r.step, -1)::BIGINT AS root_steps, coalesce(r.at, -1) AS root FROM s LEFT JOIN c a ON a.file_idx = s.file_idx AND a.n_iter = s.n_iter AND a.seg_id = s.seg_id AND a.step = 63 LEFT JOIN c r ON r.file_idx = s.file_idx AND r.n_iter = s.n_iter AND r.seg_id = s.seg_id AND r.up < 0",
    "path_sums": f"{chained(40)} SELECT c.file_idx, c.n_iter, c.seg_id, count(*) AS n, {r6('sum(p1)')} AS p1_sum, {r6('sum(weight)')} AS w_sum FROM c JOIN s ON s.file_idx = c.file_idx AND s.n_iter = c.n_iter - step AND s.seg_id = c.at GROUP BY ALL",
    "structures_by_state": f"WITH {SEG} SELECT to_state AS state, n_iter, file_idx, seg_id, {r6('weight')} AS weight FROM st WHERE n_iter >= 1 AND n_iter < {LAST} - 1",
    "fill_bins": f"WITH {SEG}, b AS (SELECT n_iter, p1, CASE WHEN p1 < 0 THEN -1 WHEN p1 >= 200 THEN 4 ELSE floor(p1 / 50) END::BIGINT AS bin FROM seg), i AS (SELECT DISTINCT n_iter AS s FROM b), c AS (SELECT s, bin, count(*) AS n FROM b JOIN i ON n_iter >= s GROUP BY ALL), ok AS (SELECT s FROM c GROUP BY s HAVING min(n) >= 40), f AS (SELECT coalesce((SELECT max(s) FROM ok), (SELECT min(s) FROM i)) AS first) SELECT bin, count(*) AS n, min(n_iter) AS first, {r6('sum(p1)')} AS p1_sum FROM b, f WHERE n_iter >= f.first GROUP BY bin",
    "voronoi_bins": "WITH c AS (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 20.0, 10.0), (2, 60.0, 5.0), (3, 200.0, 20.0)) v(i, x, y)), d AS (SELECT event_id, i, (value - x) ^ 2 + (user_id - y) ^ 2 AS d FROM events, c WHERE value IS NOT NULL AND user_id IS NOT NULL), n AS (SELECT i FROM d QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, i) = 1) SELECT i::BIGINT AS bin, count(*) AS n FROM n GROUP BY i",
    "nearest_bin_overridden": f"WITH {VEC}, n AS (SELECT label::BIGINT AS bin, count(*) >= ((SELECT count(*) FROM embeddings) + 9) // 10 AS filled FROM embeddings GROUP BY label), d AS (SELECT a.bin, b.bin AS bin_to, max(abs(a.c - b.c)) AS d FROM cen a JOIN cen b USING (k) WHERE a.bin IN (SELECT bin FROM n WHERE NOT filled) AND b.bin IN (SELECT bin FROM n WHERE filled) GROUP BY ALL) SELECT bin, bin AS bin_to FROM n WHERE filled UNION ALL (SELECT bin, bin_to FROM d QUALIFY row_number() OVER (PARTITION BY bin ORDER BY d, bin_to) = 1)",
    "optimized_mapper": f"WITH {SEG}, b AS (SELECT p1, least(CASE WHEN p1 < 0 THEN -1 WHEN p1 >= 400 THEN 4 ELSE floor(p1 / 100) END, 2)::BIGINT AS bin FROM seg), m AS (SELECT p1, CASE WHEN bin < 0 THEN NULL WHEN p1 <= 100 * bin + 50 THEN 2 * bin ELSE 2 * bin + 1 END AS state, CASE WHEN p1 <= 50 THEN 0 WHEN p1 <= 100 THEN 1 WHEN p1 <= 150 THEN 2 WHEN p1 <= 200 THEN 3 ELSE 4 END AS close FROM b), o AS (SELECT p1, CASE WHEN p1 > 150 AND p1 < 1000 THEN 4 WHEN p1 > 0 AND p1 < 5 THEN 3 WHEN state IN (0, 1) THEN 0 WHEN state IN (2, 3) THEN 1 WHEN state = 4 THEN 2 ELSE CASE close WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END END::BIGINT AS bin FROM m) SELECT bin, count(*) AS n, {r6('sum(p1)')} AS p1_sum FROM o GROUP BY bin",
    "allocation": f"WITH {GIVEN}, c AS (SELECT state, pi, v, sum(pi * v) OVER (ORDER BY h, state ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM g), b AS (SELECT *, greatest(ceil(total / (SELECT max(total) FROM c) * 5) - 1, 0)::BIGINT AS bin FROM c), a AS (SELECT bin, sum(pi) * sqrt(sum(pi * v * v) / sum(pi)) AS alloc FROM b GROUP BY bin) SELECT bin, (round(alloc / sum(alloc) OVER () * 100) + 2)::BIGINT AS walkers FROM a",
    "steady_state": f"WITH RECURSIVE {TM}{PI.replace('k < 200', 'k < 2000').replace('k = 200', 'k = 2000')} SELECT state, {r6('value')} AS value FROM pi",
    "scc_clean": f"WITH RECURSIVE {EDGES}, e AS (SELECT from_state AS a, to_state AS b FROM edges WHERE w > 0 UNION SELECT 6, 5), r AS (SELECT state AS i, state AS j FROM states UNION SELECT i, b FROM r JOIN e ON a = j), c AS (SELECT x.i AS state, count(*) AS n, min(x.j) AS low FROM r x JOIN r y ON y.i = x.j AND y.j = x.i GROUP BY x.i) SELECT state, n = (SELECT max(n) FROM c) AND low = (SELECT min(low) FROM c WHERE n = (SELECT max(n) FROM c)) AS stays FROM c",
    "model_mfpts": f"WITH RECURSIVE {TRAJ}{pairs('traj', 1)}{LEDGES}, cn AS (SELECT 2 * from_state + c AS f, 2 * to_state + CASE to_state WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE c END AS t, p FROM le, (VALUES (0), (1)) x(c) WHERE NOT (c = 0 AND from_state = 2) AND NOT (c = 1 AND from_state = 3)){STEADY} SELECT 'AB' AS direction, {r6('(SELECT sum(v) FROM cpi WHERE s % 2 = 0) / (SELECT sum(v * p) FROM cpi JOIN cn ON f = s WHERE s % 2 = 0 AND t = 5)')} AS mfpt UNION ALL SELECT 'BA', {r6('(SELECT sum(v) FROM cpi WHERE s % 2 = 1) / (SELECT sum(v * p) FROM cpi JOIN cn ON f = s WHERE s % 2 = 1 AND t = 6)')}",
    "start_coordinates": f"WITH {SEG} SELECT n_iter, count(*) AS n, {r6('sum(p0)')} AS x_sum FROM seg WHERE p0 <= 100 GROUP BY n_iter",
    "coordinate_set": f"WITH {SEG} SELECT n_iter, count(*) AS n, count(CASE WHEN p1 <= 100 THEN 1 END) AS good, {r6('sum(CASE WHEN p1 <= 100 THEN p1 END)')} AS x_sum FROM seg GROUP BY n_iter",
    "discretized": f"WITH {TRAJ}, dtraj AS (SELECT traj, idx, CASE WHEN x < 0 THEN -1 WHEN x >= 100 THEN 5 ELSE floor(x / 20) END::BIGINT AS state FROM traj){pairs('dtraj', 1)} SELECT * FROM prs WHERE from_state IS NOT NULL AND to_state IS NOT NULL",
    "sliced": f"WITH {TRAJ} SELECT idx - 3 AS idx, count(*) AS n, {r6('sum(x)')} AS x_sum FROM traj WHERE idx BETWEEN 3 AND 8 GROUP BY idx",
    "color_correlation": f"WITH RECURSIVE {TRAJ}{pairs('traj', 1)}{LEDGES}, cn AS (SELECT 2 * from_state + c AS f, 2 * to_state + CASE to_state WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE c END AS t, p FROM le, (VALUES (0), (1)) x(c) WHERE NOT (c = 0 AND from_state = 2) AND NOT (c = 1 AND from_state = 3)){STEADY}, e AS (SELECT 0 AS k, s AS b, s, v FROM cpi WHERE s IN (5, 6) UNION ALL SELECT k + 1, b, t, sum(v * p) FROM e JOIN cn ON f = s WHERE k < 10 GROUP BY k, b, t) SELECT k::BIGINT AS t, {r6('sum(CASE WHEN s = 6 AND b = 6 THEN v ELSE 0 END)')} AS aa, {r6('sum(CASE WHEN s = 6 AND b = 5 THEN v ELSE 0 END)')} AS ab, {r6('sum(CASE WHEN s = 5 AND b = 6 THEN v ELSE 0 END)')} AS ba, {r6('sum(CASE WHEN s = 5 AND b = 5 THEN v ELSE 0 END)')} AS bb FROM e WHERE k IN (1, 2, 5, 10) GROUP BY k",
}
