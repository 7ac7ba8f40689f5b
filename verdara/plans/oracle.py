"""DuckDB SQL giving the same rows as the bound queries, written independently.

The SQL takes the plain route (inequality joins, window functions, self-joins,
closed-form regressions), so that a shared mistake is unlikely.
"""

from __future__ import annotations

from verdara.operators.describe import POISSON_STEPS
from verdara.plans.inputs import (
    DECOMPOSITION_BANDS, INDEX_BANDS, INTENSITY_BANDS, NODATA)
from verdara.plans.queries import ALPHA_LASSO, ALPHA_RIDGE, H_GRID, H_PREDICT, PARCELS


def _r(x: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"


def _even(x: str) -> str:
    """Two decimals, halves to even, on the scaled binary value."""
    return f"(round_even(({x}) * 100.0, 0) / 100.0)"


FIELD = """field AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events
  WHERE event_type = 'purchase')"""
RADAR = """radar AS (
  SELECT user_id, event_type AS var_base, CAST(ts AS DATE) AS date, avg(value) AS val
  FROM events WHERE event_type <> 'purchase' GROUP BY ALL)"""
TIDY = f"""{RADAR}, tidy AS (
  SELECT user_id, date,
    max(val) FILTER (var_base = 'click') AS click, max(val) FILTER (var_base = 'error') AS error,
    max(val) FILTER (var_base = 'signup') AS signup, max(val) FILTER (var_base = 'view') AS view
  FROM radar GROUP BY ALL)"""
VIEWS = """views AS (
  SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS view FROM events
  WHERE event_type = 'view' GROUP BY ALL)"""


def _nearest(rows: str, cols: str) -> str:
    return f"""near AS (
  SELECT f.event_id, r.date AS sar_date, {cols},
    row_number() OVER (PARTITION BY f.event_id ORDER BY abs(r.date - f.day), r.date) AS rk
  FROM field f JOIN {rows} r ON r.user_id = f.user_id AND abs(r.date - f.day) <= 2),
found AS (
  SELECT f.*, n.* EXCLUDE (event_id, rk) FROM field f
  LEFT JOIN (SELECT * FROM near WHERE rk = 1) n ON n.event_id = f.event_id)"""


ORDERS = """o AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
    avg(l_discount) AS avg_discount, sum(l_extendedprice) AS sum_price,
    sum(l_extendedprice * (1 + l_tax)) AS sum_charge
  FROM lineitem GROUP BY l_orderkey)"""
PIX = """pix AS (
  SELECT 'R' || label AS raster, CAST(vec_id // 25 AS INT) AS row, CAST(vec_id % 25 AS INT) AS col,
    CAST(band AS INT) AS band, embedding[band] AS value
  FROM embeddings, range(1, 65) t(band))"""
MASKED = f"""{PIX}, masked AS (
  SELECT raster, row, col, band, CASE WHEN raster = 'R3' THEN CAST({NODATA} AS FLOAT)
    WHEN band = 7 AND value > 0.2 THEN CAST('nan' AS FLOAT) ELSE value END AS value
  FROM pix), valid AS (
  SELECT raster, row, col FROM masked GROUP BY ALL
  HAVING NOT bool_and(value = {NODATA}) AND bool_and(isfinite(value)))"""


def _names(bands: dict[int, str]) -> str:
    rows = ", ".join(f"({b}, '{n}')" for b, n in bands.items())
    return f"names(band, name) AS (VALUES {rows})"


def _bands(prefix: str, bands: dict[int, str]) -> str:
    return ", ".join(str(b) for b, n in bands.items() if n.startswith(prefix))


def _mean(prefix: str, bands: dict[int, str], value: str = "value") -> str:
    return f"avg(CAST({value} AS DOUBLE)) FILTER (band IN ({_bands(prefix, bands)}))"


def _cross(prod: str, metric: str) -> str:
    return f"avg({metric}) FILTER (prod = '{prod}')"


MAP_FEATURES = f"""{MASKED}, feat AS (
  SELECT m.raster, m.row, m.col, {_mean('Sigma0_VH', INTENSITY_BANDS)} AS a,
    {_mean('Sigma0_VV', INTENSITY_BANDS)} AS b, CAST(m.raster[2:] AS DOUBLE) AS y
  FROM masked m JOIN valid v USING (raster, row, col) GROUP BY ALL)"""


def _two_feature_fit(rows: str, a: str, b: str, y: str, penalty: str = "0.0") -> str:
    """Least squares on two standardised features with an L2 penalty, in closed form."""
    return f"""m AS (
  SELECT count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my,
    stddev_pop({a}) AS sa, stddev_pop({b}) AS sb, stddev_pop({y}) AS sy FROM {rows}),
g AS (
  SELECT any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my,
    any_value(sa) AS sa, any_value(sb) AS sb,
    avg((({a}) - ma) / sa * (({b}) - mb) / sb) AS r,
    avg((({a}) - ma) / sa * (({y}) - my)) AS ca, avg((({b}) - mb) / sb * (({y}) - my)) AS cb
  FROM {rows}, m),
fit AS (
  SELECT *, ((1 + {penalty} / n) * ca - r * cb) / ((1 + {penalty} / n) ** 2 - r * r) AS wa,
    ((1 + {penalty} / n) * cb - r * ca) / ((1 + {penalty} / n) ** 2 - r * r) AS wb FROM g)"""


LINE_FIT = _two_feature_fit("lineitem", "l_quantity", "l_discount", "l_extendedprice")


def _coef_rows(penalty: str) -> str:
    fit = _two_feature_fit("lineitem", "l_quantity", "l_discount", "l_extendedprice", penalty)
    return f"""WITH {fit}
SELECT 'l_quantity' AS feature, {_r('wa', 4)} AS coef FROM fit
UNION ALL SELECT 'l_discount', {_r('wb', 4)} FROM fit"""


SCORED = """scored AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS model,
    CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'val' END AS set,
    l_extendedprice AS price, l_quantity * 1000 AS price_hat,
    l_extendedprice * (1 - l_discount) AS net, l_quantity * 950 AS net_hat FROM lineitem)"""


def _scores(t: str, p: str) -> str:
    return f"""sqrt(avg(({t} - {p}) ** 2)) AS RMSE, avg(abs({t} - {p})) AS MAE,
    1 - sum(({t} - {p}) ** 2) / (var_pop({t}) * count(*)) AS R2,
    100 * sqrt(avg(({t} - {p}) ** 2)) / avg(abs({t})) AS rRMSE"""


def _long_scores(source: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS metric, {col} AS value FROM {source}"
        for name, col in (("RMSE", "RMSE"), ("MAE", "MAE"), ("R2", "R2"), ("rRMSE(%)", "rRMSE")))


METRIC_ROWS = f"""{SCORED}, wide AS (
  SELECT model, 'price' AS target, set, {_scores('price', 'price_hat')} FROM scored GROUP BY ALL
  UNION ALL
  SELECT model, 'net' AS target, set, {_scores('net', 'net_hat')} FROM scored GROUP BY ALL),
long AS ({_long_scores('wide', 'model, target, set')})"""


def _cell(metric: str, which: str) -> str:
    return _even(f"avg(value) FILTER (metric = '{metric}' AND set = '{which}')")


TABLE = f"""{METRIC_ROWS}, tab AS (
  SELECT model AS "Model", target AS "Target", {_cell('MAE', 'train')} AS "MAE (train)",
    {_cell('MAE', 'val')} AS "MAE (val)", {_cell('R2', 'train')} AS "R2 (train)",
    {_cell('R2', 'val')} AS "R2 (val)", {_cell('rRMSE(%)', 'train')} AS "rRMSE% (train)",
    {_cell('rRMSE(%)', 'val')} AS "rRMSE% (val)"
  FROM long GROUP BY ALL)"""
TABLE_CELLS = ("MAE (train)", "MAE (val)", "R2 (train)", "R2 (val)", "rRMSE% (train)",
               "rRMSE% (val)")

# eigenvalues of a 3 × 3 correlation matrix in closed form, eigenvectors as the cross
# product of two rows of (C − λI), the largest loading made positive
PCA = f"""{ORDERS}, c AS (
  SELECT corr(n_lines, sum_qty) AS a, corr(n_lines, avg_discount) AS b,
    corr(sum_qty, avg_discount) AS d, avg(n_lines) AS m1, avg(sum_qty) AS m2,
    avg(avg_discount) AS m3, stddev_pop(n_lines) AS s1, stddev_pop(sum_qty) AS s2,
    stddev_pop(avg_discount) AS s3 FROM o),
p AS (SELECT *, sqrt((a * a + b * b + d * d) / 3) AS p FROM c),
q AS (SELECT *, acos(a * b * d / (p * p * p)) / 3 AS phi FROM p),
lam AS (
  SELECT *, k, 1 + 2 * p * cos(phi + CASE k WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 2 END * pi() / 3)
    AS l FROM q, range(1, 4) t(k)),
vec AS (SELECT *, a * d - b * (1 - l) AS x, a * b - d * (1 - l) AS y, (1 - l) ** 2 - a * a AS z
  FROM lam),
unit AS (
  SELECT *, sqrt(x * x + y * y + z * z) * CASE
    WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN sign(x)
    WHEN abs(y) >= abs(z) THEN sign(y) ELSE sign(z) END AS norm FROM vec),
pc AS (
  SELECT k, l, x / norm AS v1, y / norm AS v2, z / norm AS v3, m1, m2, m3, s1, s2, s3 FROM unit),
score AS (
  SELECT l_orderkey, k, (n_lines - m1) / s1 * v1 + (sum_qty - m2) / s2 * v2
    + (avg_discount - m3) / s3 * v3 AS s, sum_price, n_lines, sum_qty, avg_discount FROM o, pc)"""

KRN = """krn AS (
  SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x,
    CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"""


def _grid(hs) -> str:
    return "hs(h) AS (VALUES " + ", ".join(f"(CAST({h!r} AS DOUBLE))" for h in hs) + ")"


def _weight(h: str = "h") -> str:
    return f"exp(-0.5 * (q.x - t.x) ** 2 / ({h} * {h}))"


LOO = f"""{KRN}, {_grid(H_GRID)}, loo AS (
  SELECT h, q.s_suppkey, any_value(q.y) AS y,
    sum(CASE WHEN q.s_suppkey <> t.s_suppkey THEN {_weight()} * t.y ELSE 0 END)
    / (sum(CASE WHEN q.s_suppkey <> t.s_suppkey THEN {_weight()} ELSE 0 END) + 1e-12) AS yhat
  FROM hs, krn q, krn t GROUP BY h, q.s_suppkey),
risk AS (SELECT h, sqrt(avg((y - yhat) ** 2)) AS rmse_loo FROM loo GROUP BY h)"""


PAIRS = f"""pairs AS (
  SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
    (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS z,
    CASE WHEN c_custkey % 20 <> 0 THEN CAST(length(c_name) + c_custkey % 7 AS DOUBLE) END AS y
  FROM customer), {_grid(H_GRID)}"""
_PAIR_WEIGHT = "exp(-0.5 * ((q.x - t.x) ** 2 + (q.z - t.z) ** 2) / (h * h))"


def _split(table: str, key: str) -> str:
    """Validation rows: the first ⌈0.3 n⌉ by hash."""
    return f"""(SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || {key}))
    <= ceil(0.3 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split FROM {table})"""


def _rank(x: str) -> str:
    return (f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 "
            f"AS r_{x}")


REGRESSORS = ("n_lines", "sum_qty", "avg_discount")


def _pairs(targets, features, fn, source) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{f}' AS feature, {_r(fn(t, f))} AS r FROM {source}"
        for t in targets for f in features)


def _describe(source: str, key: str, cols) -> str:
    return " UNION ALL ".join(
        f"""SELECT {key}, '{c}' AS var, count({c}) AS count, {_r(f'avg({c})', 4)} AS mean,
    {_r(f'stddev_samp({c})', 4)} AS std, {_r(f'min({c})', 4)} AS min,
    {_r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {_r(f'quantile_cont({c}, 0.5)', 4)} AS q50,
    {_r(f'quantile_cont({c}, 0.75)', 4)} AS q75, {_r(f'max({c})', 4)} AS max
  FROM {source} GROUP BY {key}""" for c in cols)


def _boxcox(x: str, lam: str) -> str:
    return f"CASE WHEN {lam} = 0 THEN ln({x}) ELSE (pow({x}, {lam}) - 1) / {lam} END"


BOXCOX_COLS = ("l_extendedprice", "l_quantity", "l_discount")
BOXCOX = "shifted AS (SELECT " + ", ".join(
    f"{c} + CASE WHEN min({c}) OVER () <= 0 THEN abs(min({c}) OVER ()) + 1e-6 ELSE 0 END AS {c}"
    for c in BOXCOX_COLS) + """, l_orderkey, l_linenumber FROM lineitem),
shift AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1e-6 ELSE 0 END AS shift "
    f"FROM lineitem" for c in BOXCOX_COLS) + """),
"""


def _climb(step: int) -> str:
    """Best exponent on the coarse grid (step 0), then on finer ones around the last best."""
    name, last = f"b{step}", f"b{step - 1}"
    return f"g{step} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS col, lam, count({c}) AS n, (lam - 1) * sum(ln({c})) - count({c}) / 2.0 "
        f"* ln(var_pop({_boxcox(c, 'lam')})) AS v FROM shifted, "
        + (f"(SELECT lam + {0.1 ** (step + 1)!r} * i AS lam FROM {last}, range(-10, 11) t(i) "
           f"WHERE col = '{c}')" if step else
           "(SELECT CAST(round(-2.0 + 0.1 * i, 1) AS DOUBLE) AS lam FROM range(0, 41) t(i))")
        + " GROUP BY lam" for c in BOXCOX_COLS) + f"""),
{name} AS (SELECT col, arg_max(lam, v) AS lam, any_value(n) AS n FROM g{step} GROUP BY col)"""


BOXCOX += ",\n".join(_climb(i) for i in range(4)) + ", best AS (SELECT * FROM b3)"


def _box(col: str) -> str:
    return f"""SELECT l_returnflag, '{col}' AS var, {_r('any_value(a)', 4)} AS q25,
    {_r('any_value(b)', 4)} AS q50, {_r('any_value(c)', 4)} AS q75,
    {_r(f'min({col}) FILTER ({col} BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a))', 4)}
      AS whisker_low,
    {_r(f'max({col}) FILTER ({col} BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a))', 4)}
      AS whisker_high,
    count(*) FILTER ({col} NOT BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)) AS n_outliers
  FROM lineitem JOIN (
    SELECT l_returnflag, quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.5) AS b,
      quantile_cont({col}, 0.75) AS c FROM lineitem GROUP BY l_returnflag) q USING (l_returnflag)
  GROUP BY l_returnflag"""


GAPPY = """gappy AS (
  SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0.0) AS l_discount
  FROM lineitem),
filled AS (
  SELECT l_orderkey, l_linenumber, l_quantity,
    coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM gappy)) AS l_discount
  FROM gappy)"""

RIDGE_SPLIT = f"""{ORDERS}, sp AS (SELECT * FROM {_split('o', 'l_orderkey')}),
train AS (SELECT * FROM sp WHERE split = 'train')"""


def _ridge_scores(target: str, tag: str) -> str:
    fit = _two_feature_fit("train", "n_lines", "sum_qty", target, repr(ALPHA_RIDGE))
    for name in ("m AS", "g AS", "fit AS"):
        fit = fit.replace(name, name[:-3] + tag + " AS")
    fit = (fit.replace("FROM train, m)", f"FROM train, m{tag})")
           .replace("FROM g)", f"FROM g{tag})"))
    return f"""{fit},
pred{tag} AS (
  SELECT split AS set, {target} AS t,
    my + wa * (n_lines - ma) / sa + wb * (sum_qty - mb) / sb AS p FROM sp, fit{tag}),
wide{tag} AS (
  SELECT '{target}' AS target, set, {_scores('t', 'p')} FROM pred{tag} GROUP BY set)"""


NW_SPLIT = f"""sp AS (
  SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS y, split
  FROM {_split('supplier', 's_suppkey')}),
sc AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM sp WHERE split = 'train'),
z AS (SELECT s_suppkey, split, y, (s_acctbal - m) / s AS x FROM sp, sc),
tr AS (SELECT * FROM z WHERE split = 'train'),
{_grid(H_GRID)},
loo AS (
  SELECT h, q.s_suppkey, any_value(q.y) AS y,
    sum(CASE WHEN q.s_suppkey <> t.s_suppkey THEN {_weight()} * t.y ELSE 0 END)
    / (sum(CASE WHEN q.s_suppkey <> t.s_suppkey THEN {_weight()} ELSE 0 END) + 1e-12) AS yhat
  FROM hs, tr q, tr t GROUP BY h, q.s_suppkey),
risk AS (SELECT h, sqrt(avg((y - yhat) ** 2)) AS rmse FROM loo GROUP BY h),
best AS (SELECT h FROM risk ORDER BY rmse, h LIMIT 1),
pred AS (
  SELECT q.s_suppkey, any_value(q.split) AS set, any_value(q.y) AS t,
    sum({_weight()} * t.y) / sum({_weight()}) AS p FROM best, z q, tr t GROUP BY q.s_suppkey),
wide AS (SELECT set, {_scores('t', 'p')} FROM pred GROUP BY set)"""

INDEX_PART = "regexp_extract(name, '(?i)dpRVI.*?([0-9]{2}[A-Za-z]{3}[0-9]{4})', 1)"
DAY_SQL = "CAST(ts AS DATE)"
_STYLES = {
    "dMonY": "strftime(ts, '%-d%b%Y')", "dMonY_sep": "strftime(ts, '%d_%b_%Y')",
    "iso": "strftime(ts, '%Y-%m-%d')", "ymd": "strftime(ts, '%Y%m%d')",
    "dmy": "strftime(ts, '%d%m%Y')", "spanish": "strftime(ts, '%dEne%Y')",
    "letters_first": "strftime(ts, '%b%d%Y')", "no_date": "event_type",
}
_FLEX = {"dmy": f"CASE WHEN day(ts) NOT IN (19, 20) THEN {DAY_SQL} END",
         "letters_first": "CAST(NULL AS DATE)", "no_date": "CAST(NULL AS DATE)"}
_PLAIN = {s: "CAST(NULL AS DATE)" for s in ("spanish", "letters_first", "no_date")}
# DDMMYYYY read as YYYYMMDD is a date only when its parts happen to fit
_PLAIN["dmy"] = "CAST(try_strptime(strftime(ts, '%d%m%Y'), '%Y%m%d') AS DATE)"

_SQL: dict[str, str] = {
    "load_table": 'SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer',
    "load_missing": """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
  c_custkey % 7 = 0 OR c_acctbal IS NULL AS missing FROM customer""",
    "write_roundtrip": f"WITH {PIX} SELECT raster, row, col, band, {_r('value')} AS value FROM pix",
    "preview": "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5",
    "select_xy": "SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem",
    "rename_project": """SELECT o_orderkey, o_totalprice AS total_biomass,
  CAST(o_orderdate AS DATE) AS sample_day FROM orders""",
    "fill_zero": f"""SELECT c_custkey, coalesce(n_orders, 0) AS n_orders,
  {_r('coalesce(total, 0)', 2)} AS total FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders
    GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "model_ready": """SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_extendedprice,
  l_quantity, l_discount FROM lineitem""",
    "prefix_filter": """SELECT p_partkey, p_type FROM part
  WHERE upper(trim(p_type)) LIKE 'S%' OR upper(trim(p_type)) LIKE 'P%'""",
    "cover_type": """SELECT p_partkey, CASE left(p_type, 1) WHEN 'P' THEN 'Grass'
  WHEN 'S' THEN 'Young crop' WHEN 'E' THEN 'Old crop' ELSE 'Unknown' END AS cover FROM part""",
    "relabel_targets": """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Household'
  WHEN 'MACHINERY' THEN 'Machines' WHEN 'BUILDING' THEN 'Buildings' ELSE c_mktsegment END
  AS c_mktsegment FROM customer""",
    "detect_roles": """SELECT 'point' AS role, 'id_point' AS "column", count(user_id) AS n_values
  FROM events UNION ALL SELECT 'datetime', 'fecha_hora', count(ts) FROM events""",
    "parse_date_tag": " UNION ALL ".join(
        f"""SELECT event_id, '{s}' AS style, {tag} AS tag, {_FLEX.get(s, DAY_SQL)} AS date,
  {_PLAIN.get(s, DAY_SQL)} AS plain_date FROM events""" for s, tag in _STYLES.items()),
    "parse_band_name": f"""WITH n AS (
  SELECT event_id, ts, event_type, CASE event_type
    WHEN 'view' THEN strftime(ts, 'Sigma0_IW1_VH_mst_%d%b%Y')
    WHEN 'click' THEN strftime(ts, 'gamma0_IW2_vv_slv4_%d%b%Y')
    WHEN 'purchase' THEN strftime(ts, 'entropy_slv8_%d%b%Y')
    WHEN 'signup' THEN strftime(ts, 'dpRVI_%d%b%Y') ELSE 'DPRVI' END AS name FROM events)
SELECT event_id, name,
  CASE event_type WHEN 'view' THEN 'Sigma0' WHEN 'click' THEN 'gamma0' END AS prod,
  CASE event_type WHEN 'view' THEN 'VH' WHEN 'click' THEN 'VV' END AS pol,
  CASE event_type WHEN 'purchase' THEN 'Entropy' END AS param,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN {DAY_SQL} END AS date,
  CASE WHEN event_type = 'signup' THEN {INDEX_PART}
    WHEN event_type = 'error' THEN 'NA' END AS index_date FROM n""",
    "date_plus_time": "SELECT event_id, date_trunc('second', ts) AS datetime FROM events",
    "tidy_long": f"""WITH {RADAR} SELECT user_id, var_base, date, {_r('val')} AS val FROM radar
  WHERE val IS NOT NULL""",
    "tidy_wide": f"""WITH {TIDY} SELECT user_id, date, {_r('click')} AS click,
  {_r('error')} AS error, {_r('signup')} AS signup, {_r('view')} AS view FROM tidy""",
    "tidy_first_row": f"""WITH slots AS (
  SELECT user_id, event_id % 3 AS slot, CAST(ts AS DATE) AS date, event_type, avg(value) AS val
  FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
cells AS (
  SELECT user_id, date, event_type AS v, 0 AS k, slot, val FROM slots
  UNION ALL SELECT user_id, date, 'error', 1, slot, val FROM slots WHERE event_type = 'click'),
firsts AS (SELECT user_id, date, v, arg_min(val, k * 3 + slot) AS val FROM cells GROUP BY ALL)
SELECT user_id, date, {', '.join(f"round(max(val) FILTER (v = '{v}'), 6) AS {v}" for v in ('click', 'error', 'signup', 'view'))}
FROM firsts GROUP BY user_id, date""",
    "pivot_first_row": f"""SELECT user_id, CAST(ts AS DATE) AS date, {', '.join(
        f"round(arg_min(value, event_id) FILTER (event_type = '{v}'), 6) AS {v}"
        for v in ('click', 'error', 'signup', 'view'))}
FROM events WHERE event_id % 5 <> 0 AND event_type <> 'purchase' AND value IS NOT NULL GROUP BY ALL""",
    "align_two_notations": f"""WITH {FIELD}, {TIDY}, {_nearest('tidy', 'r.view, r.click')}
SELECT event_id, user_id, day, {_r('value')} AS value, sar_date, CAST(sar_date - day AS INT) AS day_diff,
  {_r('view')} AS view, {_r('click')} AS click FROM found""",
    "align_exact": f"""WITH {FIELD}, {VIEWS} SELECT event_id, f.user_id, day, {_r('value')} AS value,
  {_r('view')} AS view FROM field f LEFT JOIN views v ON v.user_id = f.user_id AND v.date = f.day""",
    "align_nearest": f"""WITH {FIELD}, {VIEWS}, {_nearest('views', 'r.view')}
SELECT event_id, user_id, day, {_r('value')} AS value, {_r('view')} AS view, sar_date,
  CAST(sar_date - day AS INT) AS day_diff FROM found""",
    "align_probe_col": f"""WITH {FIELD}, {TIDY},
{_nearest('tidy', 'r.click, r.error, r.signup, r.view')}
SELECT event_id, user_id, day, sar_date, {_r('click')} AS click, {_r('error')} AS error,
  {_r('signup')} AS signup, {_r('view')} AS view,
  CASE WHEN sar_date = day AND click IS NOT NULL THEN 'exact'
    WHEN sar_date IS NOT NULL THEN 'nearest' ELSE 'none' END AS how FROM found""",
    "align_keep_only": f"""WITH {FIELD}, {TIDY}, {_nearest('tidy', 'r.signup, r.view')}
SELECT user_id, event_id, {_r('value')} AS value, day, sar_date,
  CAST(sar_date - day AS INT) AS day_diff, {_r('signup')} AS signup, {_r('view')} AS view
FROM found""",
    "align_stats": f"""WITH {FIELD}, {VIEWS}, {_nearest('views', 'r.view')}
SELECT count(*) AS n, count(*) FILTER (sar_date IS NULL OR sar_date <> day) AS unmatched_exact,
  count(*) FILTER (sar_date <> day) AS filled_nearest,
  count(*) FILTER (sar_date IS NULL) AS unmatched FROM found""",
    "dates_by_point": f"""WITH {RADAR} SELECT user_id, count(DISTINCT date) AS n_dates,
  min(date) AS first, max(date) AS last FROM radar GROUP BY user_id""",
    "common_dates": f"""WITH {RADAR}
SELECT user_id, date FROM radar WHERE var_base = 'view' INTERSECT
SELECT user_id, date FROM radar WHERE var_base = 'click'""",
    "outer_merge": f"""SELECT user_id, n_purchases, {_r('view_sum', 4)} AS view_sum,
  {_r('error_max', 4)} AS error_max
FROM (SELECT user_id, count(*) AS n_purchases FROM events WHERE event_type = 'purchase'
  GROUP BY user_id)
FULL JOIN (SELECT user_id, sum(value) AS view_sum FROM events WHERE event_type = 'view'
  GROUP BY user_id) USING (user_id)
FULL JOIN (SELECT user_id, max(value) AS error_max FROM events WHERE event_type = 'error'
  GROUP BY user_id) USING (user_id)""",
    "crosspol_metrics": f"""SELECT l_orderkey, l_linenumber,
  {_r('max(l_tax) + max(l_discount)')} AS sum_vhvv,
  {_r('max(l_tax) / nullif(max(l_discount), 0)')} AS ratio_vh_vv
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "crosspol_wide_db": f"""SELECT l_orderkey, l_linenumber,
  {_r('CASE WHEN l_tax > 0 AND l_discount > 0 THEN 10 * log10(l_tax / l_discount) END', 4)}
    AS "Gamma0_RATIO_VH_VV_15Mar2025",
  {_r('CASE WHEN l_tax > 0 AND l_discount > 0 THEN 10 * log10(l_tax + l_discount) END', 4)}
    AS "Gamma0_SUM_VHVV_15Mar2025",
  {_r('10 * log10(l_extendedprice / l_quantity)', 4)} AS "Sigma0_RATIO_VH_VV_19Feb2025",
  {_r('10 * log10(l_extendedprice + l_quantity)', 4)} AS "Sigma0_SUM_VHVV_19Feb2025"
FROM lineitem""",
    "db_linear": f"""SELECT l_orderkey, l_linenumber,
  {_r('CASE WHEN l_extendedprice > 0 THEN 10 * log10(l_extendedprice) END', 5)} AS db,
  {_r('CASE WHEN l_extendedprice > 0 THEN l_extendedprice END', 5)} AS back,
  {_r('CASE WHEN l_discount > 0 THEN 10 * log10(l_discount) END', 5)} AS discount_db
FROM lineitem""",
    "db_minmax": f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_returnflag,
  10 * log10(l_extendedprice + 1e-10) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, {_r('''(v - min(v) OVER (PARTITION BY l_returnflag))
  / nullif(max(v) OVER (PARTITION BY l_returnflag) - min(v) OVER (PARTITION BY l_returnflag), 0)''')}
  AS scaled FROM d""",
    "band_names": f"""WITH {PIX}, {_names(INTENSITY_BANDS)}
SELECT raster, row, col, band, coalesce(name, printf('Banda %02d', band)) AS band_name
FROM pix LEFT JOIN names USING (band)""",
    "mapped_bands": f"""WITH {PIX}, {_names(INTENSITY_BANDS)}
SELECT raster, row, col, band, split_part(name, '_', 1) AS prod, split_part(name, '_', 2) AS pol,
  split_part(name, '_', 3) AS date_tag FROM pix JOIN names USING (band)""",
    "pixel_valid_mask": f"WITH {MASKED} SELECT * FROM valid",
    "pixel_temporal_mean": f"""WITH {MASKED} SELECT raster, row, col,
  {_r('avg(CASE WHEN isfinite(value) THEN CAST(value AS DOUBLE) END)')} AS mean FROM masked
  WHERE band IN ({_bands('Sigma0_VV', INTENSITY_BANDS)}) GROUP BY ALL""",
    "crosspol_pixel_mean": f"""WITH {PIX}, {_names(INTENSITY_BANDS)}, pairs AS (
  SELECT raster, row, col, split_part(name, '_', 1) AS prod, split_part(name, '_', 3) AS tag,
    max(CAST(value AS DOUBLE)) FILTER (name LIKE '%\\_VH\\_%' ESCAPE '\\') AS vh,
    max(CAST(value AS DOUBLE)) FILTER (name LIKE '%\\_VV\\_%' ESCAPE '\\') AS vv
  FROM pix JOIN names USING (band) GROUP BY ALL)
SELECT raster, row, col, {_r(_cross('Sigma0', 'vh + vv'), 4)} AS "Sigma0_SUM_VHVV",
  {_r(_cross('Sigma0', 'vh / vv'), 4)} AS "Sigma0_RATIO_VH_VV",
  {_r(_cross('Gamma0', 'vh + vv'), 4)} AS "Gamma0_SUM_VHVV",
  {_r(_cross('Gamma0', 'vh / vv'), 4)} AS "Gamma0_RATIO_VH_VV"
FROM pairs GROUP BY raster, row, col""",
    "ratio_of_means": f"""WITH {PIX} SELECT raster, row, col, {_r(
        _mean('Sigma0_VH', INTENSITY_BANDS) + ' / ' + _mean('Sigma0_VV', INTENSITY_BANDS), 4)}
  AS "Sigma0_RATIO_VH_VV", {_r(
        _mean('Gamma0_VH', INTENSITY_BANDS) + ' / ' + _mean('Gamma0_VV', INTENSITY_BANDS), 4)}
  AS "Gamma0_RATIO_VH_VV" FROM pix GROUP BY ALL""",
    "pixel_features": f"""WITH {MASKED} SELECT m.raster, m.row, m.col, """ + ", ".join(
        [f'{_r(_mean(p, INTENSITY_BANDS))} AS "{p}"'
         for p in ("Sigma0_VV", "Sigma0_VH", "Gamma0_VV", "Gamma0_VH")]
        + [f'{_r(_mean("dpRVI", INDEX_BANDS))} AS "dpRVI"']
        + [f'{_r(_mean(p, DECOMPOSITION_BANDS))} AS "{p}"'
           for p in ("Entropy", "Anisotropy", "Alpha")])
    + " FROM masked m JOIN valid v USING (raster, row, col) GROUP BY ALL",
    "parcel_scan": f"""WITH {PIX} SELECT raster, row, col, band, {_r('value')} AS value FROM pix
  WHERE raster IN ({', '.join(repr(p) for p in PARCELS)})""",
    "raster_catalogue": f"""WITH {PIX} SELECT raster, CAST(max(row) + 1 AS INT) AS n_rows,
  CAST(max(col) + 1 AS INT) AS n_cols, count(DISTINCT band) AS n_bands, 500.0::DOUBLE AS x0,
  ((max(row) + 1) * 10.0)::DOUBLE AS y0, 10.0::DOUBLE AS dx, 10.0::DOUBLE AS dy,
  {NODATA}::DOUBLE AS nodata, 'EPSG:32618' AS crs FROM pix GROUP BY raster""",
    "point_pixel_join": f"""WITH {PIX}, meta AS (
  SELECT raster, (max(row) + 1) * 10.0 AS y0 FROM pix GROUP BY raster),
pts AS (
  SELECT c_custkey, 'R' || (c_nationkey % 12) AS raster, 495.0 + (c_custkey * 37) % 265 AS x,
    ((c_custkey * 11) % 210) * 1.0 AS y FROM customer),
spot AS (
  SELECT c_custkey, raster, CAST(floor((y0 - y) / 10) AS INT) AS row,
    CAST(floor((x - 500) / 10) AS INT) AS col FROM pts LEFT JOIN meta USING (raster))
SELECT c_custkey, """ + ", ".join(
        f'{_r(f"max(value) FILTER (band = {b})")} AS "{n}"'
        for b, n in INTENSITY_BANDS.items())
    + """ FROM spot LEFT JOIN pix USING (raster, row, col) GROUP BY c_custkey""",
    "predict_raster": f"""WITH {MAP_FEATURES}, {_two_feature_fit('feat', 'a', 'b', 'y')}
SELECT raster, row, col, {_r('CAST(my + wa * (a - ma) / sa + wb * (b - mb) / sb AS FLOAT)', 3)}
  AS pred FROM feat, fit""",
    "predict_raster_sink": f"""WITH {MAP_FEATURES}, {_two_feature_fit('feat', 'a', 'b', 'y')},
pred AS (
  SELECT raster, row, col, CAST(my + wa * (a - ma) / sa + wb * (b - mb) / sb AS FLOAT) AS p
  FROM feat, fit),
size AS (SELECT raster, max(row) AS r, max(col) AS c FROM pix GROUP BY raster),
frame AS (
  SELECT raster, CAST(rr AS INT) AS row, CAST(cc AS INT) AS col FROM (
    SELECT raster, c, unnest(range(0, r + 1)) AS rr FROM size) s, range(0, 25) t(cc)
  WHERE cc <= c)
SELECT raster, row, col, {_r(f'coalesce(p, {NODATA})', 3)} AS pred
FROM frame LEFT JOIN pred USING (raster, row, col)""",
    "describe_by_cover": _describe("lineitem", "l_returnflag",
                                   ("l_quantity", "l_extendedprice", "l_discount")),
    "describe_gaps": _describe("""(SELECT nullif(l_returnflag, 'N') AS flag,
  CASE WHEN l_tax = 0.02 OR l_returnflag = 'A' THEN NULL ELSE l_quantity END AS l_quantity
  FROM lineitem)""", "flag", ["l_quantity"]),
    "describe_by_date": _describe("(SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem)",
                                  "day", ("l_quantity", "l_linenumber")),
    "box_stats": _box("l_quantity") + " UNION ALL " + _box("l_extendedprice"),
    "monthly_mean": f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag,
  count(l_quantity) AS n, {_r('avg(l_quantity)', 4)} AS mean,
  {_r('stddev_samp(l_quantity) / sqrt(count(l_quantity))', 4)} AS se
FROM lineitem GROUP BY ALL""",
    "bootstrap_band": f"""WITH j AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, o_totalprice AS x,
    k * 4 + i AS b, ('0x' || substr(md5('42:' || o_orderkey || ':' || k), CAST(8 * i + 1 AS INT), 8))::BIGINT / 4294967296.0 AS u
  FROM orders, range(50) a(k), range(4) c(i) WHERE o_totalprice IS NOT NULL),
means AS (SELECT month, o_orderstatus, b, sum(w * x) / nullif(sum(w), 0) AS m FROM (
  SELECT *, {' + '.join(f'(u >= {t!r}::DOUBLE)::INT' for t in POISSON_STEPS)} AS w FROM j) GROUP BY ALL),
band AS (SELECT month, o_orderstatus, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high
  FROM means GROUP BY ALL)
SELECT month, o_orderstatus, n, round(mean, 2) AS mean, round(low, 2) AS low, round(high, 2) AS high
FROM band JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(o_totalprice) AS n,
  avg(o_totalprice) AS mean FROM orders GROUP BY ALL) USING (month, o_orderstatus)""",
    "pearson_pairs": f"WITH {ORDERS} " + _pairs(
        ("sum_price", "sum_charge"), REGRESSORS, lambda t, f: f"corr({t}, {f})", "o"),
    "spearman_pairs": f"WITH {ORDERS}, rk AS (SELECT " + ", ".join(
        _rank(c) for c in ("sum_price", "sum_charge", *REGRESSORS)) + " FROM o) " + _pairs(
        ("sum_price", "sum_charge"), REGRESSORS, lambda t, f: f"corr(r_{t}, r_{f})", "rk"),
    "corr_matrix": "WITH g AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) "
    "AS l_discount FROM lineitem) " + _pairs(
        ("l_quantity", "l_extendedprice", "l_discount"),
        ("l_quantity", "l_extendedprice", "l_discount"), lambda t, f: f"corr({t}, {f})", "g"),
    "corr_select": f"WITH {ORDERS}, c AS (" + _pairs(
        ("sum_price", "sum_charge"), REGRESSORS, lambda t, f: f"corr({t}, {f})", "o")
    + ") SELECT DISTINCT feature FROM c WHERE abs(r) > 0.4 UNION SELECT 'Alpha'",
    "corr_union": f"""WITH {ORDERS}
SELECT 'sum_price' AS target, {_r('corr(sum_price, n_lines)')} AS n_lines,
  {_r('corr(sum_price, sum_qty)')} AS sum_qty, CAST(NULL AS DOUBLE) AS avg_discount FROM o
UNION ALL SELECT 'sum_charge', NULL, {_r('corr(sum_charge, sum_qty)')},
  {_r('corr(sum_charge, avg_discount)')} FROM o""",
    "boxcox_lambda": f"""WITH {BOXCOX} SELECT col AS "column", {_r('lam', 4)} AS lambda,
  {_r('shift')} AS shift, n FROM best JOIN shift USING (col)""",
    "boxcox_transform": f"WITH {BOXCOX}, l AS (SELECT " + ", ".join(
        f"max(lam) FILTER (col = '{c}') AS lam_{c}" for c in BOXCOX_COLS)
    + " FROM best) SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"{_r(_boxcox(c, f'lam_{c}'), 4)} AS {c}" for c in BOXCOX_COLS) + " FROM shifted, l",
    "pca_scores": f"WITH {PCA} SELECT l_orderkey, " + ", ".join(
        f"{_r(f'max(s) FILTER (k = {k})', 5)} AS \"PC{k}\"" for k in (1, 2, 3))
    + " FROM score GROUP BY l_orderkey",
    "pca_loadings": f"WITH {PCA} " + " UNION ALL ".join(
        f"SELECT 'PC' || k AS pc, '{f}' AS feature, {_r(f'v{i}')} AS loading FROM pc"
        for i, f in enumerate(REGRESSORS, 1)),
    "pca_variance": f"""WITH {PCA} SELECT 'PC' || k AS pc, {_r('l / 3')} AS evr,
  {_r('sum(l / 3) OVER (ORDER BY k) * 100')} AS cum FROM pc""",
    "pca_append": f"WITH {PCA} " + _pairs(
        ("sum_price",), REGRESSORS, lambda t, f: f"corr({t}, {f})", "o") + " UNION ALL "
    + f"SELECT 'sum_price', 'PC' || k, {_r('corr(sum_price, s)')} FROM score WHERE k <= 2 GROUP BY k",
    "random_split": f"SELECT o_orderkey, split FROM {_split('orders', 'o_orderkey')}",
    "median_impute": f"""WITH {GAPPY} SELECT l_orderkey, l_linenumber, {_r('l_quantity')}
  AS l_quantity, {_r('l_discount')} AS l_discount FROM filled""",
    "standardize": f"""WITH {GAPPY}, m AS (
  SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_discount) AS c,
    stddev_pop(l_discount) AS d FROM filled)
SELECT l_orderkey, l_linenumber, {_r('(l_quantity - a) / b')} AS l_quantity,
  {_r('(l_discount - c) / d')} AS l_discount FROM filled, m""",
    "ols_fit": _coef_rows("0.0"),
    "ridge_fit": _coef_rows(repr(ALPHA_RIDGE)),
    "ridge_coefficients": _coef_rows("5000.0"),
    "lasso_fit": f"""WITH {LINE_FIT}, s AS (
  SELECT *, sign(ca) * greatest(abs(ca) - {ALPHA_LASSO}, 0) AS only_a,
    sign(cb) * greatest(abs(cb) - {ALPHA_LASSO}, 0) AS only_b FROM g),
k AS (
  SELECT *, abs(cb - r * only_a) <= {ALPHA_LASSO} AS drop_b,
    abs(ca - r * only_b) <= {ALPHA_LASSO} AS drop_a,
    ca - sign(ca) * {ALPHA_LASSO} AS ta, cb - sign(cb) * {ALPHA_LASSO} AS tb FROM s)
SELECT 'l_quantity' AS feature, {_r('''CASE WHEN drop_b THEN only_a WHEN drop_a THEN 0
  ELSE (ta - r * tb) / (1 - r * r) END''', 4)} AS coef FROM k
UNION ALL SELECT 'l_discount', {_r('''CASE WHEN drop_b THEN 0 WHEN drop_a THEN only_b
  ELSE (tb - r * ta) / (1 - r * r) END''', 4)} FROM k""",
    "ridge_metrics": f"""WITH {RIDGE_SPLIT}, {_ridge_scores('sum_price', '1')},
{_ridge_scores('avg_discount', '2')}, wide AS (SELECT * FROM wide1 UNION ALL SELECT * FROM wide2),
long AS ({_long_scores('wide', 'target, set')})
SELECT target, set, metric, {_r('value', 4)} AS value FROM long""",
    "nw_predict": f"""WITH {KRN} SELECT q.s_suppkey,
  {_r(f"sum({_weight(repr(H_PREDICT))} * t.y) / sum({_weight(repr(H_PREDICT))})")} AS yhat
FROM krn q, krn t GROUP BY q.s_suppkey""",
    "nw_two_predict": f"""WITH {PAIRS} SELECT q.c_custkey, {_r('h')} AS h,
  {_r(f'sum({_PAIR_WEIGHT} * t.y) / nullif(sum({_PAIR_WEIGHT}), 0)')} AS yhat
FROM hs, pairs q, pairs t WHERE t.y IS NOT NULL GROUP BY hs.h, q.c_custkey""",
    "nw_two_loo_risk": f"""WITH {PAIRS}, loo AS (
  SELECT h, any_value(q.y) AS y,
    sum(CASE WHEN q.c_custkey <> t.c_custkey THEN {_PAIR_WEIGHT} * t.y ELSE 0 END)
    / (sum(CASE WHEN q.c_custkey <> t.c_custkey THEN {_PAIR_WEIGHT} ELSE 0 END) + 1e-12) AS yhat
  FROM hs, pairs q, pairs t WHERE q.y IS NOT NULL AND t.y IS NOT NULL GROUP BY h, q.c_custkey)
SELECT {_r('h')} AS h, {_r('sqrt(avg((y - yhat) ** 2))')} AS rmse_loo FROM loo GROUP BY loo.h""",
    "nw_loo_risk": f"WITH {LOO} SELECT {_r('h')} AS h, {_r('rmse_loo')} AS rmse_loo FROM risk",
    "nw_best_bandwidth": f"""WITH {LOO} SELECT {_r('h')} AS h, {_r('rmse_loo')} AS rmse_loo
FROM risk ORDER BY risk.rmse_loo, risk.h LIMIT 1""",
    "nw_val_risk": f"""WITH {KRN}, {_grid(H_GRID)},
sp AS (SELECT * FROM {_split('krn', 's_suppkey')}), p AS (
  SELECT h, q.s_suppkey, any_value(q.y) AS y, sum({_weight()} * t.y) / nullif(sum({_weight()}), 0) AS yhat
  FROM hs, sp q, sp t WHERE q.split = 'val' AND t.split = 'train' GROUP BY h, q.s_suppkey)
SELECT {_r('h')} AS h, {_r('sqrt(avg((y - yhat) ** 2))')} AS rmse_val FROM p GROUP BY p.h""",
    "nw_local_linear": f"""WITH {KRN}, s AS (
  SELECT q.s_suppkey, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0,
    sum(w * d * y) AS t1 FROM (
      SELECT q.s_suppkey, t.x - q.x AS d, t.y, {_weight(repr(H_PREDICT))} AS w
      FROM krn q, krn t) q GROUP BY q.s_suppkey)
SELECT s_suppkey, {_r('''CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-14 * s0 * s2
  THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END''', 5)} AS yhat FROM s""",
    "nw_metrics": f"""WITH {NW_SPLIT}, long AS ({_long_scores('wide', "'y' AS target, set")})
SELECT target, set, metric, {_r('value')} AS value FROM long""",
    "pairwise_sqdist": f"""WITH {KRN} SELECT q.s_suppkey,
  {_r('sum((q.x - t.x) ** 2 + (q.y - t.y) ** 2)', 4)} AS sum_d2
FROM krn q, krn t GROUP BY q.s_suppkey""",
    "regression_metrics": f"""WITH {SCORED}, w AS (
  SELECT model, set, {_scores('price', 'price_hat')} FROM scored GROUP BY ALL)
SELECT model, set, {_r('RMSE', 4)} AS "RMSE", {_r('MAE', 4)} AS "MAE", {_r('R2', 4)} AS "R2",
  {_r('rRMSE', 4)} AS "rRMSE(%)" FROM w""",
    "residuals": f"""WITH {SCORED} SELECT l_orderkey, l_linenumber, set,
  {_r('price', 4)} AS observed, {_r('price_hat', 4)} AS estimated,
  {_r('price - price_hat', 4)} AS residual FROM scored""",
    "scatter_pairs": " UNION ALL ".join(
        f"""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Grass'
  WHEN 'N' THEN 'Young crop' ELSE 'Unknown' END AS cover, '{v}' AS veg, {_r(v)} AS y,
  '{s}' AS sar, {_r(s)} AS x FROM lineitem"""
        for v in ("l_extendedprice", "l_quantity") for s in ("l_discount", "l_tax")),
    "metric_by_model": f"""WITH {METRIC_ROWS} SELECT model, target, set, {_r('value', 4)} AS value
  FROM long WHERE metric = 'MAE'""",
    "gather_metrics": f"""WITH {METRIC_ROWS} SELECT model, target, metric, set,
  {_r('value', 4)} AS value FROM long""",
    "metrics_table": f'WITH {TABLE} SELECT * FROM tab',
    "metrics_latex_rows": f"""WITH {TABLE} SELECT "Model" || ' & ' || "Target" || """ + " || ".join(
        f"""' & ' || "{c}" """ for c in TABLE_CELLS) + """|| ' \\\\' AS line FROM tab UNION ALL SELECT 'Model & Target & """
    + " & ".join(TABLE_CELLS) + """ \\\\'""",
    "mean_metrics": f'WITH {TABLE} SELECT "Model", ' + ", ".join(
        f"""{_even(f'avg("{c}")')} AS "{c}" """ for c in TABLE_CELLS)
    + ' FROM tab GROUP BY "Model"',
    "best_model": f"""WITH {TABLE} SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (
  PARTITION BY "Target" ORDER BY "R2 (train)" DESC, "Model") AS rk FROM tab) WHERE rk = 1""",
    "latest_model": """SELECT max('l_extendedprice') AS target,
  CASE WHEN count(l_extendedprice) > 0 THEN 'ols l_extendedprice' END AS name FROM lineitem""",
    "model_roundtrip": f"""WITH {LINE_FIT} SELECT l_orderkey, l_linenumber,
  {_r('my + wa * (l_quantity - ma) / sa + wb * (l_discount - mb) / sb', 3)} AS prediction
FROM lineitem, fit""",
}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
