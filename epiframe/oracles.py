"""DuckDB oracle SQL for every registered query that SQL can express.

The fixture bindings are written once as CTEs (``WITH`` prefixes) over the
driver's pre-registered views, then each oracle states the operator's
semantics directly in SQL.
"""

from __future__ import annotations

from epiframe.queries import (
    COMMENT_KEY, FANOUT, FETCH_KEYS, HORIZON, K, ONE_COUNTRY, SELECTION, WINDOW_END, WINDOW_START,
)

P = """
p_daily AS (
  SELECT c.c_nationkey AS nk, CAST(o.o_orderdate AS DATE) AS date, COUNT(*) AS cases,
         CAST(SUM(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2),
p_cust AS (SELECT c_nationkey AS nk, COUNT(*) AS n_cust FROM customer GROUP BY 1),
p AS (
  SELECT n.n_name AS country_region, d.date, d.cases,
         CASE WHEN d.f > 0 THEN d.f END AS deaths,
         d.cases - LAG(d.cases) OVER (PARTITION BY n.n_name ORDER BY d.date) AS cases_since_prev_day,
         CASE WHEN n.n_name <> 'NATION_4' THEN pc.n_cust END AS population
  FROM p_daily d JOIN nation n ON d.nk = n.n_nationkey LEFT JOIN p_cust pc ON d.nk = pc.nk)"""

U = """
u AS (
  SELECT CAST(user_id AS VARCHAR) AS country_region, CAST(ts AS DATE) AS date,
         COUNT(*) AS cases_since_prev_day
  FROM events GROUP BY 1, 2)"""

D = """
d AS (
  SELECT CASE WHEN n.n_name = 'NATION_1' THEN 'Nation One'
              WHEN n.n_name = 'NATION_2' THEN 'Nation Deux'
              ELSE '  ' || lower(n.n_name) || ' ' END AS country,
         r.r_name AS continent, dc.n_cust AS population_2020,
         CASE WHEN n.n_name = 'NATION_3' THEN CAST(0 AS BIGINT) ELSE ds.n_supp END AS area_km2
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT c_nationkey, COUNT(*) AS n_cust FROM customer GROUP BY 1) dc ON n.n_nationkey = dc.c_nationkey
  LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n_supp FROM supplier GROUP BY 1) ds ON n.n_nationkey = ds.s_nationkey)"""

M = """
m AS (
  SELECT lower(trim(a)) AS src_key, lower(trim(b)) AS dim_key
  FROM (VALUES ('NATION_1', 'Nation One'), ('NATION_2', 'Nation Two'), ('NATION_99', 'Nowhere')) t(a, b))"""

X1 = P + "," + D + "," + M + """,
tot AS (
  SELECT country_region, CAST(SUM(cases) AS BIGINT) AS total_cases, CAST(SUM(deaths) AS BIGINT) AS total_deaths
  FROM p GROUP BY 1),
mapped AS (
  SELECT t.*, COALESCE(m.dim_key, lower(trim(t.country_region))) AS country_key
  FROM tot t LEFT JOIN m ON lower(trim(t.country_region)) = m.src_key),
x1 AS (
  SELECT mp.country_region, mp.total_cases, mp.total_deaths, d.population_2020, d.area_km2,
         CAST(mp.total_cases AS DOUBLE) / NULLIF(CAST(d.population_2020 AS DOUBLE), 0) * 1000000.0 AS cases_per_million,
         CAST(mp.total_deaths AS DOUBLE) / NULLIF(CAST(d.population_2020 AS DOUBLE), 0) * 1000000.0 AS deaths_per_million,
         CAST(mp.total_deaths AS DOUBLE) / NULLIF(CAST(mp.total_cases AS DOUBLE), 0) * 100.0 AS cfr_pct,
         CAST(mp.total_cases AS DOUBLE) / NULLIF(CAST(d.area_km2 AS DOUBLE), 0) AS cases_per_km2,
         CAST(mp.total_deaths AS DOUBLE) / NULLIF(CAST(d.area_km2 AS DOUBLE), 0) AS deaths_per_km2,
         CAST(d.population_2020 AS DOUBLE) / NULLIF(CAST(d.area_km2 AS DOUBLE), 0) AS population_density_calc
  FROM mapped mp JOIN d ON mp.country_key = lower(trim(d.country)))"""

X1_COLS = ("country_region, total_cases, total_deaths, population_2020, area_km2, cases_per_million, "
           "deaths_per_million, cfr_pct, cases_per_km2, deaths_per_km2, population_density_calc")


def r6(cols: list[str]) -> str:
    """``* REPLACE`` clause rounding the given double columns to 6 places."""
    return "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + ")"


X1_DOUBLES = ["cases_per_million", "deaths_per_million", "cfr_pct", "cases_per_km2",
              "deaths_per_km2", "population_density_calc"]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLES: dict[str, str] = {}

# Rounds of the unrolled k-means below; the centres stand still well before.
ROUNDS = 25
# Two-sided 80 % quantile of the normal distribution.
Z80 = 1.2815515594600038

ORACLES["enrich_countries"] = f"WITH {X1} SELECT {r6(X1_DOUBLES)} FROM x1"
ORACLES["unmatched_countries"] = f"""WITH {X1}
SELECT country_region, country_key FROM mapped
WHERE NOT EXISTS (SELECT 1 FROM d WHERE lower(trim(d.country)) = mapped.country_key)"""

_TOT = "SELECT country_region, CAST(SUM(cases) AS BIGINT) AS total_cases, CAST(SUM(deaths) AS BIGINT) AS total_deaths FROM p"
_NEW = "cases_since_prev_day"
_ACTIVE = f"WHERE {_NEW} IS NOT NULL AND {_NEW} > 0"
_SEL = ", ".join(_lit(s) for s in SELECTION)

ORACLES.update({
    "country_totals": f"WITH {P} {_TOT} GROUP BY 1",
    "country_totals_one": f"WITH {P} {_TOT} WHERE lower(trim(country_region)) = lower(trim({_lit(ONE_COUNTRY)})) GROUP BY 1",
    "country_totals_positive": f"WITH {P} {_TOT} GROUP BY 1 HAVING SUM(cases) > 0",
    "row_count": f"WITH {P} SELECT COUNT(*) AS total_rows FROM p",
    "rows_per_country": f"WITH {P} SELECT country_region, COUNT(*) AS total_records FROM p GROUP BY 1",
    "date_range": f"WITH {P} SELECT MIN(date) AS start_date, MAX(date) AS end_date FROM p",
    "completeness": f"""WITH {P} SELECT COUNT(*) AS total_rows, COUNT(cases) AS cases_not_null,
        COUNT(deaths) AS deaths_not_null, COUNT(population) AS population_not_null FROM p""",
    "completeness_new_cases": f"""WITH {P} SELECT COUNT(*) AS total_rows, COUNT({_NEW}) AS cases_not_null,
        COUNT(deaths) AS deaths_not_null, COUNT(population) AS population_not_null FROM p""",
    "new_case_stats_all": f"""WITH {P} SELECT country_region, round(AVG({_NEW}), 6) AS avg_new_cases,
        MAX({_NEW}) AS max_new_cases, MIN({_NEW}) AS min_new_cases FROM p GROUP BY 1""",
    "new_case_stats_active": f"""WITH {P} SELECT country_region, round(AVG({_NEW}), 6) AS avg_new_cases,
        MAX({_NEW}) AS max_new_cases, MIN({_NEW}) AS min_new_cases FROM p {_ACTIVE} GROUP BY 1""",
    "daily_new_all": f"WITH {P} SELECT date, CAST(SUM({_NEW}) AS BIGINT) AS total_new_cases FROM p GROUP BY 1",
    "daily_new_active": f"WITH {P} SELECT date, CAST(SUM({_NEW}) AS BIGINT) AS total_new_cases FROM p {_ACTIVE} GROUP BY 1",
    "daily_new_window": f"""WITH {P} SELECT date, CAST(SUM({_NEW}) AS BIGINT) AS total_new_cases FROM p
        {_ACTIVE} AND date BETWEEN DATE '{WINDOW_START}' AND DATE '{WINDOW_END}' GROUP BY 1""",
    "top_deaths": f"""WITH {P} SELECT country_region, CAST(SUM(deaths) AS BIGINT) AS total_deaths FROM p
        GROUP BY 1 ORDER BY total_deaths DESC NULLS LAST, country_region LIMIT 10""",
    "preview_totals": f"WITH {P} {_TOT} GROUP BY 1 ORDER BY total_cases DESC NULLS LAST, country_region LIMIT 5",
    "country_list": f"WITH {X1} SELECT DISTINCT country_region FROM x1 WHERE country_region IS NOT NULL",
    "axis_bound": f"WITH {X1} SELECT round(COALESCE(MAX(cfr_pct) * 1.2, 1.0), 6) AS axis_max FROM x1",
    "selected_countries": f"WITH {X1} SELECT {r6(X1_DOUBLES)} FROM x1 WHERE country_region IN ({_SEL})",
    "finite_rows": f"""WITH {X1} SELECT {r6(X1_DOUBLES)} FROM x1
        WHERE population_density_calc IS NOT NULL AND isfinite(population_density_calc)
          AND cases_per_million IS NOT NULL AND isfinite(cases_per_million)""",
})


def _waves_sql(src: str) -> str:
    """UP+ PLATEAU* DOWN+ over ``src``(country_region, date, x) as a regular
    expression over one letter per row: a wave starts at an U after no U, ends
    at the next D before no D, and all letters between must match."""
    return f"""
c AS (
  SELECT country_region, date, x, ROW_NUMBER() OVER w AS i,
         CASE WHEN x IS NULL OR LAG(x) OVER w IS NULL THEN 'N'
              WHEN x > LAG(x) OVER w THEN 'U' WHEN x = LAG(x) OVER w THEN 'P' ELSE 'D' END AS k
  FROM {src} WINDOW w AS (PARTITION BY country_region ORDER BY date)),
s AS (SELECT country_region, string_agg(k, '' ORDER BY i) AS letters FROM c GROUP BY 1),
edge AS (SELECT c.*, s.letters, k = 'U' AND (i = 1 OR letters[i - 1] <> 'U') AS starts,
                k = 'D' AND (i = length(letters) OR letters[i + 1] <> 'D') AS ends
         FROM c JOIN s USING (country_region)),
pair AS (SELECT *, MIN(CASE WHEN ends THEN i END) OVER (PARTITION BY country_region ORDER BY i
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM edge),
wave AS (SELECT country_region, i, j FROM pair
         WHERE starts AND j IS NOT NULL AND regexp_full_match(letters[i:j], 'U+P*D+'))
SELECT wave.country_region, MIN(c.date) AS wave_start_date, MAX(c.date) AS wave_end_date,
       CAST(SUM(c.x) AS BIGINT) AS total_cases_in_wave, MAX(c.x) AS peak_cases_in_wave
FROM wave JOIN c ON c.country_region = wave.country_region AND c.i BETWEEN wave.i AND wave.j
GROUP BY wave.country_region, wave.i"""


ORACLES.update({
    "direction_class": f"""WITH {P} SELECT country_region, date, {_NEW},
        CASE WHEN {_NEW} IS NULL OR LAG({_NEW}) OVER w IS NULL THEN NULL
             WHEN {_NEW} > LAG({_NEW}) OVER w THEN 'UP' WHEN {_NEW} = LAG({_NEW}) OVER w THEN 'PLATEAU'
             ELSE 'DOWN' END AS direction
        FROM p WINDOW w AS (PARTITION BY country_region ORDER BY date)""",
    "waves_country": f"WITH {P}, px AS (SELECT country_region, date, {_NEW} AS x FROM p), {_waves_sql('px')}",
    "waves_user": f"WITH {U}, ux AS (SELECT country_region, date, {_NEW} AS x FROM u), {_waves_sql('ux')}",
    "waves_events": f"""WITH ex AS (SELECT event_type AS country_region, event_id AS date, CAST(floor(value) AS BIGINT) AS x FROM events),
        {_waves_sql('ex')}""",
})


_PRUNED = f"SELECT date, country_region, {_NEW}, deaths, population FROM p"
_STATS_ACTIVE = f"""SELECT country_region, round(AVG({_NEW}), 6) AS avg_new_cases,
        MAX({_NEW}) AS max_new_cases, MIN({_NEW}) AS min_new_cases FROM p {_ACTIVE} GROUP BY 1"""
_DEATHS = f"WITH {P} SELECT country_region, CAST(SUM(deaths) AS BIGINT) AS total_deaths FROM p GROUP BY 1"

C = """
cm AS (
  SELECT ' Nation_' || CAST(conv_id % 25 AS VARCHAR) || ' ' AS country_key, text AS comment_text,
         role AS "user", CAST(NULL AS VARCHAR) AS source, 'turn ' || CAST(turn AS VARCHAR) AS additional_notes
  FROM conversations)"""
_CM = 'SELECT lower(trim(country_key)) AS country_key, comment_text, "user", source, additional_notes FROM cm'

ORACLES.update({
    "table_copy": f"WITH {P} SELECT * FROM p",
    "pruned_copy": f"WITH {P} {_PRUNED}",
    "active_copy": f"WITH {P} {_PRUNED} {_ACTIVE}",
    "clustered_window": ORACLES["daily_new_window"],
    "view_daily_new": ORACLES["daily_new_active"],
    "view_deaths": _DEATHS,
    "view_new_stats": f"WITH {P} {_STATS_ACTIVE}",
    "stream_daily_new": ORACLES["daily_new_active"],
    "stream_deaths": _DEATHS,
    "stream_new_stats": f"WITH {P} {_STATS_ACTIVE}",
    "comments_append": f"WITH {C} {_CM}",
    "comments_for_key": f"""WITH {C}, s AS ({_CM})
        SELECT *, COUNT(*) OVER () AS count FROM s WHERE country_key = lower(trim({_lit(COMMENT_KEY)}))""",
    "comments_fanout": f"""WITH {C} SELECT lower(trim(k.c)) AS country_key, comment_text, "user", source, additional_notes
        FROM cm, (VALUES {", ".join("(" + _lit(c) + ")" for c in FANOUT)}) k(c)""",
    "comments_selected": f"""WITH {C}, s AS ({_CM}
          UNION ALL SELECT lower(trim(k.c)), comment_text, "user", source, additional_notes
          FROM cm, (VALUES {", ".join("(" + _lit(c) + ")" for c in FANOUT)}) k(c))
        SELECT * FROM s WHERE country_key IN ({", ".join("lower(trim(" + _lit(k) + "))" for k in FETCH_KEYS)})""",
    "stream_comments": f"WITH {C} {_CM}",
})


def _features_sql(src: str) -> str:
    """``feat``(e, f0, f1) from ``src``(country_region, total_cases, total_deaths)."""
    return f"""
lg AS (SELECT country_region AS e, ln(1 + total_cases) AS f0, ln(1 + total_deaths) AS f1
       FROM {src} WHERE total_cases IS NOT NULL AND total_deaths IS NOT NULL),
st AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1 FROM lg),
feat AS (SELECT e, round((f0 - m0) / CASE WHEN s0 = 0 THEN 1 ELSE s0 END, 9) AS f0,
                   round((f1 - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 9) AS f1 FROM lg, st),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY f0, f1, e) - 1 AS rn, COUNT(*) OVER () AS n FROM feat),
c_0 AS (SELECT t.range AS cid, r.f0 AS c0, r.f1 AS c1 FROM ranked r JOIN range({K}) t
        ON r.rn = ((2 * t.range + 1) * r.n) // (2 * {K}))"""


def _assign_sql(i: int) -> str:
    return f"""
a_{i} AS (
  SELECT e, f0, f1, cid FROM (
    SELECT f.e, f.f0, f.f1, c.cid,
           ROW_NUMBER() OVER (PARTITION BY f.e ORDER BY
             round((f.f0 - c.c0) * (f.f0 - c.c0) + (f.f1 - c.c1) * (f.f1 - c.c1), 9), c.cid) AS q
    FROM feat f, c_{i} c) WHERE q = 1)"""


def _lloyd_sql(rounds: int) -> str:
    parts = []
    for i in range(rounds):
        parts.append(_assign_sql(i))
        parts.append(f"""
c_{i + 1} AS (
  SELECT c.cid, COALESCE(u.c0, c.c0) AS c0, COALESCE(u.c1, c.c1) AS c1
  FROM c_{i} c LEFT JOIN (SELECT cid, round(avg(f0), 9) AS c0, round(avg(f1), 9) AS c1 FROM a_{i} GROUP BY cid) u
  ON c.cid = u.cid)""")
    parts.append(_assign_sql(rounds))
    parts.append(f"""
lab AS (SELECT cid, CAST(ROW_NUMBER() OVER (ORDER BY c0, c1, cid) - 1 AS INTEGER) AS cluster FROM c_{rounds})""")
    return ",".join(parts)


_TOT_POS = "tp AS (SELECT country_region, CAST(SUM(cases) AS BIGINT) AS total_cases, CAST(SUM(deaths) AS BIGINT) AS total_deaths FROM p GROUP BY 1 HAVING SUM(cases) > 0)"
_CUST = """ct AS (SELECT CAST(o_custkey AS VARCHAR) AS country_region, COUNT(*) AS total_cases,
             CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS total_deaths
             FROM orders GROUP BY 1)"""
_LABELS = f"{_TOT_POS}, {_features_sql('tp')}, {_lloyd_sql(ROUNDS)}"


def _nan_null(expr: str, alias: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE round({expr}, 6) END AS {alias}"


_FIT = """pts AS (SELECT ln(1 + population_density_calc) AS x, ln(1 + cases_per_million) AS y FROM {src}
          WHERE isfinite(population_density_calc) AND isfinite(cases_per_million)
            AND population_density_calc > -1 AND cases_per_million > -1),
fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, COUNT(*) AS n FROM pts)"""

ORACLES.update({
    "scaled_features": f"WITH {P}, {_TOT_POS}, {_features_sql('tp')} SELECT e AS country_region, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM feat",
    "kmeans_step": f"""WITH {_CUST}, {_features_sql('ct')}, {_assign_sql(0)}
        SELECT CAST(cid AS INTEGER) AS cluster, COUNT(*) AS members, round(round(avg(f0), 9), 6) AS c0,
               round(round(avg(f1), 9), 6) AS c1 FROM a_0 GROUP BY cid""",
    "cluster_countries": f"WITH {P}, {_LABELS} SELECT a.e AS country_region, l.cluster FROM a_{ROUNDS} a JOIN lab l USING (cid)",
    "chart_clusters": f"""WITH {X1}, {_LABELS}
        SELECT x1.country_region, round(x1.cases_per_million, 6) AS cases_per_million,
               round(x1.deaths_per_million, 6) AS deaths_per_million, x1.population_2020,
               CAST(l.cluster AS VARCHAR) AS cluster
        FROM x1 JOIN a_{ROUNDS} a ON a.e = x1.country_region JOIN lab l USING (cid)""",
    "density_fit": f"""WITH {X1}, {_FIT.format(src='x1')}
        SELECT {_nan_null('slope', 'slope')}, {_nan_null('intercept', 'intercept')}, {_nan_null('r2', 'r2')}, n FROM fit""",
    "chart_density": f"""WITH {X1}, sel AS (SELECT * FROM x1 WHERE country_region IN ({_SEL})), {_FIT.format(src='sel')}
        SELECT country_region, round(population_density_calc, 6) AS population_density_calc,
               round(cases_per_million, 6) AS cases_per_million,
               round(exp(intercept + slope * ln(1 + COALESCE(population_density_calc, 0))) - 1, 6) AS fitted
        FROM sel, fit""",
    "chart_cases_deaths": f"""WITH {X1} SELECT country_region, round(cases_per_million, 6) AS cases_per_million,
        round(deaths_per_million, 6) AS deaths_per_million, population_2020, round(cfr_pct, 6) AS cfr_pct
        FROM x1 WHERE country_region IN ({_SEL}) AND cases_per_million > 0 AND deaths_per_million > 0""",
    "chart_cfr_top20": f"""WITH {X1} SELECT country_region, round(cfr_pct, 6) AS cfr_pct, printf('%.2f%%', round(cfr_pct, 2)) AS cfr_label,
        (SELECT round(COALESCE(MAX(cfr_pct) * 1.2, 1.0), 6) FROM x1) AS axis_max
        FROM x1 ORDER BY cfr_pct DESC NULLS LAST, country_region LIMIT 20""",
})


def _forecast_sql(where: str = "") -> str:
    return f"""
h AS (SELECT country_region AS e, date AS ds, COALESCE(CAST(cases AS DOUBLE), 0) AS y FROM p
      WHERE date IS NOT NULL {where}),
h1 AS (SELECT *, date_diff('day', MIN(ds) OVER (PARTITION BY e), ds) AS t, dayofweek(ds) AS dow FROM h),
h2 AS (SELECT *, regr_intercept(y, t) OVER (PARTITION BY e) AS a, regr_slope(y, t) OVER (PARTITION BY e) AS b,
              COUNT(*) OVER (PARTITION BY e) AS n, AVG(t) OVER (PARTITION BY e) AS tbar,
              VAR_POP(t) OVER (PARTITION BY e) * COUNT(*) OVER (PARTITION BY e) AS sxx,
              MIN(ds) OVER (PARTITION BY e) AS t0 FROM h1),
h3 AS (SELECT *, AVG(y - a - b * t) OVER (PARTITION BY e, dow) AS s FROM h2),
h4 AS (SELECT *, STDDEV_POP(y - a - b * t - s) OVER (PARTITION BY e) AS sigma FROM h3),
prm AS (SELECT e, MAX(ds) AS last_ds, ANY_VALUE(a) AS a, ANY_VALUE(b) AS b, ANY_VALUE(n) AS n,
               ANY_VALUE(tbar) AS tbar, ANY_VALUE(sxx) AS sxx, ANY_VALUE(sigma) AS sigma, ANY_VALUE(t0) AS t0
        FROM h4 GROUP BY e),
seas AS (SELECT DISTINCT e, dow, s FROM h4),
fut AS (SELECT prm.*, CAST(prm.last_ds + CAST(g.i AS INTEGER) AS DATE) AS ds FROM prm, generate_series(1, {HORIZON}) g(i)),
fut1 AS (SELECT f.*, date_diff('day', f.t0, f.ds) AS t, seas.s FROM fut f
         LEFT JOIN seas ON seas.e = f.e AND seas.dow = dayofweek(f.ds)),
rows AS (SELECT e, ds, t, a, b, s, n, tbar, sxx, sigma, FALSE AS is_future FROM h4
         UNION ALL SELECT e, ds, t, a, b, s, n, tbar, sxx, sigma, TRUE FROM fut1),
pred AS (SELECT e, ds, is_future, a + b * t + COALESCE(s, 0) AS yhat,
                {Z80} * sigma * sqrt(1 + 1.0 / NULLIF(n, 0) + (t - tbar) * (t - tbar) / NULLIF(sxx, 0)) AS spread
         FROM rows)"""


_PRED_COLS = "round(yhat, 6) AS yhat, round(yhat - spread, 6) AS yhat_lower, round(yhat + spread, 6) AS yhat_upper"
_HIST_ONE = f"SELECT date AS ds, COALESCE(CAST(cases AS DOUBLE), 0) AS y FROM p WHERE lower(trim(country_region)) = lower(trim({_lit(ONE_COUNTRY)}))"

ORACLES.update({
    "history_one": f"WITH {P} {_HIST_ONE}",
    "history_with_count": f"WITH {P}, s AS ({_HIST_ONE}) SELECT *, COUNT(*) OVER () AS count FROM s",
    "future_frame": f"""WITH {P}, h AS (SELECT country_region, date AS ds FROM p WHERE date IS NOT NULL),
        l AS (SELECT country_region, MAX(ds) AS last_ds FROM h GROUP BY 1)
        SELECT country_region, ds, FALSE AS is_future FROM h
        UNION ALL SELECT country_region, CAST(last_ds + CAST(g.i AS INTEGER) AS DATE), TRUE FROM l, generate_series(1, {HORIZON}) g(i)""",
    "forecast_all": f"WITH {P}, {_forecast_sql()} SELECT e AS country_region, ds, {_PRED_COLS}, is_future FROM pred",
    "chart_forecast": f"""WITH {P}, {_forecast_sql(f"AND country_region = {_lit(SELECTION[0])}")}
        SELECT pred.ds, {_PRED_COLS}, h.y FROM pred LEFT JOIN h ON h.e = pred.e AND h.ds = pred.ds""",
})


# Spark type names of the enriched table's columns, in order.
X1_TYPES = [("country_region", "string"), ("total_cases", "bigint"), ("total_deaths", "bigint"),
            ("population_2020", "bigint"), ("area_km2", "bigint")] + [(c, "double") for c in X1_DOUBLES]
X1_NUMERIC = [c for c, _ in X1_TYPES[1:]]
P_COLS = ["country_region", "date", "cases", "deaths", "cases_since_prev_day", "population"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _numeric_sql(c: str, src: str = "x1", places: int = 6) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, COUNT({x}) AS n,
        CAST(SUM(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
        CAST(SUM(CASE WHEN {x} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zeros,
        CAST(SUM(CASE WHEN {x} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
        round(MIN({x}), {places}) AS min, round(MAX({x}), {places}) AS max, round(AVG({x}), {places}) AS mean,
        round(STDDEV_SAMP({x}), {places}) AS std,
        round(quantile_disc({x}, 0.25), {places}) AS p25, round(quantile_disc({x}, 0.5), {places}) AS p50,
        round(quantile_disc({x}, 0.75), {places}) AS p75,
        round(CASE WHEN VAR_POP({x}) = 0 THEN NULL
                   ELSE AVG(POWER({x} - (SELECT AVG(CAST({c} AS DOUBLE)) FROM {src}), 3)) / POWER(VAR_POP({x}), 1.5) END, {places}) AS skewness,
        round(CASE WHEN VAR_POP({x}) = 0 THEN NULL
                   ELSE AVG(POWER({x} - (SELECT AVG(CAST({c} AS DOUBLE)) FROM {src}), 4)) / POWER(VAR_POP({x}), 2) - 3 END, {places}) AS kurtosis
        FROM {src}"""


def _hist_sql(c: str, src: str = "x1") -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, b AS bin, round(lo + b * w, 6) AS lo, round(lo + (b + 1) * w, 6) AS hi, COUNT(*) AS freq
        FROM (SELECT CASE WHEN w = 0 THEN 0 ELSE LEAST(CAST(FLOOR(({x} - lo) / w) AS INTEGER), 9) END AS b, lo, w
              FROM {src}, (SELECT MIN({x}) AS lo, (MAX({x}) - MIN({x})) / 10.0 AS w FROM {src}) s WHERE {x} IS NOT NULL)
        GROUP BY b, lo, w"""


def _corr_sql(cols: list[str] = X1_NUMERIC, src: str = "x1") -> str:
    num = ", ".join(f"CAST({c} AS DOUBLE) AS c{i}" for i, c in enumerate(cols))
    complete = " AND ".join(f"c{i} IS NOT NULL" for i in range(len(cols)))
    ranks = ", ".join(f"rank() OVER (ORDER BY c{i}) + (COUNT(*) OVER (PARTITION BY c{i}) - 1) / 2.0 AS r{i}"
                      for i in range(len(cols)))
    parts = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            pe = f"(SELECT corr(c{i}, c{j}) FROM num)"
            sp = f"(SELECT corr(r{i}, r{j}) FROM rk)"
            parts.append(f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
                CASE WHEN isnan({pe}) THEN NULL ELSE round({pe}, 6) END AS pearson,
                CASE WHEN isnan({sp}) THEN NULL ELSE round({sp}, 6) END AS spearman""")
    return f"""num AS (SELECT {num} FROM {src}), rk AS (SELECT {ranks} FROM num WHERE {complete})
        {_union(parts)}"""


_TOPV = _union([f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS freq
                   FROM p WHERE {c} IS NOT NULL GROUP BY 2""" for c in P_COLS])
_MISSING = _union([f"""SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
                      round(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 6) AS pct_missing FROM p"""
                   for c in P_COLS])

ORACLES.update({
    "profile_info": f"""WITH {X1} {_union([f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT({c}) AS non_null, {i} AS position FROM x1"
                                            for i, (c, t) in enumerate(X1_TYPES)])}""",
    "profile_overview": f"""WITH {P} SELECT COUNT(*) AS n_rows, CAST({len(P_COLS)} AS BIGINT) AS n_columns,
        CAST(SUM({" + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in P_COLS)}) AS BIGINT) AS missing_cells,
        (SELECT CAST(COALESCE(SUM(k - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS k FROM p GROUP BY {", ".join(P_COLS)})) AS duplicate_rows
        FROM p""",
    "profile_numeric": f"WITH {X1} {_union([_numeric_sql(c) for c in X1_NUMERIC])}",
    "profile_top_values": f"""WITH {P}, cnt AS ({_TOPV}),
        rk AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY freq DESC, value) AS INTEGER) AS rank,
                      COUNT(*) OVER (PARTITION BY column_name) AS n_distinct,
                      CAST(SUM(freq) OVER (PARTITION BY column_name) AS BIGINT) AS n_values FROM cnt)
        SELECT * FROM rk WHERE rank <= 5""",
    "profile_histogram": f"WITH {X1} {_union([_hist_sql(c) for c in X1_NUMERIC])}",
    "profile_corr": f"WITH {X1}, {_corr_sql()}",
    "profile_missing": f"WITH {P} {_MISSING}",
})


# Catalog metadata and JSON export: the expected rows follow from the tables
# the query writes (three copies of the panel) and from the panel's columns.
ORACLES.update({
    "chart_history_json": f"""WITH {P}, s AS ({_HIST_ONE})
        SELECT CAST(to_json(struct_pack(ds := ds, y := y)) AS VARCHAR) AS record FROM s""",
})


_BUILT = {
    "panel_full": ("country_region,date,cases,deaths,cases_since_prev_day,population", "cases", "p"),
    "panel_pruned": (f"date,country_region,{_NEW},deaths,population", _NEW, "p"),
    "panel_active": (f"date,country_region,{_NEW},deaths,population", _NEW, "act"),
    "agg_daily_new_cases": ("date,total_new_cases", "t", f"(SELECT SUM({_NEW}) AS t FROM act GROUP BY date)"),
    "agg_total_deaths": ("country_region,total_deaths", "t", "(SELECT SUM(deaths) AS t FROM p GROUP BY country_region)"),
    "agg_new_case_stats": ("country_region,sum_new_cases,n_new_cases,max_new_cases,min_new_cases", "t",
                           f"(SELECT SUM({_NEW}) AS t FROM act GROUP BY country_region)"),
}
ORACLES["warehouse_build"] = f"WITH {P}, act AS (SELECT * FROM p {_ACTIVE}) " + _union([
    f"SELECT '{t}' AS table_name, '{cols}' AS columns, COUNT(*) AS n_rows, CAST(SUM({c}) AS BIGINT) AS total FROM {src}"
    for t, (cols, c, src) in _BUILT.items()])

# Files with bad, fractional and missing numbers: the dimension as it must read back.
_X1_FILES = X1.replace("d AS (", "d0 AS (", 1).replace("""GROUP BY 1) ds ON n.n_nationkey = ds.s_nationkey)""", """GROUP BY 1) ds ON n.n_nationkey = ds.s_nationkey),
d AS (SELECT * REPLACE (CASE upper(trim(country)) WHEN 'NATION_5' THEN NULL WHEN 'NATION_6' THEN NULL
                             WHEN 'NATION_8' THEN 1000000 ELSE population_2020 END AS population_2020) FROM d0)""", 1)

_P_NUM = ["cases", "deaths", _NEW, "population"]
_P_TEXT = ["country_region", "date"]
_P_TYPES = dict(zip(P_COLS, ["string", "date", "bigint", "bigint", "bigint", "bigint"]))


def _cells(section: str, rows: str, numbers: list[str], texts: list[str] = (), key: str = "", column: str = "column_name") -> str:
    """The cells of one report section (see ``flat_report``)."""
    item = f" || ' ' || coalesce(CAST({key} AS VARCHAR), 'none')" if key else ""
    return _union([f"SELECT '{section}' AS section, {column} AS column_name, '{c}'{item} AS item, "
                   + (f"CAST({c} AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS number" if c in texts
                      else f"CAST(NULL AS VARCHAR), round(CAST({c} AS DOUBLE), 6)") + f" FROM ({rows}) r" for c in [*texts, *numbers]])


def _report_sql() -> str:
    info = _union([f"SELECT '{c}' AS column_name, '{t}' AS data_type, COUNT({c}) AS non_null, {i} AS position FROM p"
                   for i, (c, t) in enumerate(_P_TYPES.items())])
    top = _union([f"""SELECT '{c}' AS column_name, value, freq, rank, n_distinct, n_values FROM (
        SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS freq, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR)) AS rank,
               COUNT(*) OVER () AS n_distinct, SUM(COUNT(*)) OVER () AS n_values
        FROM p WHERE {c} IS NOT NULL GROUP BY 1) WHERE rank <= 5""" for c in _P_TEXT])
    numeric = _union([_numeric_sql(c, "p") for c in _P_NUM])
    hist = _union([_hist_sql(c, "p") for c in _P_NUM])
    overview = ORACLES["profile_overview"].split("SELECT COUNT(*) AS n_rows", 1)[1]
    corr_with, corr_rows = _corr_sql(_P_NUM, "p").split("\n", 1)
    return f"WITH {P}, {corr_with} " + _union([
        _cells("info", info, ["non_null", "position"], ["data_type"]),
        _cells("overview", "SELECT COUNT(*) AS n_rows" + overview, ["n_rows", "n_columns", "missing_cells", "duplicate_rows"], column="''"),
        _cells("numeric", numeric, ["n", "n_missing", "n_zeros", "n_negative", "min", "max", "mean", "std", "p25", "p50", "p75",
                                    "skewness", "kurtosis"]),
        _cells("top_values", top, ["freq", "n_distinct", "n_values"], ["value"], key="rank"),
        _cells("histogram", hist, ["lo", "hi", "freq"], key="bin"),
        _cells("missing", _MISSING, ["n_missing", "pct_missing"]),
        _cells("correlations", corr_rows, ["pearson", "spearman"], key="column_b", column="column_a")])


_PRICE = "CAST(o_totalprice AS DOUBLE)"
ORACLES.update({
    "warehouse_active": f"WITH {P} {_PRUNED} {_ACTIVE}",
    "view_new_stats_ordered": ORACLES["view_new_stats"],
    "view_daily_new_ordered": ORACLES["view_daily_new"],
    "view_top_deaths": ORACLES["top_deaths"],
    "cluster_customers": f"""WITH {_CUST}, {_features_sql('ct')}, {_lloyd_sql(ROUNDS)}
        SELECT l.cluster, COUNT(*) AS members, round(round(avg(f0), 6), 5) AS c0, round(round(avg(f1), 6), 5) AS c1
        FROM a_{ROUNDS} a JOIN lab l USING (cid) GROUP BY 1""",
    "profile_report": _report_sql(),
    "profile_order_prices": _numeric_sql("o_totalprice", "orders", 4),
    "rank_orders": f"""SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY {_PRICE}, o_orderkey) - 1 AS position,
        RANK() OVER (ORDER BY {_PRICE}) + (COUNT(*) OVER (PARTITION BY {_PRICE}) - 1) / 2.0 AS avg_rank FROM orders""",
    "histogram_infinite": f"""WITH x AS (
          SELECT CASE o_orderkey % 50 WHEN 1 THEN 'infinity'::DOUBLE WHEN 2 THEN '-infinity'::DOUBLE WHEN 3 THEN NULL ELSE {_PRICE} END AS price FROM orders),
        f AS (SELECT price FROM x WHERE isfinite(price)), h AS ({_hist_sql('price', 'f').replace(', 6)', ', 4)')})
        SELECT * FROM h UNION ALL
        SELECT 'price', NULL, price, price, COUNT(*) FROM x WHERE isinf(price) GROUP BY price""",
    "metric_labels": f"""WITH {X1} SELECT country_region, CASE WHEN cases_per_km2 IS NULL THEN NULL
        ELSE printf('%.2f%%', round(cases_per_km2, 2)) END AS label FROM x1""",
    "panel_records": f"WITH {P} SELECT CAST(to_json(p) AS VARCHAR) AS record FROM p",
    "enriched_csv": f"WITH {_X1_FILES} SELECT {r6(X1_DOUBLES)} FROM x1",
    "history_coerced": f"""WITH {P} SELECT country_region, date AS ds,
        CASE WHEN day(date) IN (1, 2) THEN 0 ELSE CAST(cases AS DOUBLE) END AS y FROM p WHERE day(date) <> 31""",
    "forecast_changepoints": f"""WITH {P} SELECT country_region, COUNT(*) + {HORIZON} AS n_rows, CAST({HORIZON} AS BIGINT) AS n_future,
        MIN(date) AS first_ds, CAST(MAX(date) + {HORIZON} AS DATE) AS last_ds, TRUE AS band_ordered, TRUE AS residuals_cancel,
        TRUE AS band_widens FROM p GROUP BY 1""",
})


_CHANGED_ROWS = """
f0 AS (SELECT o_orderkey % 10 AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS v,
              CASE WHEN o_orderstatus = 'F' THEN 1 END AS dead FROM orders),
f AS (SELECT CAST(c AS VARCHAR) AS country_region, d AS date, v, dead FROM f0 WHERE k NOT IN (2, 3, 4, 5)
      UNION ALL
      SELECT CAST(c + 7 AS VARCHAR), CAST(d + 1 AS DATE), v - 10000000, CASE WHEN d < DATE '1998-01-01' THEN dead END FROM f0 WHERE k IN (2, 3))"""

ORACLES.update({
    "changed_daily_new": f"WITH {_CHANGED_ROWS} SELECT date, CAST(SUM(v) AS BIGINT) AS total_new_cases FROM f WHERE v > 0 GROUP BY 1",
    "changed_deaths": f"WITH {_CHANGED_ROWS} SELECT country_region, CAST(SUM(dead) AS BIGINT) AS total_deaths FROM f GROUP BY 1",
    "changed_new_stats": f"""WITH {_CHANGED_ROWS} SELECT country_region, CAST(SUM(v) AS BIGINT) AS sum_new_cases, COUNT(*) AS n_new_cases,
        MAX(v) AS max_new_cases, MIN(v) AS min_new_cases FROM f WHERE v > 0 GROUP BY 1""",
})


_LOGGED = f"""s AS ({_CM} UNION ALL SELECT lower(trim(k.c)), comment_text, "user", source, additional_notes
          FROM cm, (VALUES {", ".join("(" + _lit(c) + ")" for c in [*FANOUT, FANOUT[0]])}) k(c))"""
_SENT = """
sent AS (SELECT conv_id % 10 = 0 AS cut, conv_id % 11 = 0 AS bare, 'nation_' || (conv_id % 25) AS country_key, text AS comment_text, role AS "user",
                conv_id || '-' || turn AS id FROM conversations)"""

ORACLES.update({
    "comment_log_key": f"""WITH {C}, {_LOGGED} SELECT *, COUNT(*) OVER () AS count FROM s WHERE country_key = lower(trim({_lit(FANOUT[0])}))""",
    "comment_log_selected": f"""WITH {C}, {_LOGGED}
        SELECT * FROM s WHERE country_key IN ({", ".join("lower(trim(" + _lit(k) + "))" for k in FETCH_KEYS)})""",
    "stream_comments_checked": f"""WITH {_SENT} SELECT country_key, comment_text, "user" FROM sent
        WHERE NOT cut AND NOT bare AND comment_text IS NOT NULL AND "user" IS NOT NULL""",
    "stream_comment_rejects": f"""WITH {_SENT}, r AS (SELECT id, CASE WHEN cut THEN 'unreadable' WHEN comment_text IS NULL THEN 'missing comment_text'
          WHEN bare OR "user" IS NULL THEN 'missing user' END AS reason FROM sent)
        SELECT reason, 2 * COUNT(*) AS n_lines, COUNT(DISTINCT id) AS n_different FROM r WHERE reason IS NOT NULL GROUP BY 1""",
})


ORACLES.update({
    "curved_country": f"WITH {P} SELECT * FROM p WHERE country_region = {_lit(SELECTION[2])}",
    "curved_window": ORACLES["clustered_window"],
})


ORACLES.update({
    "rebuild_changed_month": f"""WITH w AS ({ORACLES["warehouse_build"]})
        SELECT table_name, n_rows, total, '1996-03' AS months_written FROM w""",
    "nearest_countries": f"""WITH {P}, {D}, pairs AS (
          SELECT l.name, r.name AS nearest, levenshtein(l.name, r.name) AS distance
          FROM (SELECT DISTINCT lower(trim(country_region)) AS name FROM p) l LEFT JOIN (SELECT DISTINCT lower(trim(country)) AS name FROM d) r
               ON levenshtein(l.name, r.name) <= 3)
        SELECT name, nearest, CAST(distance AS INTEGER) AS distance FROM pairs
        QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY distance, nearest) = 1""",
})


ORACLES.update({
    "comments_stamped": f"""WITH {C} SELECT COUNT(*) AS n_rows, COUNT(*) AS n_stamped, COUNT(*) AS n_ids, CAST(1 AS BIGINT) AS n_times, TRUE AS fresh FROM cm""",
    "guarded_operators": f"""WITH {P}, px AS (SELECT country_region, date, {_NEW} AS x FROM p), w AS (WITH {_waves_sql('px')}),
        n AS (SELECT 'direction_class' AS operator, COUNT(*) AS n_rows FROM p UNION ALL SELECT 'waves', COUNT(*) FROM w
              UNION ALL SELECT 'history', COUNT(*) FROM p)
        SELECT operator, n_rows, CAST(0 AS BIGINT) AS n_rows_empty, TRUE AS refuses FROM n""",
})
