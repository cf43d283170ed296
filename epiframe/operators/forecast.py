"""History series and an all-entities forecaster.

The reference fits an additive trend + seasonality model per single
country.  Here every entity is fitted in one job with native aggregates:

    t      = days since the entity's first date
    a, b   = regr_intercept(y, t), regr_slope(y, t)
    s[dow] = mean residual per weekday
    sigma  = population std of the remaining residual
    yhat   = a + b t + s[dow]
    band   = yhat +/- z sigma sqrt(1 + 1/n + (t - tbar)^2 / Sxx)   (80 %: z = 1.2816)

Every window is partitioned by the entity (weekday windows by entity and
weekday), so history rows are shuffled once; a task holds one entity's
series, bounded by its number of dates.  Future rows are exploded from each
entity's last fitted row in the same pass (no union, no second scan).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from epiframe.operators.filters import for_entity
from epiframe.operators.guards import require_columns
from epiframe.session import materialise

Z80 = 1.2815515594600038  # two-sided 80 % normal quantile
HORIZON_DEFAULT = 30


def history(df: DataFrame, country: str | None = None, entity: str = "country_region",
            date: str = "date", value: str = "cases") -> DataFrame:
    """M6 + P4-P6: (entity, ds, y); dates coerced (bad -> row dropped), values
    coerced to double with NULL -> 0.  ``country`` picks one entity (P9)."""
    require_columns(df, entity, date, value)
    rows = for_entity(df, country, entity) if country is not None else df
    out = rows.select(F.col(entity).alias(entity), F.col(date).try_cast("date").alias("ds"),
                      F.coalesce(F.col(value).try_cast("double"), F.lit(0.0)).alias("y"))
    return out.dropna(subset=["ds"])


def _fit(hist: DataFrame, entity: str) -> DataFrame:
    w = Window.partitionBy(entity)
    wd = Window.partitionBy(entity, "_dow")
    h = (hist.withColumn("_t", F.datediff("ds", F.min("ds").over(w)))
         .withColumn("_dow", F.dayofweek("ds") - 1))
    h = h.withColumns({
        "_a": F.regr_intercept("y", "_t").over(w), "_b": F.regr_slope("y", "_t").over(w),
        "_n": F.count(F.lit(1)).over(w), "_tbar": F.avg("_t").over(w),
        "_sxx": F.var_pop("_t").over(w) * F.count(F.lit(1)).over(w),
        "_t0": F.min("ds").over(w)})
    h = h.withColumn("_s", F.avg(F.col("y") - F.col("_a") - F.col("_b") * F.col("_t")).over(wd))
    return h.withColumn("_sigma", F.stddev_pop(F.col("y") - F.col("_a") - F.col("_b") * F.col("_t")
                                               - F.col("_s")).over(w))


def _predict(df: DataFrame, seasonal) -> DataFrame:
    yhat = F.col("_a") + F.col("_b") * F.col("_t") + F.coalesce(seasonal, F.lit(0.0))
    spread = F.lit(Z80) * F.col("_sigma") * F.sqrt(
        F.lit(1.0) + F.try_divide(F.lit(1.0), F.col("_n").cast("double"))
        + F.try_divide((F.col("_t") - F.col("_tbar")) * (F.col("_t") - F.col("_tbar")), F.col("_sxx")))
    return df.withColumn("yhat", yhat).withColumn("yhat_lower", F.col("yhat") - spread) \
             .withColumn("yhat_upper", F.col("yhat") + spread)


def _extend(df: DataFrame, horizon: int, entity: str) -> DataFrame:
    """Every row once (step 0); each entity's last row also ``horizon`` more
    times (steps 1..horizon) — history and future rows in one pass, no union
    and no second scan of the input."""
    steps = F.when(F.col("ds") == F.col("_last"), F.sequence(F.lit(0), F.lit(horizon))).otherwise(F.array(F.lit(0)))
    return (df.withColumn("_last", F.max("ds").over(Window.partitionBy(entity)))
            .withColumn("_step", F.explode(steps))
            .withColumn("ds", F.date_add("ds", F.col("_step")))
            .withColumn("is_future", F.col("_step") > 0))


def future_dates(hist: DataFrame, horizon: int = HORIZON_DEFAULT, entity: str = "country_region") -> DataFrame:
    """M8: history dates plus ``horizon`` days after each entity's last date."""
    _check_horizon(horizon)
    return _extend(hist.select(entity, "ds"), horizon, entity).select(entity, "ds", "is_future")


def forecast(hist: DataFrame, horizon: int = HORIZON_DEFAULT, entity: str = "country_region",
             with_actuals: bool = False) -> DataFrame:
    """M7 + M9: (entity, ds, yhat, yhat_lower, yhat_upper, is_future) for every
    history date and ``horizon`` future days of every entity.  No clipping at
    zero; an entity with a single date has no slope, so its yhat is NULL.
    The weekday effects travel as a per-entity map (at most 7 entries) so
    future rows are generated from the fitted rows in the same pass.
    ``with_actuals`` keeps the observed ``y`` beside each history row (NULL
    for the future) — J5 without joining the history back.
    Precondition: (entity, ds) is unique, as in a panel."""
    _check_horizon(horizon)
    require_columns(hist, entity, "ds", "y")
    fitted = _fit(hist, entity).withColumn(
        "_seas", F.map_from_entries(F.collect_set(F.struct("_dow", "_s")).over(Window.partitionBy(entity))))
    grown = (_extend(fitted, horizon, entity)
             .withColumn("_t", F.col("_t") + F.col("_step"))
             .withColumn("_dow", F.dayofweek("ds") - 1))
    seasonal = F.when(F.col("_step") == 0, F.col("_s")).otherwise(F.try_element_at("_seas", F.col("_dow")))
    out = _predict(grown, seasonal)
    cols = [entity, "ds", "yhat", "yhat_lower", "yhat_upper", "is_future"]
    if with_actuals:
        return out.select(*cols, F.when(~F.col("is_future"), F.col("y")).alias("y"))
    return out.select(*cols)


def _check_horizon(h: int) -> None:
    if h < 1:
        raise ValueError(f"horizon must be a positive number of days, got {h}")


# --- level 2: changepoint trend + Fourier seasonality, from sums per entity ---------

WEEK, YEAR = 7, 365.25
WEEKLY_ORDER, YEARLY_ORDER = 3, 10
_SUMS = {"n": "1D", "u": "_u", "uu": "_u * _u", "y": "_y", "uy": "_u * _y", "yy": "_y * _y"}


def _trig(name: str, j: int):
    """sin or cos of ``j`` turns a year."""
    angle = F.col("_days") * F.lit(2.0 * math.pi * j / YEAR)
    return F.sin(angle) if name == "s" else F.cos(angle)


def fit_sums(hist: DataFrame, entity: str = "country_region", n_changepoints: int = 25, changepoint_range: float = 0.8,
             yearly: bool = True) -> DataFrame:
    """What the level-2 fit needs of the history: sums per (entity, trend segment,
    day of the week), at most (n_changepoints + 1) * 7 rows per entity.

    Time runs from 0 to 1 over an entity's history; its k changepoints (at most
    ``n_changepoints``, fewer than its dates less one) divide the first
    ``changepoint_range`` of it evenly.  Inside a segment every trend term is linear
    in the distance u from the segment's start, the weekly terms depend on the day
    only, and products of yearly terms are sums of yearly terms; so the sums of u,
    u^2, y, of sines and cosines and of their products with u and y give the whole
    Gram matrix and the moments.  They are plain sums, added up map-side: a series
    may lie in any number of tasks."""
    span = hist.groupBy(entity).agg(F.min("ds").alias("_first"), F.max("ds").alias("_last"), F.count(F.lit(1)).alias("_n"),
                                    F.greatest(F.max(F.abs("y")), F.lit(1.0)).alias("_scale"))
    k = F.least(F.lit(n_changepoints), F.greatest(F.col("_n") - 2, F.lit(0))).cast("int")
    span = span.withColumn("_k", k).withColumn("_span", F.greatest(F.datediff("_last", "_first"), F.lit(1)).cast("double"))
    rows = hist.join(span, entity).withColumn("_days", F.datediff("ds", "_first")).withColumn("_y", F.col("y") / F.col("_scale"))
    step = F.lit(float(changepoint_range)) / (F.col("_k") + 1)
    t = F.col("_days") / F.col("_span")
    rows = rows.withColumn("_seg", F.least(F.col("_k"), F.floor(t / step).cast("int"))).withColumn("_u", t - F.col("_seg") * step)
    sums = {name: F.expr(x) for name, x in _SUMS.items()}
    if yearly:
        sums |= {f"{f}{j}": _trig(f, j) for f in "sc" for j in range(1, 2 * YEARLY_ORDER + 1)}
        sums |= {f"{by}{f}{j}": F.col(f"_{by}") * _trig(f, j) for by in "uy" for f in "sc" for j in range(1, YEARLY_ORDER + 1)}
    keys = [entity, "_first", "_last", "_n", "_scale", "_k", "_span", "_seg", (F.col("_days") % WEEK).alias("_day")]
    return rows.groupBy(*keys).agg(*[F.sum(x).alias(name) for name, x in sums.items()])


def _week(day):
    """The weekly terms of a day of the week: sines, then cosines."""
    import numpy as np
    angle = 2.0 * np.pi * np.outer(np.asarray(day, float), np.arange(1, WEEKLY_ORDER + 1)) / WEEK
    return np.hstack([np.sin(angle), np.cos(angle)])


def _normal_equations(g, changepoint_range: float, weekly: bool, yearly: bool):
    """(Gram matrix, moments) of the terms [1, t, changepoints, weekly, yearly] from
    the rows of ``fit_sums`` of one entity."""
    import numpy as np

    k = int(g["_k"].iloc[0])
    seg = g["_seg"].to_numpy()
    at = changepoint_range * np.arange(k + 1) / (k + 1)  # where segments start
    n, u, uu, y, uy = (g[c].to_numpy() for c in ("n", "u", "uu", "y", "uy"))
    # a trend term is base + rise * u
    begun = np.arange(1, k + 1) <= seg[:, None]
    base = np.column_stack([np.ones(len(g)), at[seg], np.where(begun, at[seg][:, None] - at[1:], 0.0)])
    rise = np.column_stack([np.zeros(len(g)), np.ones(len(g)), begun.astype(float)])
    blocks = [[(base * n[:, None]).T @ base + (base * u[:, None]).T @ rise + (rise * u[:, None]).T @ base + (rise * uu[:, None]).T @ rise]]
    moments = [base.T @ y + rise.T @ uy]
    if weekly:
        w = _week(g["_day"])
        blocks.append([(base * n[:, None] + rise * u[:, None]).T @ w, (w * n[:, None]).T @ w])
        moments.append(w.T @ y)
    if yearly:
        names = [f"{f}{j}" for f in "sc" for j in range(1, YEARLY_ORDER + 1)]
        plain, by_u, by_y = (g[[f"{x}{c}" for c in names]].to_numpy() for x in ("", "u", "y"))
        total = {f: np.concatenate([[n.sum() if f == "c" else 0.0], [g[f"{f}{j}"].sum() for j in range(1, 2 * YEARLY_ORDER + 1)]]) for f in "sc"}
        i, j = np.meshgrid(np.arange(1, YEARLY_ORDER + 1), np.arange(1, YEARLY_ORDER + 1), indexing="ij")
        more, less = i + j, np.abs(i - j)
        ss, cc = (total["c"][less] - total["c"][more]) / 2, (total["c"][less] + total["c"][more]) / 2
        sc = (total["s"][more] + np.sign(i - j) * total["s"][less]) / 2
        column = [base.T @ plain + rise.T @ by_u]
        if weekly:
            column.append(w.T @ plain)
        blocks.append([*column, np.block([[ss, sc], [sc.T, cc]])])
        moments.append(by_y.sum(axis=0))
    size = len(blocks)
    full = [[blocks[max(i, j)][min(i, j)] if i <= j else blocks[i][j].T for j in range(size)] for i in range(size)]
    return np.block(full), np.concatenate(moments)


def lasso(s, g, penalty: float):
    """The x that makes x'sx / 2 - g'x + penalty * |x|_1 least, exactly: signs are
    guessed for an active set, the quadratic is solved for them, and a sign that
    would turn is set to zero at the best point on the way (feature-sign search)."""
    import numpy as np

    x, signs = np.zeros(len(g)), np.zeros(len(g))
    tolerance = 1e-10 * max(1.0, np.abs(g).max(initial=0.0))

    def objective(z):
        return z @ s @ z / 2 - g @ z + penalty * np.abs(z).sum()

    for _ in range(50 * (len(g) + 1)):
        slope = s @ x - g
        idle = np.where(x == 0, np.abs(slope), 0.0)
        at = int(idle.argmax()) if len(g) else 0
        settled = np.all(np.abs(slope + penalty * signs)[x != 0] <= tolerance)
        if settled:
            if not len(g) or idle[at] <= penalty + tolerance:
                return x
            signs[at] = -np.sign(slope[at])
        active = np.flatnonzero(signs)
        new = np.zeros(len(g))
        new[active] = np.linalg.lstsq(s[np.ix_(active, active)], g[active] - penalty * signs[active], rcond=None)[0]
        # the points where a coefficient passes zero, and the end
        turns = [x[i] / (x[i] - new[i]) for i in active if x[i] * new[i] < 0]
        path = []
        for share in [*turns, 1.0]:
            z = x + share * (new - x)
            z[np.abs(z) < 1e-14 * (1 + np.abs(new).max())] = 0.0
            path.append(z)
        best = min(path, key=objective)
        if objective(best) >= objective(x) - 1e-15 * (1 + abs(objective(x))) and not settled:
            return x
        if settled and objective(best) >= objective(x):
            return x
        x, signs = best, np.sign(best)
    return x


def solve(gram, moments, k: int, changepoint_penalty: float, seasonality_penalty: float):
    """Coefficients of least (sum of squares) / 2 + changepoint_penalty * sum of |slope
    changes| + seasonality_penalty / 2 * sum of squared seasonal terms.  All but the
    slope changes are eliminated first; what is left is a lasso of ``k`` numbers."""
    import numpy as np

    turn = np.arange(2, 2 + k)
    rest = np.setdiff1d(np.arange(len(moments)), turn)
    ridge = np.where(rest < 2, 0.0, seasonality_penalty)
    inner = gram[np.ix_(rest, rest)] + np.diag(ridge)
    back = np.linalg.solve(inner, np.column_stack([gram[np.ix_(rest, turn)], moments[rest]]))
    cross = gram[np.ix_(turn, rest)]
    beta = np.zeros(len(moments))
    beta[turn] = lasso(gram[np.ix_(turn, turn)] - cross @ back[:, :k], moments[turn] - cross @ back[:, k], changepoint_penalty)
    beta[rest] = back[:, k] - back[:, :k] @ beta[turn]
    return beta


FIT_SCHEMA = ("{entity} string, _first date, _last date, _span double, level double, slope double, turns array<double>, points array<double>, "
              "week array<double>, year array<double>, sigma double, drift double")


def changepoint_fits(hist: DataFrame, entity: str = "country_region", n_changepoints: int = 25, changepoint_range: float = 0.8,
                     changepoint_penalty: float = 0.01, seasonality_penalty: float = 0.1, weekly: str = "auto",
                     yearly: str = "auto") -> DataFrame:
    """One row of coefficients per entity with two dates or more, from ``fit_sums``:
    Python sees these sums, never a row of the history.

    sigma is the spread of the residuals.  drift is the variance that slope
    changes to come add to the trend per unit of time cubed: they are expected as
    often as in the history, and as large (a Laplace scale b of the mean |slope
    change|, variance 2 b^2, acting for the time that is left: 2 b^2 rate s^3 / 3)."""
    def fit(g):
        import numpy as np
        import pandas as pd

        row = g.iloc[0]
        if row["_n"] < 2:
            return pd.DataFrame(columns=names)
        days = (row["_last"] - row["_first"]).days
        on = {"weekly": weekly == "on" or weekly == "auto" and days >= WEEK, "yearly": yearly == "on" or yearly == "auto" and days >= YEAR}
        gram, moments = _normal_equations(g, changepoint_range, **on)
        k, scale = int(row["_k"]), row["_scale"]
        beta = solve(gram, moments, k, changepoint_penalty, seasonality_penalty)
        rss = max(0.0, g["yy"].sum() - 2 * beta @ moments + beta @ gram @ beta)
        turns = beta[2:2 + k]
        at = 2 + k
        week = _week(np.arange(WEEK)) @ beta[at:at + 2 * WEEKLY_ORDER] if on["weekly"] else np.zeros(WEEK)
        at += 2 * WEEKLY_ORDER * on["weekly"]
        year = beta[at:] if on["yearly"] else np.zeros(2 * YEARLY_ORDER)
        drift = 2 * np.abs(turns).mean() ** 2 * k / changepoint_range / 3 if k else 0.0
        return pd.DataFrame([[str(row[entity]), row["_first"], row["_last"], row["_span"], beta[0] * scale, beta[1] * scale, turns * scale,
                              changepoint_range * np.arange(1, k + 1) / (k + 1), week * scale, year * scale,
                              np.sqrt(rss / row["_n"]) * scale, drift * scale ** 2]], columns=names)

    schema = FIT_SCHEMA.format(entity=f"`{entity}`")
    names = [entity, "_first", "_last", "_span", "level", "slope", "turns", "points", "week", "year", "sigma", "drift"]
    return fit_sums(hist, entity, n_changepoints, changepoint_range, yearly != "off").groupBy(entity).applyInPandas(fit, schema)


def forecast_changepoints(hist: DataFrame, horizon: int = HORIZON_DEFAULT, entity: str = "country_region",
                          n_changepoints: int = 25, changepoint_range: float = 0.8,
                          changepoint_penalty: float = 0.01, seasonality_penalty: float = 0.1,
                          weekly: str = "auto", yearly: str = "auto") -> DataFrame:
    """M7 + M9 (level 2): per entity a piecewise-linear trend whose slope may change at
    up to ``n_changepoints`` points, evenly spaced over the first
    ``changepoint_range`` of the history, the changes under an L1 penalty (most are
    zero), plus weekly and yearly Fourier terms under a ridge, each ``"on"``,
    ``"off"`` or ``"auto"`` (on if the entity's history spans the period).

    The 80 % band holds the residual spread and, in the future, the spread of slope
    changes to come (``changepoint_fits``), so it widens with the horizon.  Rows:
    every history date and ``horizon`` future days, as ``forecast``; NULL for an
    entity with a single date.  The fit reads sums per entity
    (``fit_sums``); the predictions are column arithmetic on its coefficients.
    Precondition: (entity, ds) is unique, as in a panel."""
    _check_horizon(horizon)
    require_columns(hist, entity, "ds", "y")
    if not {weekly, yearly} <= {"on", "off", "auto"}:
        raise ValueError(f"weekly and yearly must be on, off or auto, got {weekly}, {yearly}")
    rows = materialise(hist.select(F.col(entity).cast("string").alias(entity), "ds", F.col("y").cast("double").alias("y")), "history")
    fits = materialise(changepoint_fits(rows, entity, n_changepoints, changepoint_range, changepoint_penalty, seasonality_penalty,
                                        weekly, yearly), "fits")
    ends = rows.groupBy(entity).agg(F.max("ds").alias("_end"))
    future = ends.select(entity, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_step"), "_end").select(
        entity, F.date_add("_end", F.col("_step")).alias("ds"), F.lit(True).alias("is_future"))
    every = rows.select(entity, "ds", F.lit(False).alias("is_future")).unionByName(future)
    out = every.join(fits, entity, "left").withColumn("_days", F.datediff("ds", "_first"))
    t = F.col("_days") / F.col("_span")
    bent = F.aggregate(F.zip_with("turns", "points", lambda d, c: d * F.greatest(t - c, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    season = F.get("week", F.pmod("_days", F.lit(WEEK)))
    for i, (f, j) in enumerate((f, j) for f in "sc" for j in range(1, YEARLY_ORDER + 1)):
        season = season + F.get("year", F.lit(i)) * _trig(f, j)
    ahead = F.greatest(F.datediff("ds", "_last"), F.lit(0)) / F.col("_span")
    spread = F.lit(Z80) * F.sqrt(F.col("sigma") * F.col("sigma") + F.col("drift") * ahead * ahead * ahead)
    out = out.withColumn("yhat", F.col("level") + F.col("slope") * t + bent + season).withColumn("_spread", spread)
    return out.select(entity, "ds", "yhat", (F.col("yhat") - F.col("_spread")).alias("yhat_lower"),
                      (F.col("yhat") + F.col("_spread")).alias("yhat_upper"), "is_future")
