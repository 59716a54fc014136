"""Forecast models of many monthly series as Spark jobs.

Designs, differences and lags are window columns; the normal equations of a fit are grouped sums of
products; one Arrow batch solves the small systems of many series at once; recursive roll-outs are
array folds, one row per series.  Months are counted on the calendar, so a gap in a series shifts neither
its season nor its lags: a month without a value is left out of the sums only.

A series too short for a model gets a forecast that repeats its last value, with a ``reason``; a series
without any value gets null forecasts.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.exprs import safe_div
from ledgerline.plans.forecast import KEYS, PERIODS, decompose, fourier, log_trend, month_index

#: 5 % critical value of the level-stationarity test (fixed value), and the share of the detrended variance
#: that calendar months must explain before a series is differenced over the year.
KPSS_5 = 0.463
SEASONAL_SHARE = 0.64
OUT = ("month", "model", "forecast", "lo", "hi", "reason")


def since(df: DataFrame, starts: Mapping[str, str], key: str = "series") -> DataFrame:
    """Rows from each series' own first training month on; a series that ``starts`` leaves out keeps all."""
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col(key)].cast("date")
    return df.filter(F.coalesce(F.col("month") >= start, F.lit(True)))


def timeline(df: DataFrame, horizon: int, by: Sequence[str] = KEYS, holdout: int = 0) -> DataFrame:
    """Every month from a series' first to ``horizon`` after its last known one, which is ``holdout`` before
    its last row.  Later months are ``is_future`` and have no ``y``; other columns stay where known."""
    span = df.groupBy(*by).agg(F.min("month").alias("_a"), F.add_months(F.max("month"), -holdout).alias("_b"))
    spine = span.select(*by, "_b", F.explode(F.sequence("_a", F.add_months("_b", horizon), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    out = spine.join(df, [*by, "month"], "left").withColumn("is_future", F.col("month") > F.col("_b"))
    return out.withColumn("y", F.when(~F.col("is_future"), F.col("y"))).drop("_b")


def at_most(c: Column, bound) -> Column:
    """The smaller of both; null where ``c`` is null (least and greatest alone skip nulls)."""
    return F.when(c.isNotNull(), F.least(c, bound))


def at_least(c: Column, bound) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, bound))


# ---------------------------------------------------------------------------
# least squares
# ---------------------------------------------------------------------------

def products(names: Sequence[str]) -> Column:
    """The upper triangle of the sums of products of columns, over the rows marked ``ok``."""
    return F.expr("array(" + ", ".join(f"sum(if(ok, {a} * {b}, 0D))" for i, a in enumerate(names) for b in names[i:]) + ")")


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of many symmetric systems (n, k, k), scaled by their diagonals; dependent directions are left out."""
    size = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    return np.linalg.pinv(a / size[:, :, None] / size[:, None, :], rcond=1e-11, hermitian=True) / size[:, :, None] / size[:, None, :]


def unpacked(sums: pd.Series, k: int) -> np.ndarray:
    """The symmetric matrices of sums of products of [x_0 .. x_k-1, y]."""
    upper = np.triu_indices(k + 1)
    flat = np.stack(sums.to_numpy()).astype(float)
    g = np.zeros((len(flat), k + 1, k + 1))
    g[:, upper[0], upper[1]] = flat
    g[:, upper[1], upper[0]] = flat
    return g


def squared_error(g: np.ndarray, coef: np.ndarray, cols: Sequence[int]) -> np.ndarray:
    cols, k = list(cols), g.shape[1] - 1
    return g[:, k, k] - 2 * (coef * g[:, cols, k]).sum(axis=1) + np.einsum("ni,nij,nj->n", coef, g[:, cols][:, :, cols], coef)


def solver(k: int, subsets: Sequence[Sequence[int]], penalty: Sequence[float] | None = None):
    """Column function: products of [x_0 .. x_k-1, y] -> for each subset of the x the coefficients (0 outside it)
    and, last, the squared error.  Dependent columns share the smallest coefficients."""
    ridge = np.array(penalty if penalty is not None else [0.0] * k)

    @F.pandas_udf("array<array<double>>")
    def solve(sums: pd.Series) -> pd.Series:
        g = unpacked(sums, k)
        out = np.zeros((len(g), len(subsets), k + 1))
        for s, cols in enumerate(map(list, subsets)):
            coef = np.einsum("nij,nj->ni", inverse(g[:, cols][:, :, cols] + np.diag(ridge[cols])), g[:, cols, k])
            out[:, s, cols] = coef
            out[:, s, k] = squared_error(g, coef, cols)
        return pd.Series(out.tolist())

    return solve


def chosen_bends(g: np.ndarray, n: np.ndarray, bends: Sequence[int], ridge: np.ndarray, strength: float, sweeps: int = 200) -> np.ndarray:
    """(series, bends): which bends a series needs.  The other columns are projected out of the normal equations, and the bends' unit-length
    parts get l1-penalised coefficients by coordinate descent, all series at once.  The penalty is ``strength`` times the level
    that the largest of so many pure-noise correlations stays under, sigma sqrt(2 log number), sigma from the fit with every bend
    (with none where that leaves under ten degrees of freedom)."""
    k = g.shape[1] - 1
    b, rest = list(bends), [i for i in range(k) if i not in set(bends)]
    gram = g[:, :k, :k] + np.diag(ridge)
    inner = inverse(gram[:, rest][:, :, rest])
    cross = gram[:, b][:, :, rest]
    system = gram[:, b][:, :, b] - cross @ inner @ cross.transpose(0, 2, 1)
    score = g[:, b, k] - np.einsum("nbr,nrs,ns->nb", cross, inner, g[:, rest, k])
    size = np.sqrt(np.maximum(np.einsum("nbb->nb", system), 0))
    live = size > 1e-6 * np.sqrt(np.maximum(np.einsum("nbb->nb", g[:, b][:, :, b]), 1e-300))
    size = np.where(live, size, 1)
    corr, z = system / size[:, :, None] / size[:, None, :], np.where(live, score / size, 0)
    every = np.einsum("nij,nj->ni", inverse(gram), g[:, :k, k])
    none = np.einsum("nij,nj->ni", inner, g[:, rest, k])
    free = n - k
    variance = np.where(free >= 10, squared_error(g, every, range(k)) / np.maximum(free, 1), squared_error(g, none, rest) / np.maximum(n - len(rest), 1))
    limit = strength * np.sqrt(np.maximum(variance, 0) * 2 * np.log(max(len(b), 2))) + 1e-6 * np.sqrt(np.maximum(g[:, k, k], 0))
    beta = np.zeros_like(z)
    for _ in range(sweeps):
        before = beta.copy()
        for j in range(len(b)):
            left = z[:, j] - np.einsum("ni,ni->n", corr[:, j], beta) + beta[:, j] * corr[:, j, j]
            beta[:, j] = np.where(live[:, j], np.sign(left) * np.maximum(np.abs(left) - limit, 0), 0)
        if np.abs(beta - before).max(initial=0) < 1e-9:
            break
    return np.abs(beta) > 1e-9


def sparse_solver(k: int, bends: Sequence[int], penalty: Sequence[float], strength: float = 1.5):
    """Column function: products, number of rows -> coefficients of the ridge fit on the columns outside ``bends`` and the bends chosen
    (0 elsewhere), and, last, the squared error."""
    ridge = np.array(penalty)

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series, n: pd.Series) -> pd.Series:
        g = unpacked(sums, k)
        use = np.ones((len(g), k), bool)
        use[:, list(bends)] = chosen_bends(g, n.to_numpy(dtype=float), bends, ridge, strength)
        gram = (g[:, :k, :k] + np.diag(ridge)) * use[:, :, None] * use[:, None, :] + np.eye(k) * ~use[:, :, None]
        coef = np.einsum("nij,nj->ni", inverse(gram), g[:, :k, k] * use)
        return pd.Series(np.concatenate([coef, squared_error(g, coef, range(k))[:, None]], axis=1).tolist())

    return solve


def dot(coef: Column, columns: Sequence[Column]) -> Column:
    return F.aggregate(F.zip_with(coef, F.array(*columns), lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)


# ---------------------------------------------------------------------------
# seasonal autoregression with differencing and regressors
# ---------------------------------------------------------------------------

def stationarity(df: DataFrame, c: str, out: str, by: Sequence[str], lags: int = 4) -> DataFrame:
    """The level-stationarity (KPSS) statistic of column ``c`` per series, as a column; null for a constant."""
    p, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("month")
    df = df.withColumn("_e", F.col(c) - F.avg(c).over(p))
    walk = F.when(F.col("_e").isNotNull(), F.sum("_e").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    near = sum((F.lit(2 * (1 - j / (lags + 1))) * F.coalesce(F.col("_e") * F.lag("_e", j).over(o), F.lit(0.0)) for j in range(1, lags + 1)), F.col("_e") ** 2)
    df = df.withColumns({"_walk": walk, "_near": near})
    n = F.count("_e").over(p)
    spread = F.sum("_near").over(p)
    eta = F.when(spread > 1e-12, F.sum(F.col("_walk") ** 2).over(p) / (n * spread))
    return df.withColumn(out, eta).drop("_e", "_walk", "_near")


def differenced(df: DataFrame, xs: Sequence[str], by: Sequence[str] = KEYS, seasonal: bool = True, m: int = 12) -> DataFrame:
    """Adds sd (0 or 1 yearly differences: where calendar months explain most of the detrended variance), d (0 to 2
    ordinary ones: the fewest after which the series passes the stationarity test), base, step1 and w, the differenced y,
    and each regressor differenced alike (``d_x``)."""
    p, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("month")
    half = m // 2
    whole = F.count("y").over(o.rowsBetween(-half, half)) == m + 1
    middle = (F.sum("y").over(o.rowsBetween(1 - half, half - 1)) + 0.5 * (F.lag("y", half).over(o) + F.lead("y", half).over(o))) / m
    df = df.withColumn("_flat", F.when(whole, F.col("y") - middle))
    df = df.withColumn("_off", F.col("_flat") - F.avg("_flat").over(Window.partitionBy(*by, F.month("month"))))
    n_flat = F.count("_flat").over(p)
    share = 1 - safe_div(F.sum(F.col("_off") ** 2).over(p), F.var_pop("_flat").over(p) * n_flat)
    df = df.withColumn("sd", F.when(F.lit(seasonal) & (n_flat >= 2 * m) & (share > SEASONAL_SHARE), 1).otherwise(0)).drop("_flat", "_off")

    def year_on_year(c):
        return F.when(F.col("sd") == 1, F.col(c) - F.lag(c, m).over(o)).otherwise(F.col(c))

    names = {"y": ("base", "step1", "step2"), **{x: (f"_{x}0", f"_{x}1", f"_{x}2") for x in xs}}
    df = df.withColumns({b: year_on_year(c) for c, (b, _, _) in names.items()})
    df = df.withColumns({s: F.col(b) - F.lag(b, 1).over(o) for b, s, _ in names.values()})
    df = df.withColumns({t: F.col(s) - F.lag(s, 1).over(o) for _, s, t in names.values()})
    df = stationarity(stationarity(df, "base", "_k0", by), "step1", "_k1", by)
    df = df.withColumn("d", F.when(F.coalesce(F.col("_k0"), F.lit(0.0)) <= KPSS_5, 0).when(F.coalesce(F.col("_k1"), F.lit(0.0)) <= KPSS_5, 1).otherwise(2))
    pick = lambda b, s, t: F.when(F.col("d") == 0, F.col(b)).when(F.col("d") == 1, F.col(s)).otherwise(F.col(t))
    out = df.withColumns({("w" if c == "y" else f"d_{c}"): pick(*n) for c, n in names.items()})
    return out.drop("_k0", "_k1", "step2", *[n for x in xs for n in names[x]])


def shocks(rows: DataFrame, xs: Sequence[str], by: Sequence[str], seasonal: bool, m: int = 12, reach: int = 6) -> DataFrame:
    """Adds ``e``, the part of the differenced value ``w`` that its own past does not explain: the residual of a long autoregression
    (lags 1 to ``reach`` and, if ``seasonal``, m and m + 1) with the regressors, per series.  Months without all lags, or to come, have 0."""
    o = Window.partitionBy(*by).orderBy("month")
    lags = {f"_l{i}": F.lag("w", i).over(o) for i in [*range(1, reach + 1), *([m, m + 1] if seasonal else [])]}
    names = ["one", *[f"d_{x}" for x in xs], *lags]
    rows = rows.withColumns(lags)
    full = ~F.col("is_future")
    for c in [*names, "w"]:
        full = full & F.col(c).isNotNull()
    rows = rows.withColumn("ok", full)
    k = len(names)
    fit = rows.groupBy(*by).agg(products([*names, "w"]).alias("_sums")).select(*by, F.slice(solver(k, [list(range(k))])(F.col("_sums"))[0], 1, k).alias("_long"))
    rows = rows.join(fit, list(by))
    return rows.withColumn("e", F.when(F.col("ok"), F.col("w") - dot(F.col("_long"), [F.col(c) for c in names])).otherwise(0.0)).drop("ok", "_long", *lags)


def seasonal_arma(df: DataFrame, xs: Mapping[str, bool], horizon: int = 36, by: Sequence[str] = KEYS, holdout: int = 0, max_p: int = 2,
                  max_sp: int = 1, max_q: int = 2, max_sq: int = 1, seasonal: bool = True, m: int = 12) -> DataFrame:
    """One row per series with every order's fit.  ``df``: by, month, y and the regressors ``xs`` (name -> hold its last
    value over the horizon, else 0).  Moving-average terms are lags of ``shocks``, so every order is one regression (two stages, no
    iteration).  All orders share one sample (the rows that have every lag), so their AIC compare.
    Columns: sd, d, n, orders (p, sp, q, sq, aic, coef with the squared error last), best, past and ahead (the roll-out's input)."""
    o = Window.partitionBy(*by).orderBy("month")
    rows = timeline(df.select(*by, "month", "y", *xs), horizon, by, holdout)
    rows = rows.withColumns({x: F.coalesce(F.col(x), *([F.last(x, ignorenulls=True).over(o)] if hold else []), F.lit(0.0)) for x, hold in xs.items()})
    rows = differenced(rows, list(xs), by, seasonal, m).withColumn("one", F.lit(1.0))
    rows = shocks(rows, list(xs), by, bool(max_sp or max_sq), m) if max_q or max_sq else rows.withColumn("e", F.lit(0.0))
    lags = {f"w_{i}": F.lag("w", i).over(o) for i in range(1, max_p + 1)} | ({"w_season": F.lag("w", m).over(o)} if max_sp else {})
    lags |= {f"e_{i}": F.lag("e", i, 0.0).over(o) for i in range(1, max_q + 1)} | ({"e_season": F.lag("e", m, 0.0).over(o)} if max_sq else {})
    rows = rows.withColumns(lags)
    names = ["one", *[f"d_{x}" for x in xs], *lags]
    full = ~F.col("is_future")
    for c in [*names, "w"]:
        full = full & F.col(c).isNotNull()
    known = lambda c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(o))
    rows = rows.withColumn("ok", full).withColumns({f"_{c}": known(c) for c in ("w", "base", "step1", "y")})
    per = rows.groupBy(*by).agg(
        products([*names, "w"]).alias("sums"), F.sum(F.col("ok").cast("int")).alias("n"), F.first("sd").alias("sd"), F.first("d").alias("d"),
        F.sort_array(F.collect_list(F.when(~F.col("is_future"), F.struct("month", F.coalesce("_w", F.lit(0.0)).alias("w"), F.col("_base").alias("base"),
                                                                         F.col("_step1").alias("step1"), F.col("_y").alias("y"), "e")))).alias("past"),
        F.sort_array(F.collect_list(F.when(F.col("is_future"), F.struct("month", *[f"d_{x}" for x in xs])))).alias("ahead"))
    k, first = len(names), 1 + len(xs)
    orders = [(p, sp, q, sq) for p in range(max_p + 1) for sp in range(max_sp + 1) for q in range(max_q + 1) for sq in range(max_sq + 1)]
    at_e = first + max_p + max_sp
    subsets = [[*range(first + p), *([first + max_p] if sp else []), *range(at_e, at_e + q), *([at_e + max_q] if sq else [])] for p, sp, q, sq in orders]
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("p", "sp", "q", "sq", "width"), (*order, len(s)))]) for order, s in zip(orders, subsets)])
    per = per.withColumn("coef", solver(k, subsets)(F.col("sums")))

    def scored(c, o):
        sse = F.greatest(c[k], F.col("n") * F.lit(1e-16))
        return F.struct(F.when(F.col("n") > o["width"] + 1, F.col("n") * F.ln(sse / F.col("n")) + 2 * (o["width"] + 1)).alias("aic"),
                        o["p"].alias("p"), o["sp"].alias("sp"), o["q"].alias("q"), o["sq"].alias("sq"), o["width"].alias("width"), c.alias("coef"))

    per = per.withColumn("orders", F.zip_with("coef", table, scored)).drop("sums", "coef")
    return per.withColumn("best", F.array_min(F.filter("orders", lambda x: x["aic"].isNotNull())))


def seasonal_ar(df: DataFrame, xs: Mapping[str, bool], horizon: int = 36, by: Sequence[str] = KEYS, holdout: int = 0, max_p: int = 2,
                max_sp: int = 1, seasonal: bool = True, m: int = 12) -> DataFrame:
    """``seasonal_arma`` without moving-average terms."""
    return seasonal_arma(df, xs, horizon, by, holdout, max_p, max_sp, 0, 0, seasonal, m)


def order_table(fits: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """AIC of every order per series; ``chosen`` marks the smallest, all 0 with a ``reason`` in a series too short to fit any."""
    rows = fits.select(*by, "d", "sd", "n", "best", F.explode("orders").alias("o"))
    short = F.col("best").isNull()
    same = lambda of: F.lit(True) if not of else same(of[1:]) & (F.col(f"o.{of[0]}") == F.coalesce(F.col(f"best.{of[0]}"), F.lit(0)))
    return rows.select(*by, F.col("o.p").alias("p"), "d", F.col("o.q").alias("q"), F.col("o.sp").alias("sp"), "sd", F.col("o.sq").alias("sq"), F.col("o.aic").alias("aic"),
                       F.col("n").cast("int").alias("nobs"), same(["p", "sp", "q", "sq"]).alias("chosen"), F.when(short, "short history").alias("reason"))


def rolled(inputs: Column, ar: Sequence[Column], season: Column, d: Column, sd: Column, w: Column, base: Column, step1: Column, y: Column, m: int,
           ma: Sequence[Column] = (), season_ma: Column | None = None, e: Column | None = None, shock: Column | None = None) -> Column:
    """y over the steps of ``inputs``: each step's w is its input plus the lag terms, then summed back to levels.
    ``w``, ``y`` and ``e`` hold the last ``m`` values, oldest first; ``shock``: each step's own shock (none unless given)."""
    with_e = bool(ma) or season_ma is not None
    zeros = F.array_repeat(F.lit(0.0), m)

    def step(acc, x):
        new = x["u"] + x["v"] + season * acc["w"][0]
        for i, c in enumerate(ar, 1):
            new = new + c * acc["w"][m - i]
        for i, c in enumerate(ma, 1):
            new = new + c * acc["e"][m - i]
        if season_ma is not None:
            new = new + season_ma * acc["e"][0]
        return F.transform(F.array(new), lambda x: F.struct(
            x.alias("w"), F.when(d == 2, acc["step1"] + x).otherwise(x).alias("step1"),
            F.when(d == 0, x).when(d == 1, acc["base"] + x).otherwise(acc["base"] + acc["step1"] + x).alias("base")))[0]

    def fold(acc, x):
        def put(s):
            level = s["base"] + F.when(sd == 1, acc["y"][0]).otherwise(0.0)
            past = [F.concat(F.slice(acc["e"], 2, m - 1), F.array(x["v"])).alias("e")] if with_e else []
            return F.struct(F.concat(F.slice(acc["w"], 2, m - 1), F.array(s["w"])).alias("w"), s["base"].alias("base"), s["step1"].alias("step1"),
                            F.concat(F.slice(acc["y"], 2, m - 1), F.array(level)).alias("y"), *past, F.concat(acc["out"], F.array(level)).alias("out"))
        return F.transform(F.array(step(acc, x)), put)[0]

    steps = F.zip_with(inputs, shock if shock is not None else F.transform(inputs, lambda u: F.lit(0.0)), lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    buffer = [(e if e is not None else zeros).alias("e")] if with_e else []
    start = F.struct(w.alias("w"), base.alias("base"), step1.alias("step1"), y.alias("y"), *buffer, F.array().cast("array<double>").alias("out"))
    return F.aggregate(steps, start, fold, lambda acc: acc["out"])


def arma_forecasts(fits: DataFrame, xs: Sequence[str], max_p: int = 2, max_sp: int = 1, by: Sequence[str] = KEYS, m: int = 12,
                   max_q: int = 2, max_sq: int = 1) -> DataFrame:
    """by, step, month, yhat, se, reason: the best order rolled out over the horizon from the last values and shocks.  The standard
    error sums the squared responses of the whole recursion, moving averages and differences included, to a unit shock."""
    has, first = F.col("best").isNotNull(), 1 + len(xs)
    coef = lambda i: F.coalesce(F.col("best.coef")[i], F.lit(0.0))
    at_e = first + max_p + max_sp
    f = fits.withColumn("last", F.get("past", F.size("past") - 1))
    f = f.withColumns({"d": F.when(has, F.col("d")).otherwise(1), "sd": F.when(has, F.col("sd")).otherwise(0), "ar": F.array(*[coef(first + i) for i in range(max_p)]),
                       "ma": F.array(*[coef(at_e + i) for i in range(max_q)]).cast("array<double>"), "season": coef(first + max_p) if max_sp else F.lit(0.0),
                       "season_ma": coef(at_e + max_q) if max_sq else F.lit(0.0),
                       "base": F.when(has, F.col("last.base")).otherwise(F.col("last.y")), "step1": F.coalesce("last.step1", F.lit(0.0))})
    inputs = F.transform("ahead", lambda r: sum((coef(1 + i) * r[f"d_{x}"] for i, x in enumerate(xs)), coef(0)))
    tail = lambda c: F.slice(F.concat(F.array_repeat(F.lit(0.0), m), F.transform("past", lambda r: F.coalesce(r[c], F.lit(0.0)))), -m, m)
    ar, ma = ([F.col(c)[i] for i in range(k)] for c, k in (("ar", max_p), ("ma", max_q)))
    shape = (ar, F.col("season"), F.col("d"), F.col("sd"))
    average = {"ma": ma, "season_ma": F.col("season_ma") if max_sq else None}
    zero = F.array_repeat(F.lit(0.0), m)
    none = F.transform("ahead", lambda r: F.lit(0.0))
    shock = F.transform("ahead", lambda r, i: F.when(i == 0, 1.0).otherwise(0.0))
    f = f.withColumns({"yhat": rolled(inputs, *shape, tail("w"), F.col("base"), F.col("step1"), tail("y"), m, **average, e=tail("e")),
                       "psi": rolled(none, *shape, zero, F.lit(0.0), F.lit(0.0), zero, m, **average, shock=shock),
                       "s2": safe_div(F.greatest(F.col("best.coef")[F.size("best.coef") - 1], F.lit(0.0)), F.col("n") - F.col("best.width"))})
    rows = f.select(*by, "s2", F.when(~has, "short history").alias("reason"), F.posexplode(
        F.zip_with("ahead", F.arrays_zip("yhat", "psi"), lambda r, v: F.struct(r["month"].alias("month"), v["yhat"].alias("yhat"), v["psi"].alias("psi")))).alias("i", "v"))
    sofar = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, (F.col("i") + 1).alias("step"), "v.month", "v.yhat", F.sqrt(F.col("s2") * F.sum(F.col("v.psi") ** 2).over(sofar)).alias("se"), "reason")


def ar_forecasts(fits: DataFrame, xs: Sequence[str], max_p: int = 2, max_sp: int = 1, by: Sequence[str] = KEYS, m: int = 12) -> DataFrame:
    """``arma_forecasts`` of ``seasonal_ar`` fits."""
    return arma_forecasts(fits, xs, max_p, max_sp, by, m, 0, 0)


def log_input(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """by, month, y = log1p of the value (negative values count as 0), pol = z-scored policy count."""
    p = Window.partitionBy(*by)
    pol = F.coalesce("policy_count", F.lit(0.0))
    z = (pol - F.avg(pol).over(p)) / (F.stddev_pop(pol).over(p) + 1e-8)
    return df.select(*by, "month", F.log1p(at_least(F.col("value"), F.lit(0.0))).alias("y"), z.alias("pol"))


def sarima(df: DataFrame, horizon: int = 36, holdout: int = 0, by: Sequence[str] = KEYS) -> DataFrame:
    """Levels with 95 % bounds of the seasonal autoregressive moving average with the policy count as regressor."""
    f = arma_forecasts(seasonal_arma(log_input(df, by), {"pol": True}, horizon, by, holdout), ["pol"], by=by)
    return f.select(*by, F.lit("seasonal_arma").alias("model"), "month", F.expm1("yhat").alias("forecast"), F.expm1(F.col("yhat") - 1.96 * F.col("se")).alias("lo"),
                    F.expm1(F.col("yhat") + 1.96 * F.col("se")).alias("hi"), "reason")


def fee_rate(rates: DataFrame, premium: DataFrame, donor: DataFrame, spike_month: str, horizon: int = 36, holdout: int = 0,
             cap_growth: float = 1.5) -> DataFrame:
    """Fees = rate x premium.  ``rates``: tenant, month, rate, policy_count; ``premium``: tenant, month, prem; ``donor``: tenant,
    moy, donor_seasonal.  The log rate without the donor's season follows an autoregressive moving average with policy count and spike, grows
    at most ``cap_growth`` a year from its last point, and gets the season back, its bounds too."""
    by = ["tenant"]
    p = Window.partitionBy("tenant")
    season = F.coalesce("donor_seasonal", F.lit(0.0))
    pol = F.coalesce("policy_count", F.lit(0.0))
    src = rates.withColumn("moy", F.month("month")).join(donor, ["tenant", "moy"], "left").select(
        "tenant", "month", (F.ln(F.when(F.col("rate") > 0, F.col("rate"))) - season).alias("y"),
        ((pol - F.avg(pol).over(p)) / (F.stddev_pop(pol).over(p) + 1e-8)).alias("pol"), (F.col("month") == F.lit(spike_month).cast("date")).cast("double").alias("spike"))
    fits = seasonal_arma(src, {"pol": True, "spike": False}, horizon, by, holdout, max_p=3, max_sp=0, max_q=2, max_sq=0, seasonal=False)
    f = arma_forecasts(fits, ["pol", "spike"], 3, 0, by, max_q=2, max_sq=0)
    last = fits.select("tenant", F.get("past", F.size("past") - 1)["y"].alias("last_y"))
    f = f.join(last, "tenant").withColumn("moy", F.month("month")).join(donor, ["tenant", "moy"], "left").join(premium, ["tenant", "month"], "left")
    line = F.col("last_y") + F.lit(math.log(cap_growth) / 12) * F.col("step")
    level = lambda c: F.exp(c + season) * F.col("prem")
    return f.select("tenant", F.lit("fees").alias("series"), F.lit("fee_rate").alias("model"), "month", level(at_most(F.col("yhat"), line)).alias("forecast"),
                    level(at_most(F.col("yhat") - 1.96 * F.col("se"), line)).alias("lo"),
                    level(at_most(F.col("yhat") + 1.96 * F.col("se"), line + 0.5)).alias("hi"), "reason")


# ---------------------------------------------------------------------------
# additive and saturating models
# ---------------------------------------------------------------------------

YEAR = [f"{f}_{k}" for k in range(1, 7) for f in ("sin", "cos") if (f, k) != ("sin", 6)]     # harmonics of twelve months


def harmonic(name: str, moy: Column) -> Column:
    f, k = name.split("_")
    return getattr(F, f)(moy * F.lit(2 * math.pi * int(k) / 12))


def regressors(df: DataFrame, horizon: int, spike_month: str | None, by: Sequence[str], holdout: int = 0) -> DataFrame:
    """Timeline of a training frame (by, month, value, value_w, policy_count): y = log of the winsorised value where
    positive, t in years from the first month, pol (mean 1, held over the horizon), spike and the series' last value."""
    p, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("month")
    v = F.when(F.col("value").isNotNull() & (F.col("value_w") > 0), F.col("value_w"))
    src = df.select(*by, "month", F.ln(v).alias("y"), v.alias("v"),
                    F.coalesce("policy_count", F.lit(0.0)).alias("pol"))
    rows = timeline(src, horizon, by, holdout)
    rows = rows.withColumns({c: F.when(~F.col("is_future"), F.col(c)) for c in ("v", "pol")})       # held-out months are not seen
    t = month_index(F.col("month")) - F.min(month_index(F.col("month"))).over(p)
    mean = F.avg("pol").over(p)
    return rows.withColumns({"one": F.lit(1.0), "t": t / 12.0, "pol": F.coalesce(F.col("pol"), F.last("pol", ignorenulls=True).over(o), F.lit(0.0)) / (mean + 1e-8),
                             "spike": F.coalesce(F.col("month") == F.lit(spike_month).cast("date"), F.lit(False)).cast("double"),
                             "last_v": F.last("v", ignorenulls=True).over(p.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
                             "first_v": F.first("v", ignorenulls=True).over(p.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
                             "ok": F.col("y").isNotNull()})


def least_squares(rows: DataFrame, names: Sequence[str], penalty: Sequence[float], by: Sequence[str], bends: Sequence[str] = ()) -> DataFrame:
    """by, n, coef and sigma (root mean squared error; null without rows) of the ridge fit of y on columns ``names``, of which
    ``bends`` are used only where a series needs them."""
    k = len(names)
    per = rows.groupBy(*by).agg(products([*names, "y"]).alias("sums"), F.sum(F.col("ok").cast("int")).alias("n"))
    at = [list(names).index(b) for b in bends]
    fit = sparse_solver(k, at, penalty)(F.col("sums"), F.col("n")) if bends else solver(k, [list(range(k))], penalty)(F.col("sums"))[0]
    per = per.withColumn("fit", fit)
    return per.select(*by, "n", F.slice("fit", 1, k).alias("coef"), F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("fit")[k], F.lit(0.0)) / F.col("n"))).alias("sigma"))


BENDS = 25          # candidate bends of the trend, evenly over the first 80 % of the history


def additive_design(df: DataFrame, horizon: int, by: Sequence[str], knots: int, holdout: int = 0) -> tuple[DataFrame, list[str], list[float], list[str]]:
    rows = regressors(df, horizon, None, by, holdout)
    p = Window.partitionBy(*by)
    last = F.max(F.when(F.col("ok"), F.col("t"))).over(p)
    rows = rows.withColumn("last_t", last)
    rows = rows.withColumns({f"bend_{i}": F.greatest(F.col("t") - F.lit(0.8 * i / (knots + 1)) * F.col("last_t"), F.lit(0.0)) for i in range(1, knots + 1)})
    rows = rows.withColumns({h: harmonic(h, F.month("month")) for h in YEAR})
    bends = [f"bend_{i}" for i in range(1, knots + 1)]
    return rows, ["one", "t", *bends, *YEAR, "pol"], [0.0, 0.0, *[0.0] * knots, *[0.1] * len(YEAR), 0.1], bends


def additive(df: DataFrame, horizon: int = 36, knots: int = BENDS, cap: float = 2.0, by: Sequence[str] = KEYS, holdout: int = 0) -> DataFrame:
    """Log value on a trend with the bends that it needs out of ``knots``, the year's harmonics and the policy
    count (held), at most ``cap`` times the last training value, with 80 % bounds.  The last ``holdout`` months are not fitted."""
    rows, names, penalty, bends = additive_design(df, horizon, by, knots, holdout)
    f = rows.filter("is_future").join(least_squares(rows, names, penalty, by, bends), list(by))
    f = f.withColumn("yhat", F.when(F.col("n") > 0, dot(F.col("coef"), [F.coalesce(c, F.lit(0.0)) for c in names])))
    level = lambda c: at_most(F.exp(c), cap * F.col("last_v"))
    return f.select(*by, F.lit("additive").alias("model"), "month", level(F.col("yhat")).alias("forecast"), level(F.col("yhat") - 1.28 * F.col("sigma")).alias("lo"),
                    level(F.col("yhat") + 1.28 * F.col("sigma")).alias("hi"), F.when(F.col("n") == 0, "no values").alias("reason"))


def trend_bends(df: DataFrame, by: Sequence[str] = KEYS, knots: int = BENDS) -> DataFrame:
    """by, month, change: the chosen bends of each series' trend, with the change of its yearly log growth."""
    rows, names, penalty, bends = additive_design(df, 0, by, knots)
    span = rows.groupBy(*by).agg(F.min("month").alias("first"), F.max("last_t").alias("last_t"))
    fit = least_squares(rows, names, penalty, by, bends).join(span, list(by))
    at = names.index(bends[0])
    place = F.posexplode(F.slice("coef", at + 1, knots)).alias("i", "change")
    month = F.add_months("first", F.round(F.lit(12 * 0.8 / (knots + 1)) * (F.col("i") + 1) * F.col("last_t")).cast("int"))
    return fit.select(*by, "first", "last_t", place).filter("abs(change) > 1e-12").select(*by, month.alias("month"), "change")


def year_shape(df: DataFrame, by: Sequence[str] = KEYS, knots: int = BENDS, holdout: int = 0) -> DataFrame:
    """by, moy, shape: the yearly part of the additive fit."""
    rows, names, penalty, bends = additive_design(df, 0, by, knots, holdout)
    at = names.index(YEAR[0])
    fit = least_squares(rows, names, penalty, by, bends).select(*by, F.slice("coef", at + 1, len(YEAR)).alias("year"))
    months = fit.select(*by, "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("moy"))
    return months.select(*by, "moy", dot(F.col("year"), [harmonic(h, F.col("moy")) for h in YEAR]).alias("shape"))


def saturating(df: DataFrame, donor: DataFrame, spike_month: str | None, horizon: int = 36, cap: float = 2.0, floor: float = 0.5,
               borrow: float = 0.5, by: Sequence[str] = KEYS, holdout: int = 0) -> DataFrame:
    """Growth between a floor and a cap: the logit of the log value's place between them on time, policy count and spike,
    plus ``borrow`` times the year's shape of a donor (tenant, moy, shape)."""
    rows = regressors(df, horizon, spike_month, by, holdout)
    top, bottom = F.ln(cap * F.col("last_v")), F.ln(floor * F.col("first_v"))
    place = at_most(at_least(safe_div(F.col("y") - bottom, top - bottom), F.lit(1e-4)), F.lit(1 - 1e-4))
    rows = rows.withColumns({"top": top, "bottom": bottom, "y": F.ln(place / (1 - place))}).withColumn("ok", F.col("y").isNotNull())
    names = ["one", "t", "pol", "spike"]
    f = rows.filter("is_future").join(least_squares(rows, names, [0.0, 0.0, 0.1, 0.1], by), list(by))
    f = f.withColumn("moy", F.month("month")).join(donor, ["tenant", "moy"], "left")
    z = F.when(F.col("n") > 0, dot(F.col("coef"), [F.col(c) for c in names]))
    level = lambda z: at_most(F.exp(F.col("bottom") + (F.col("top") - F.col("bottom")) / (1 + F.exp(-z)) + borrow * F.coalesce("shape", F.lit(0.0))), cap * F.col("last_v"))
    return f.select(*by, F.lit("saturating").alias("model"), "month", level(z).alias("forecast"), F.least(level(z - 1.28 * F.col("sigma")), level(z + 1.28 * F.col("sigma"))).alias("lo"),
                    F.greatest(level(z - 1.28 * F.col("sigma")), level(z + 1.28 * F.col("sigma"))).alias("hi"), F.when(F.col("n") == 0, "no values").alias("reason"))


# ---------------------------------------------------------------------------
# residual learner
# ---------------------------------------------------------------------------

WAVES = [f"{f}_{p}" for p in PERIODS for f in ("sin", "cos")]


def residual_rows(df: DataFrame, starts: Mapping[str, str], spike_month: str, horizon: int = 36, n_lags: int = 12, cap_slope: Mapping[str, float] | None = None,
                  by: Sequence[str] = KEYS) -> DataFrame:
    """Timeline with line, season, resid, its min-max scaled form ``sc`` and the features of each month: waves, and the policy
    count (mean 1, held) and the spike (fees only) of each of the ``n_lags`` months before.  The line of a capped
    series continues at most at its slope from the last point."""
    o, p = Window.partitionBy(*by).orderBy("month"), Window.partitionBy(*by)
    trend = log_trend(since(df, starts), "1900-01-01", by=by).select(*by, "slope", "intercept")
    index = decompose(df, by=by, robust=2).select(*by, "moy", "seasonal_index").distinct()
    src = df.select(*by, "month", F.log1p(at_least(F.col("value"), F.lit(0.0))).alias("y"), F.coalesce("policy_count", F.lit(0.0)).alias("pol"))
    rows = timeline(src, horizon, by).withColumn("moy", F.month("month")).join(trend, list(by), "left").join(index, [*by, "moy"], "left")
    t = month_index(F.col("month"))
    last_t, last_y = F.max(F.when(F.col("y").isNotNull(), t)).over(p), F.max_by("y", F.when(F.col("y").isNotNull(), t)).over(p)
    most = F.create_map(*[F.lit(x) for kv in (cap_slope or {"": math.inf}).items() for x in kv])[F.col("series")]
    steep = F.coalesce(F.col("is_future") & (F.col("slope") > most), F.lit(False))
    rows = rows.withColumns({"t": t, "line": F.when(steep, last_y + most * (t - last_t)).otherwise(F.col("intercept") + F.col("slope") * t),
                             "season": F.coalesce("seasonal_index", F.lit(0.0)),
                             "policy": F.coalesce(F.col("pol"), F.last("pol", ignorenulls=True).over(o)) / (F.avg("pol").over(p) + 1e-8),
                             "spike": ((F.col("series") == "fees") & (F.col("month") == F.lit(spike_month).cast("date"))).cast("double")})
    rows = fourier(rows).withColumn("resid", F.col("y") - F.col("intercept") - F.col("slope") * F.col("t") - F.col("season"))
    low, span = F.min("resid").over(p), F.max("resid").over(p) - F.min("resid").over(p) + 1e-12
    rows = rows.withColumns({"low": low, "span": span, "sc": (F.col("resid") - low) / span, "mu": F.avg("resid").over(p), "sdev": F.stddev_pop("resid").over(p)})
    return rows.withColumns({f"{c}_{i}": F.lag(s, i).over(o) for c, s in (("lag", "sc"), ("policy", "policy"), ("spike", "spike")) for i in range(1, n_lags + 1)})


def residual_features(n_lags: int = 12) -> list[str]:
    return [*WAVES, *[f"policy_{i}" for i in range(1, n_lags + 1)], *[f"spike_{i}" for i in range(1, n_lags + 1)]]


def residual_rollout(rows: DataFrame, intercept: float, lags: Sequence[float], features: Mapping[str, float], clip_sd: float = 1.5,
                     by: Sequence[str] = KEYS) -> DataFrame:
    """by, month, is_future, r_hat and forecast (level).  The known months are rolled from the first ``len(lags)`` residuals, the
    horizon from the last; each step is clipped to the mean +- ``clip_sd`` deviations.  Lag 1 is the newest."""
    n = len(lags)
    mid = (F.col("mu") - F.col("low")) / F.col("span")
    band = clip_sd * F.col("sdev") / F.col("span")
    drive = sum((F.lit(float(c)) * F.coalesce(f, F.lit(0.0)) for f, c in features.items()), F.lit(float(intercept)))
    line = F.struct("month", "is_future", F.coalesce("sc", mid).alias("sc"), drive.alias("drive"), (F.col("line") + F.col("season")).alias("rest"))
    per = rows.groupBy(*by).agg(F.sort_array(F.collect_list(line)).alias("all"), *[F.first(c, ignorenulls=True).alias(c) for c in ("low", "span", "mu", "sdev")])
    per = per.select(*by, "low", "span", (mid - band).alias("clo"), (mid + band).alias("chi"), F.filter("all", lambda r: ~r["is_future"]).alias("past"),
                     F.filter("all", lambda r: r["is_future"]).alias("ahead"))
    weights = F.array(*[F.lit(float(c)) for c in lags])

    def roll(steps, newest_first):
        def fold(acc, r):
            raw = r["drive"] + F.aggregate(F.zip_with(weights, acc["buf"], lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)
            return F.transform(F.array(F.least(F.greatest(raw, F.col("clo")), F.col("chi"))), lambda v: F.struct(
                F.concat(F.array(v), F.slice(acc["buf"], 1, n - 1)).alias("buf"),
                F.concat(acc["out"], F.array(F.struct(r["month"].alias("month"), r["is_future"].alias("is_future"), r["rest"].alias("rest"), v.alias("v")))).alias("out")))[0]
        empty = F.array().cast("array<struct<month:date,is_future:boolean,rest:double,v:double>>")
        return F.aggregate(steps, F.struct(newest_first.alias("buf"), empty.alias("out")), fold, lambda acc: acc["out"])

    scaled = F.transform("past", lambda r: r["sc"])
    whole = per.filter(F.size("past") >= n)
    both = F.concat(roll(F.slice("past", F.lit(n + 1), F.size("past")), F.reverse(F.slice(scaled, 1, n))), roll(F.col("ahead"), F.reverse(F.slice(scaled, -n, n))))
    out = whole.select(*by, "low", "span", F.explode(both).alias("r")).select(*by, "r.month", "r.is_future", (F.col("r.v") * F.col("span") + F.col("low")).alias("r_hat"), F.col("r.rest").alias("rest"), F.lit(None).cast("string").alias("reason"))
    # too few months for the lags: the line and the season alone
    short = per.filter(F.size("past") < n).select(*by, F.explode("ahead").alias("r")).select(*by, "r.month", "r.is_future", F.lit(0.0).alias("r_hat"), "r.rest", F.lit("short history").alias("reason"))
    return out.unionByName(short).select(*by, "month", "is_future", "r_hat", F.expm1(F.col("rest") + F.col("r_hat")).alias("forecast"), "reason")
