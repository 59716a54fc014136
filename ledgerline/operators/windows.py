"""Window operators.  Every function takes ``by`` so multi-tenant data is
partitioned by tenant; with ``by=[]`` the window runs on one partition, which is
only acceptable on already-aggregated day/month-grain input (thousands of rows).
Frames that share partition+order collapse into a single Window node / sort."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.exprs import col, safe_div


def _w(by: Sequence[str], order: Sequence | str):
    order = [order] if isinstance(order, (str, Column)) else list(order)
    w = Window.partitionBy(*by) if by else Window
    return w.orderBy(*[col(o) for o in order])


def trailing(by: Sequence[str], order, rows: int):
    """ROWS BETWEEN ``rows-1`` PRECEDING AND CURRENT ROW (``rows`` rows in total)."""
    return _w(by, order).rowsBetween(-(rows - 1), 0)


def trailing_calendar(by: Sequence[str], order_col: str, days: int):
    """RANGE over the previous ``days`` calendar days (missing days do not stretch it)."""
    w = Window.partitionBy(*by) if by else Window
    return w.orderBy(F.unix_date(F.col(order_col))).rangeBetween(-(days - 1), 0)


def trailing_sum(df: DataFrame, c: str, rows: int, order, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{c}_sum_{rows}", F.sum(col(c)).over(trailing(by, order, rows)))


def rolling_efficiency_expr(spend, grant, price, w, coalesce_inputs: bool = True) -> Column:
    """(sum spend / sum grant) / (sum(grant * price) / sum grant) over frame ``w``."""
    z = (lambda x: F.coalesce(col(x), F.lit(0.0))) if coalesce_inputs else col
    g = F.coalesce(col(grant), F.lit(0.0))
    cost = safe_div(F.sum(z(spend)).over(w), F.sum(z(grant)).over(w))
    p = col(price) if not coalesce_inputs else F.coalesce(col(price), F.lit(0.0))
    value = safe_div(F.sum(g * p).over(w), F.sum(g).over(w))
    return safe_div(cost, value)


def blended_efficiency_expr(spends: Sequence, bt_grants: Sequence, bt_price, ol_grant, ol_price, w) -> Column:
    """All-channel spend / market value of all grants, inputs coalesced to 0."""
    z = lambda x: F.coalesce(col(x), F.lit(0.0))
    num = sum((z(s) for s in spends[1:]), z(spends[0]))
    bt = sum((z(g) for g in bt_grants[1:]), z(bt_grants[0]))
    den = bt * z(bt_price) + z(ol_grant) * z(ol_price)
    return safe_div(F.sum(num).over(w), F.sum(den).over(w))


def lag_features(df: DataFrame, by: Sequence[str], order: str, c: str, n: int = 12,
                 drop_incomplete: bool = True, prefix: str = "lag_") -> DataFrame:
    w = _w(by, order)
    out = df.withColumns({f"{prefix}{i}": F.lag(c, i).over(w) for i in range(1, n + 1)})
    return out.filter(F.col(f"{prefix}{n}").isNotNull()) if drop_incomplete else out


def sequence_index(df: DataFrame, by: Sequence[str], order, out: str = "t") -> DataFrame:
    return df.withColumn(out, F.row_number().over(_w(by, order)) - 1)


def first_last_value(df: DataFrame, by: Sequence[str], order: str, c: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(c, order).alias(f"first_{c}"), F.max_by(c, order).alias(f"last_{c}"))


def split_holdout(df: DataFrame, by: Sequence[str], order: str, n: int = 12, flag: str = "is_holdout") -> DataFrame:
    w = _w(by, F.col(order).desc())
    return df.withColumn(flag, F.row_number().over(w) <= n)


def difference(df: DataFrame, by: Sequence[str], order: str, c: str, d: int = 1, D: int = 0, m: int = 12,
               out: str | None = None) -> DataFrame:
    """Ordinary (d times, lag 1) then seasonal (D times, lag m) differencing."""
    w = _w(by, order)
    cur = c
    tmp = []
    for i in range(d):
        nm = f"_d{i}"
        df = df.withColumn(nm, F.col(cur) - F.lag(cur, 1).over(w))
        tmp.append(nm)
        cur = nm
    for i in range(D):
        nm = f"_D{i}"
        df = df.withColumn(nm, F.col(cur) - F.lag(cur, m).over(w))
        tmp.append(nm)
        cur = nm
    df = df.withColumn(out or f"{c}_diff", F.col(cur))
    return df.drop(*tmp)


def tile_season(season: DataFrame, horizon: DataFrame, by: Sequence[str], step_col: str = "step",
                pos_col: str = "pos", value: str = "seasonal", m: int = 12) -> DataFrame:
    """Repeat the last ``m`` seasonal values over the horizon: horizon step s takes
    position ``s mod m`` of the last season."""
    return horizon.withColumn(pos_col, F.pmod(F.col(step_col), F.lit(m))).join(season, [*by, pos_col], "left")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1, rank_col: str | None = None) -> DataFrame:
    """Best ``k`` rows per group with a full tie-break (``order`` must be total)."""
    w = (Window.partitionBy(*by) if by else Window).orderBy(*order)
    rn = F.row_number().over(w)
    out = df.withColumn("_rn", rn).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")
