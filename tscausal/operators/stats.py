"""Statistics of edges and forecasts: false discovery control, rank tests, error metrics, equal-accuracy tests."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation, normal_cdf, temporal_class


def benjamini_hochberg(df: DataFrame, p: str, valid: Column | None = None, family: list[str] | None = None, name: str = "p_fdr") -> DataFrame:
    """Adjusted p-values over one family (or each of ``family``); rows that are not valid or have no p stay null.

    The family has to be complete: a family is sorted as a whole.
    """
    keep = F.col(p).isNotNull() if valid is None else F.coalesce(valid, F.lit(False)) & F.col(p).isNotNull()
    df = df.withColumn("_in", keep)
    parts = [*(family or []), "_in"]
    m = F.count("*").over(Window.partitionBy(*parts))
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(p))
    df = df.withColumn("_q", F.col(p) * m / rank).withColumn("_r", rank)
    least = F.min("_q").over(Window.partitionBy(*parts).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col("_in"), F.least(least, F.lit(1.0)))).drop("_in", "_q", "_r")


def causal_evidence(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds p_fdr (over all edges, before any filter by time), significance, the class of the lag, and evidence."""
    edges = benjamini_hochberg(edges, "p_value", F.col("status") == "OK")
    significant = F.coalesce((F.col("p_fdr") < alpha) & F.col("convergence_diagnostic_pass") & F.col("obs_lag").isNotNull(), F.lit(False))
    edges = edges.withColumn("statistically_significant", significant)
    return edges.withColumn("lag_resolution", temporal_class("statistically_significant", "obs_lag")).withColumn("causal_evidence", F.coalesce(F.col("statistically_significant") & (F.col("obs_lag") >= 0), F.lit(False)))


def empirical_p(null: Column, observed: Column) -> Column:
    """Aggregate: (1 + nulls at least as large) / (1 + valid nulls)."""
    return (F.count(F.when(null >= observed, 1)) + 1) / (F.count(null) + 1)


@lru_cache(maxsize=64)
def _inversions(n: int) -> tuple[int, ...]:
    """Permutations of n by number of inversions (Mahonian numbers)."""
    row = [1]
    for k in range(2, n + 1):
        row = [sum(row[max(0, i - k + 1) : i + 1]) for i in range(len(row) + k - 1)]
    return tuple(row)


def kendall(x: list[float], y: list[float]) -> tuple[float, float]:
    """Kendall's tau-b and its two-sided p: exact without ties, else normal."""
    n = len(x)
    sign = lambda a: (a > 0) - (a < 0)
    pairs = [(sign(x[j] - x[i]), sign(y[j] - y[i])) for i in range(n) for j in range(i)]
    total, s = n * (n - 1) // 2, sum(a * b for a, b in pairs)
    tx, ty = (sum(1 for p in pairs if p[k] == 0) for k in (0, 1))
    if n < 2 or tx == total or ty == total:
        return math.nan, math.nan
    tau = s / math.sqrt((total - tx) * (total - ty))
    if not tx and not ty and n <= 171:
        table = _inversions(n)
        less = min((total - s) // 2, (total + s) // 2)
        return tau, min(1.0, 2 * sum(table[: less + 1]) / math.factorial(n))
    counts = [sorted([v.count(u) for u in set(v)]) for v in (x, y)]
    v0 = n * (n - 1) * (2 * n + 5)
    vx, vy = (sum(t * (t - 1) * (2 * t + 5) for t in c) for c in counts)
    x1, y1 = (sum(t * (t - 1) for t in c) for c in counts)
    x2, y2 = (sum(t * (t - 1) * (t - 2) for t in c) for c in counts)
    var = (v0 - vx - vy) / 18 + x1 * y1 / (2 * n * (n - 1)) + (x2 * y2 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return tau, math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else math.nan


def kendall_tau(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """(by, n, tau): Kendall's tau-b of short series, by comparing the pairs of a group (curves of some points)."""
    a = df.select(*by, F.col(order).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = df.select(*by, F.col(order).alias("_j"), F.col(x).alias("_u"), F.col(y).alias("_v"))
    s = F.signum(F.col("_u") - F.col("_x")), F.signum(F.col("_v") - F.col("_y"))
    pairs = a.join(b, by).where("_i < _j").groupBy(*by).agg(F.sum(s[0] * s[1]).alias("_s"), F.sum(F.abs(s[0])).alias("_a"), F.sum(F.abs(s[1])).alias("_b"))
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.join(pairs, by, "left").select(*by, "n", F.try_divide("_s", F.sqrt(F.col("_a") * F.col("_b"))).alias("tau"))


@lru_cache(maxsize=64)
def _rank_sums(m: int, n: int) -> tuple[int, ...]:
    """Ways to get each U from m and n values without ties."""
    table = [[[1]] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        row = [[1]]
        for j in range(1, n + 1):
            a, b = table[i - 1][j], row[j - 1]  # the largest value is from the first sample (it passes all j) or the second
            out = [0] * (i * j + 1)
            for u, c in enumerate(a):
                out[u + j] += c
            for u, c in enumerate(b):
                out[u] += c
            row.append(out)
        table[i] = row
    return tuple(table[m][n])


def mann_whitney_p(m: int, n: int, u: float, ties: float = 0.0) -> float:
    """Two-sided p of U: exact if a sample has at most 8 values and there are no ties, else normal with tie and continuity correction."""
    top = max(u, m * n - u)
    if min(m, n) <= 8 and not ties:
        ways = _rank_sums(m, n)
        return min(1.0, 2 * sum(ways[math.ceil(top) :]) / math.comb(m + n, m))
    total = m + n
    sd = math.sqrt(m * n / 12 * (total + 1 - ties / (total * (total - 1))))
    return min(1.0, math.erfc((top - m * n / 2 - 0.5) / sd / math.sqrt(2))) if sd else math.nan


def mann_whitney(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """(by, n1, n0, u, auc, ties) of ``group`` true against false, by average ranks: no pairs are formed."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    w = Window.partitionBy(*by).orderBy(value)
    same = F.count("*").over(Window.partitionBy(*by, value))
    rows = rows.withColumn("_t", same).withColumn("_rank", F.rank().over(w) + (same - 1) / 2)
    n1 = F.count(F.when(F.col(group), 1))
    u = F.sum(F.when(F.col(group), F.col("_rank"))) - n1 * (n1 + 1) / 2
    out = rows.groupBy(*by).agg(n1.alias("n1"), F.count(F.when(~F.col(group), 1)).alias("n0"), u.alias("u"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))
    return out.withColumn("auc", F.try_divide("u", F.col("n1") * F.col("n0")))


def forecast_metrics(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "pred") -> DataFrame:
    """(by, rmse, mae, nse, pbias, n_eval, n_origins) over the pairs that are both known; n_origins counts all rows."""
    known = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    a, p = F.when(known, F.col(actual)), F.when(known, F.col(predicted))
    spread, total = F.var_pop(a) * F.count(a), F.sum(a)
    steady = F.abs(total) >= 1e-6 * F.greatest(F.lit(1.0), F.sum(F.abs(a)))
    return df.groupBy(*by).agg(
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.avg(F.abs(p - a)).alias("mae"),
        (1 - F.try_divide(F.sum((a - p) * (a - p)), F.nullif(spread, F.lit(0.0)))).alias("nse"),
        F.when(steady, 100 * F.try_divide(F.sum(a - p), total)).alias("pbias"),
        F.count(a).alias("n_eval"),
        F.count("*").alias("n_origins"),
    )


def diebold_mariano(df: DataFrame, by: list[str], order: str, horizon: str, longest: int = 12, squared: bool = True) -> DataFrame:
    """(by, horizon, dm_stat, p_value, n) for aligned rows (actual, pred_1, pred_2): equal accuracy of two forecasts.

    The long-run variance has horizon - 1 Bartlett-weighted covariances, each from its own overlapping parts; under 10
    common origins there is no test.
    """
    e1, e2 = F.col("actual") - F.col("pred_1"), F.col("actual") - F.col("pred_2")
    rows = df.withColumn("_d", e1 * e1 - e2 * e2 if squared else F.abs(e1) - F.abs(e2)).where(F.col("_d").isNotNull())
    w = Window.partitionBy(*by, horizon).orderBy(order)
    rows = rows.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, longest)})
    n, h = F.count("*"), F.col(horizon)
    out = rows.groupBy(*by, horizon).agg(n.alias("n"), F.avg("_d").alias("_mean"), F.var_pop("_d").alias("_var"), *(F.covar_pop("_d", f"_d{k}").alias(f"_c{k}") for k in range(1, longest)))
    var = F.col("_var")
    for k in range(1, longest):
        var = var + F.when((k < h) & (F.col("n") - k >= 2), 2 * (1 - k / h) * F.col(f"_c{k}")).otherwise(0.0)
    stat = F.when(F.col("n") >= 10, F.col("_mean") / F.sqrt(F.greatest(var, F.lit(1e-12)) / F.col("n")))
    out = out.withColumn("dm_stat", stat).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("dm_stat"))))
    return out.select(*by, horizon, "dm_stat", "p_value", "n")


def pearson_by_lag(df: DataFrame, by: list[str], pos: str, drivers: list[str], level: str, lags: list[int], least: int = 20) -> DataFrame:
    """(by, variable, lag, r): the lag of the largest absolute correlation with the level, the shortest on ties."""
    w = Window.partitionBy(*by).orderBy(pos)
    shifted = df.select(*by, level, *(F.lag(d, k).over(w).alias(f"{d}__{k}") for d in drivers for k in lags))
    both = lambda c: F.count(F.when(F.col(level).isNotNull() & F.col(c).isNotNull(), 1))
    wide = shifted.groupBy(*by).agg(*(f.alias(f"{k}_{d}__{lag}") for d in drivers for lag in lags for k, f in (("r", correlation(f"{d}__{lag}", level)), ("n", both(f"{d}__{lag}")))))
    rows = F.array(*(F.struct(F.lit(d).alias("variable"), F.lit(k).alias("lag"), F.col(f"r_{d}__{k}").alias("r"), F.col(f"n_{d}__{k}").alias("n")) for d in drivers for k in lags))
    long = wide.select(*by, F.explode(rows).alias("x")).select(*by, "x.*").where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    rank = F.row_number().over(Window.partitionBy(*by, "variable").orderBy(F.desc(F.abs("r")), "lag"))
    return long.withColumn("_k", rank).where("_k = 1").select(*by, "variable", "lag", "r")


def kendall_test(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """(by, n, tau, p) of short series: tau-b and its exact two-sided p (normal with ties)."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema) + ", n long, tau double, p double"

    def run(frame):
        import pandas as pd

        rows = frame.dropna(subset=[x, y]).sort_values(order)
        tau, p = kendall(rows[x].tolist(), rows[y].tolist())
        return pd.DataFrame([{**{b: frame[b].iloc[0] for b in by}, "n": len(rows), "tau": tau, "p": p}])

    return df.select(*by, order, x, y).groupBy(*by).applyInPandas(run, shape)


def mann_whitney_test(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """``mann_whitney`` with its two-sided p: only the sums of a comparison reach Python."""
    sums = mann_whitney(df, by, value, group)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema) + ", p double"

    def run(frames):
        for frame in frames:
            yield frame.assign(p=[mann_whitney_p(int(m), int(n), float(u), float(t)) for m, n, u, t in zip(frame["n1"], frame["n0"], frame["u"], frame["ties"])])

    return sums.mapInPandas(run, shape)
