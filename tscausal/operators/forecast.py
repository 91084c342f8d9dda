"""Forecast configurations of an entity, single split and rolling origins.

Features and error metrics are relational; what feeds on its own predictions runs as one grouped function per
(entity, method). A method that fails gives one row with its error instead of a failed job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from . import sarima
from .stats import benjamini_hochberg, diebold_mariano
from .trees import BoostedTrees

SINGLE = 0  # the horizon that stands for the single split
FORECAST = "method string, status string, horizon int, t0 long, actual double, pred double, lower double, upper double, orders string"

# The fourteen pairs of methods whose accuracy is compared.
COMPARISONS = (
    ("Trees_causal_ancestors", "Trees_causal_direct"),
    ("SARIMAX_causal_ancestors", "SARIMAX_causal_direct"),
    ("Trees_causal_neighbours", "Trees_causal_ancestors"),
    ("SARIMAX_causal_neighbours", "SARIMAX_causal_ancestors"),
    ("Trees_causal_ancestors", "Trees_stepwise"),
    ("SARIMAX_causal_ancestors", "SARIMAX_stepwise"),
    ("Trees_causal_ancestors", "Trees_level_only"),
    ("Trees_causal_ancestors", "Persistence"),
    ("Trees_causal_ancestors", "Trees_all"),
    ("Trees_causal_direct", "Trees_level_only"),
    ("SARIMAX_causal_ancestors", "SARIMA"),
    ("SARIMAX_causal_ancestors", "Persistence"),
    ("Trees_causal_ancestors", "SARIMAX_causal_ancestors"),
    ("Trees_all", "SARIMAX_all"),
)


def rolling_persistence(panel: DataFrame, by: list[str], pos: str, level: str, params: Params = DEFAULT) -> DataFrame:
    """(by, horizon, t0, actual, pred): the value at each origin stands for all horizons; null origins are skipped."""
    n = F.count("*").over(Window.partitionBy(*by))
    rows = panel.select(*by, F.col(pos).alias("t0"), F.col(level).alias("pred"), n.alias("_n"))
    origins = rows.where((F.col("t0") >= F.col("_n") - params.horizon - 1) & (F.col("t0") <= F.col("_n") - 2) & F.col("pred").isNotNull())
    origins = origins.withColumn("horizon", F.explode(F.array(*map(F.lit, params.horizons)))).where(F.col("t0") + F.col("horizon") <= F.col("_n") - 1)
    later = panel.select(*by, F.col(pos).alias("_t"), F.col(level).alias("actual"))
    return origins.withColumn("_t", F.col("t0") + F.col("horizon")).join(later, [*by, "_t"], "left").select(*by, "horizon", "t0", "actual", "pred")


def single_persistence(panel: DataFrame, by: list[str], pos: str, level: str, params: Params = DEFAULT) -> DataFrame:
    """(by, t0, actual, pred): the last training value over the whole test part, null if it is null."""
    n = F.count("*").over(Window.partitionBy(*by))
    rows = panel.select(*by, F.col(pos).alias("t0"), F.col(level).alias("actual"), n.alias("_n"))
    last = rows.where(F.col("t0") == F.col("_n") - params.horizon - 1).select(*by, F.col("actual").alias("pred"))
    return rows.where(F.col("t0") >= F.col("_n") - params.horizon).join(last, by).select(*by, "t0", "actual", "pred")


def method_matrix(entities: DataFrame, by: list[str], sets: dict[str, DataFrame]) -> DataFrame:
    """(by, method, family, lags): three baselines, and SARIMAX and trees for each set (by, variable, lag) that is not empty."""
    none = F.create_map().cast("map<string,int>")
    base = entities.select(*by).distinct()
    out = None
    for method, family in (("SARIMA", "sarima"), ("Persistence", "persistence"), ("Trees_level_only", "trees")):
        rows = base.select(*by, F.lit(method).alias("method"), F.lit(family).alias("family"), none.alias("lags"))
        out = rows if out is None else out.unionByName(rows)
    for name, lags in sets.items():
        maps = lags.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", F.col("lag").cast("int").alias("lag"))))).alias("lags"))
        for prefix, family in (("SARIMAX_", "sarima"), ("Trees_", "trees")):
            out = out.unionByName(maps.select(*by, F.lit(prefix + name).alias("method"), F.lit(family).alias("family"), "lags"))
    return out


def foresight(methods: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds min_lag, the months that need no future drivers, and their share of the test part."""
    least = F.array_min(F.map_values("lags"))
    free = F.coalesce(F.least(least, F.lit(params.horizon)), F.lit(params.horizon))
    return methods.withColumn("min_lag", least).withColumn("n_free", free).withColumn("share_free", free / params.horizon)


def bounded_fill(x: np.ndarray, limit: int) -> np.ndarray:
    """Whole runs of at most ``limit`` missing values: linear between neighbours, constant at an edge."""
    x, gone = x.copy(), np.isnan(x)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a <= limit and b - a < len(x):
            left, right = x[a - 1] if a else np.nan, x[b] if b < len(x) else np.nan
            x[a:b] = np.linspace(left, right, b - a + 2)[1:-1] if not (np.isnan(left) or np.isnan(right)) else right if np.isnan(left) else left
    return x


def carried(x: np.ndarray, limit: int) -> np.ndarray:
    return pd.Series(x).ffill(limit=limit).to_numpy()


def level_row(get, t: int, lags: tuple[int, ...]) -> list[float]:
    """The level features of step ``t``; ``get(i)`` is the level at i, NaN if unknown."""
    v = {k: get(t - k) for k in {*lags, 1, 2, 3, 4, 5, 6}}
    last3 = np.array([v[1], v[2], v[3]])
    last6 = np.array([v[k] for k in range(1, 7)])
    return [v[k] for k in lags] + [v[1] - v[2], v[1] - v[4], float(last3.mean()), float(last6.mean()), float(last3.std(ddof=1))]


def level_table(x: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    return np.array([level_row(lambda i: x[i] if i >= 0 else np.nan, t, lags) for t in range(len(x))])


def driver_table(drivers: dict[str, np.ndarray], lags: dict[str, int], windows: tuple[int, ...]) -> np.ndarray:
    columns = []
    for name, lag in lags.items():
        s = pd.Series(drivers[name])
        columns += [s.shift(lag), *(s.rolling(w).mean().shift(lag) for w in windows)]
    return np.column_stack(columns) if columns else np.empty((len(next(iter(drivers.values()))) if drivers else 0, 0))


def run_trees(y: np.ndarray, drivers: dict[str, np.ndarray], lags: dict[str, int], shape: tuple[int, float, int], params: Params) -> list[tuple]:
    """Rows (horizon, t0, actual, pred) of a direct-recursive forecast and of all rolling origins."""
    n, end = len(y), len(y) - params.horizon
    exog = driver_table(drivers, lags, params.exog_windows) if lags else np.empty((n, 0))
    table = np.column_stack([y, level_table(y, params.level_lags), exog])[:end]
    table = np.column_stack([bounded_fill(c, params.max_gap) for c in table.T])
    table = table[~np.isnan(table).any(axis=1)]
    model = BoostedTrees(*shape).fit(table[:, 1:], table[:, 0])
    exog = np.column_stack([carried(c, params.max_gap) for c in exog.T]) if exog.shape[1] else exog
    known, out = y.copy(), []
    known[:end] = bounded_fill(y[:end], params.max_gap)
    known[end:] = np.nan  # test values are never looked at
    for t in range(end, n):
        row = np.array([*level_row(lambda i: known[i] if i >= 0 else np.nan, t, params.level_lags), *exog[t]])
        if not np.isnan(row).any():
            known[t] = model.row(row)
        out.append((SINGLE, t, y[t], known[t]))
    for t0 in range(end - 1, n - 1):
        seen, walked = bounded_fill(y[: t0 + 1], params.max_gap), {}
        get = lambda i: walked.get(i, np.nan) if i > t0 else seen[i] if i >= 0 else np.nan  # noqa: B023, E731
        for step in range(1, min(max(params.horizons), n - 1 - t0) + 1):
            row = np.array([*level_row(get, t0 + step, params.level_lags), *exog[t0 + step]])
            if np.isnan(row).any():
                break  # horizons that were reached stay
            walked[t0 + step] = model.row(row)
            if step in params.horizons:
                out.append((step, t0, y[t0 + step], walked[t0 + step]))
    return out


def run_sarima(y: np.ndarray, drivers: dict[str, np.ndarray], lags: dict[str, int], params: Params) -> tuple[list[tuple], sarima.Fit]:
    """Rows (horizon, t0, actual, pred, lower, upper), and the fit. The order is searched once; origins only update."""
    n, end = len(y), len(y) - params.horizon
    x = np.column_stack([pd.Series(drivers[v]).shift(k) for v, k in lags.items()]) if lags else np.empty((n, 0))
    table = np.column_stack([bounded_fill(c[:end], params.max_gap) for c in np.column_stack([y, x]).T])
    table = table[~np.isnan(table).any(axis=1)]
    ahead = np.column_stack([carried(c, params.max_gap) for c in x.T]) if lags else x
    if np.isnan(ahead[end:]).any():
        raise ValueError(f"a driver is missing for more than {params.max_gap} steps of the test part")
    part = lambda a, b: ahead[a:b] if lags else None
    model = sarima.auto(table[:, 0], table[:, 1:] if lags else None, params.season)
    mean, error = model.predict(params.horizon, part(end, n))
    out = [(SINGLE, end + i, y[end + i], m, m - 1.959963984540054 * s, m + 1.959963984540054 * s) for i, (m, s) in enumerate(zip(mean, error))]
    state = end - 1
    for t0 in range(end - 1, n - 1):
        if t0 > state:
            if lags and np.isnan(part(state + 1, t0 + 1)).any():
                continue  # the state stays, so a gap holds up all later origins
            try:
                model.append(y[state + 1 : t0 + 1], part(state + 1, t0 + 1))
            except ValueError:
                break
            state = t0
        steps = min(max(params.horizons), n - 1 - t0)
        if lags and np.isnan(part(t0 + 1, t0 + 1 + steps)).any():
            continue
        mean, _ = model.predict(steps, part(t0 + 1, t0 + 1 + steps))
        out += [(h, t0, y[t0 + h], mean[h - 1], np.nan, np.nan) for h in params.horizons if h <= steps]
    return out, model


def run_methods(panel: DataFrame, methods: DataFrame, by: list[str], pos: str, level: str, drivers: list[str], shape: tuple[int, float, int] = (3, 0.05, 200), params: Params = DEFAULT) -> DataFrame:
    """(by, method, status, horizon, t0, actual, pred, …) of every (entity, method); horizon 0 is the single split."""
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*by).schema) + ", " + FORECAST
    names = [x.split()[0] for x in spec.split(", ")]

    def run(frame):
        frame = frame.sort_values(pos)
        head = frame.iloc[0]
        lags = {str(k): int(v) for k, v in sorted(dict(head["lags"]).items())}
        y = frame[level].to_numpy(dtype=float)
        series = {v: frame[v].to_numpy(dtype=float) for v in lags}
        status, orders = "ok", None
        try:
            if head["family"] == "trees":
                rows = run_trees(y, series, lags, shape, params)
            else:
                rows, model = run_sarima(y, series, lags, params)
                orders = f"{model.order}{model.seasonal}"
        except Exception as e:  # one method's failure is a result
            status, rows = f"error: {type(e).__name__}: {e}", [(SINGLE, None, None, None)]
        out = pd.DataFrame([(*r, *(None,) * (6 - len(r))) for r in rows], columns=["horizon", "t0", "actual", "pred", "lower", "upper"])
        out = out.assign(method=head["method"], status=status, orders=orders, **{b: head[b] for b in by})
        out["t0"] = out["t0"].astype("Int64")
        for c in ("actual", "pred", "lower", "upper"):
            out[c] = pd.to_numeric(out[c]).astype("Float64").where(lambda v: v.notna() & np.isfinite(v.astype(float).fillna(np.nan)), None)
        return out[names]

    fitted = panel.select(*by, pos, level, *drivers).join(methods.where("family <> 'persistence'"), by).groupBy(*by, "method").applyInPandas(run, spec)
    blank = {"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double"), "orders": F.lit(None).cast("string"), "method": F.lit("Persistence"), "status": F.lit("ok")}
    single = single_persistence(panel, by, pos, level, params).withColumn("horizon", F.lit(SINGLE)).withColumns(blank)
    rolling = rolling_persistence(panel, by, pos, level, params).withColumns(blank)
    naive = single.select(*names).unionByName(rolling.select(*names))
    return fitted.unionByName(naive.join(methods.where("family = 'persistence'").select(*by, "method"), [*by, "method"], "left_semi"))


def tune_trees(panel: DataFrame, by: list[str], pos: str, level: str, params: Params = DEFAULT) -> DataFrame:
    """(grid, rmse, folds) over the grid: mean error of level-only trees over entities and expanding folds."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*by).schema) + ", grid int, fold int, rmse double"

    def run(frame):
        frame = frame.sort_values(pos)
        y = frame[level].to_numpy(dtype=float)[: -params.horizon]
        table = np.column_stack([y, level_table(y, params.level_lags)]) if len(y) else np.empty((0, 1))
        table = table[~np.isnan(table).any(axis=1)]
        g, n, out = int(frame["grid"].iloc[0]), len(table), []
        size = (n - n // 2) // 4
        for fold in range(3):
            a = n // 2 + fold * size
            if n >= 60 and size >= 5 and a >= 30:
                model = BoostedTrees(*params.tree_grid[g]).fit(table[:a, 1:], table[:a, 0])
                error = model.predict(table[a : a + size, 1:]) - table[a : a + size, 0]
                out.append({**{b: frame[b].iloc[0] for b in by}, "grid": g, "fold": fold, "rmse": float(np.sqrt((error**2).mean()))})
        return pd.DataFrame(out, columns=[*by, "grid", "fold", "rmse"])

    grid = panel.select(*by, pos, level).withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(len(params.tree_grid) - 1))))
    return grid.groupBy(*by, "grid").applyInPandas(run, shape).groupBy("grid").agg(F.avg("rmse").alias("rmse"), F.count("*").alias("folds"))


def chosen_shape(scores: DataFrame, params: Params = DEFAULT) -> tuple[int, float, int]:
    """The grid point of the least mean error; (3, 0.05, 200) without any score."""
    best = scores.where("rmse IS NOT NULL").orderBy("rmse", "grid").first()
    return params.tree_grid[best["grid"]] if best else (3, 0.05, 200)


def aligned(results: DataFrame, by: list[str], pairs: DataFrame, least: int = 10) -> DataFrame:
    """(by, method_1, method_2, horizon, t0, actual, pred_1, pred_2) on common origins, at least ``least`` of them."""
    rows = results.where("status = 'ok'").where(F.col("horizon") > SINGLE) if "status" in results.columns else results
    one = rows.select(*by, F.col("method").alias("method_1"), "horizon", "t0", "actual", F.col("pred").alias("pred_1")).join(F.broadcast(pairs), "method_1")
    two = rows.select(*by, F.col("method").alias("method_2"), "horizon", "t0", F.col("pred").alias("pred_2"))
    both = one.join(two, [*by, "method_2", "horizon", "t0"])
    count = F.count("*").over(Window.partitionBy(*by, "method_1", "method_2", "horizon"))
    return both.withColumn("_n", count).where(F.col("_n") >= least).select(*by, "method_1", "method_2", "horizon", "t0", "actual", "pred_1", "pred_2")


def accuracy_battery(results: DataFrame, by: list[str], comparisons=COMPARISONS) -> DataFrame:
    """Equal-accuracy tests of all comparisons and horizons, adjusted as one family."""
    pairs = results.sparkSession.createDataFrame(list(comparisons), "method_1 string, method_2 string")
    tests = diebold_mariano(aligned(results, by, pairs), [*by, "method_1", "method_2"], "t0", "horizon")
    return benjamini_hochberg(tests, "p_value")
