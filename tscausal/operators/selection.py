"""From a causal graph to lagged predictors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def usable(edges: DataFrame) -> DataFrame:
    """Edges with evidence, a lag, and a lag of at least 0."""
    return edges.where(F.col("causal_evidence") & F.col("obs_lag").isNotNull() & (F.col("obs_lag") >= 0))


def direct_lags(edges: DataFrame, by: list[str], target: str, forecast: DataFrame) -> DataFrame:
    """(by, variable, causal_lag, lag) of edges into the target; a lag below 1 is chosen anew among the forecast lags.

    ``forecast``: (by, variable, lag) of the largest skill among lags of 1 and more; where it has none the edge goes.
    """
    into = usable(edges).where(F.col("effect") == target).select(*by, F.col("cause").alias("variable"), F.col("obs_lag").alias("causal_lag"))
    rows = into.join(forecast.select(*by, "variable", F.col("lag").alias("_f")), [*by, "variable"], "left")
    return rows.withColumn("lag", F.when(F.col("causal_lag") >= 1, F.col("causal_lag")).otherwise(F.col("_f"))).where(F.col("lag").isNotNull()).drop("_f")


def ancestor_lags(edges: DataFrame, by: list[str], target: str, forecast: DataFrame, positive: DataFrame, known: DataFrame) -> DataFrame:
    """(by, variable, causal_lag, lag) of all ancestors of the target that are in ``known`` (by, variable).

    A direct edge keeps a lag of 1 or more and has a lag of 0 chosen anew (``forecast``); an indirect ancestor takes the
    best positive lag of its full scan (``positive``). Both are (by, variable, lag).
    """
    edges = usable(edges)
    found = graph.ancestors(edges, by, target).join(known.select(*by, "variable").distinct(), [*by, "variable"], "left_semi")
    keys = [*by, "variable"]
    direct = edges.where(F.col("effect") == target).select(*by, F.col("cause").alias("variable"), F.col("obs_lag").alias("causal_lag"))
    rows = found.join(direct, keys, "left").join(forecast.select(*keys, F.col("lag").alias("_f")), keys, "left").join(positive.select(*keys, F.col("lag").alias("_p")), keys, "left")
    lag = F.when(F.col("causal_lag") >= 1, F.col("causal_lag")).when(F.col("causal_lag").isNotNull(), F.col("_f")).otherwise(F.col("_p"))
    return rows.withColumn("lag", lag).where(F.col("lag").isNotNull()).drop("_f", "_p")


def neighbour_lags(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """(entity, neighbour, causal_lag, lag) from edges between entities (cause, effect), with lags below 1 chosen anew."""
    rows = usable(edges).select(F.col("effect").alias("entity"), F.col("cause").alias("neighbour"), F.col("obs_lag").alias("causal_lag"))
    rows = rows.join(forecast.select("entity", "neighbour", F.col("lag").alias("_f")), ["entity", "neighbour"], "left")
    return rows.withColumn("lag", F.when(F.col("causal_lag") >= 1, F.col("causal_lag")).otherwise(F.col("_f"))).where(F.col("lag").isNotNull()).drop("_f")


def lag_report(selected: DataFrame, by: list[str], name: str = "variable") -> DataFrame:
    """One row per set: names, and JSON maps of the causal and the chosen lags, keys in order."""
    as_json = lambda lag: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, lag)))))
    return selected.groupBy(*by).agg(F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("selected_vars"), as_json("causal_lag").alias("old_lags"), as_json("lag").alias("new_lags"))


def information(y: np.ndarray, x: np.ndarray, bic: bool = False) -> float:
    """AIC (or BIC) of least squares with a constant."""
    n = len(y)
    design = np.column_stack([np.ones(n), x])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    k = design.shape[1]
    return n * (math.log(2 * math.pi * max(float(rest @ rest), 1e-300) / n) + 1) + (math.log(n) if bic else 2) * k


def stepwise(y: np.ndarray, x: dict[str, np.ndarray], bic: bool = False) -> list[str]:
    """Forward choice by strict improvement; the order of ``x`` breaks ties. Rows with any null are left out at once."""
    names = list(x)
    if not names:
        return []
    table = np.column_stack([y, *(x[n] for n in names)])
    table = table[~np.isnan(table).any(axis=1)]
    if len(table) < 20:
        return []
    y, columns = table[:, 0], {n: table[:, i + 1] for i, n in enumerate(names)}
    chosen, best = [], information(y, np.empty((len(y), 0)), bic)
    while True:
        scores = [(information(y, np.column_stack([columns[c] for c in [*chosen, n]]), bic), i, n) for i, n in enumerate(names) if n not in chosen]
        if not scores or min(scores)[0] >= best:
            return chosen
        best, _, name = min(scores)
        chosen.append(name)


def stepwise_lags(panel: DataFrame, by: list[str], pos: str, level: str, lags: DataFrame, bic: bool = False) -> DataFrame:
    """(by, variable, lag): forward choice among the lagged drivers of ``lags`` (by, variable, lag), training rows only."""
    spec = lags.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "lag")))).alias("_lags"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*by).schema) + ", variable string, lag int"

    def run(frame):
        frame = frame.sort_values(pos).reset_index(drop=True)
        wanted = dict(sorted(dict(frame["_lags"].iloc[0]).items()))
        found = stepwise(frame[level].to_numpy(dtype=float), {v: frame[v].astype(float).shift(int(k)).to_numpy() for v, k in wanted.items()}, bic)
        return pd.DataFrame([{**{b: frame[b].iloc[0] for b in by}, "variable": v, "lag": int(wanted[v])} for v in found], columns=[*by, "variable", "lag"])

    return panel.join(spec, by).groupBy(*by).applyInPandas(run, shape)


def inflation(x: np.ndarray) -> np.ndarray:
    """Variance inflation of each column, regressed on the others without a constant."""
    x = x[~np.isnan(x).any(axis=1)]
    if x.shape[1] < 2 or len(x) <= x.shape[1]:
        return np.full(x.shape[1], np.nan)
    out = []
    for i in range(x.shape[1]):
        others = np.delete(x, i, axis=1)
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - float(rest @ rest) / float(x[:, i] @ x[:, i])
        out.append(1 / (1 - r2) if r2 < 1 else np.inf)
    return np.array(out)


def variance_inflation(panel: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, variable, vif)."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*by).schema) + ", variable string, vif double"

    def run(frame):
        values = inflation(frame[columns].to_numpy(dtype=float))
        return pd.DataFrame({**{b: [frame[b].iloc[0]] * len(columns) for b in by}, "variable": columns, "vif": values})

    return panel.select(*by, *columns).groupBy(*by).applyInPandas(run, shape)
