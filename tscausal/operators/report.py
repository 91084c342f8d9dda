"""Result tables, each one query over edges or forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pair_key


def pair_strength(edges: DataFrame) -> DataFrame:
    """(a, b, strength, detected) of unordered pairs: mean absolute skill of both directions; detected if any direction has evidence."""
    return edges.groupBy(F.least("cause", "effect").alias("a"), F.greatest("cause", "effect").alias("b")).agg(
        F.avg(F.abs("obs_rho")).alias("strength"),
        F.bool_or(F.coalesce(F.col("statistically_significant") & F.col("convergence_diagnostic_pass") & (F.col("obs_lag") >= 0), F.lit(False))).alias("detected"),
    )


def connected_contrast(edges: DataFrame, by_pair: bool) -> DataFrame:
    """(unit, value, connected, significant): what a contrast of connected with other edges, or pairs, compares."""
    if not by_pair:
        return edges.select(F.lit("edges").alias("unit"), F.abs("obs_rho").alias("value"), F.col("connected"), F.col("causal_evidence").alias("significant"))
    rows = edges.groupBy(pair_key("cause", "effect").alias("k")).agg(F.avg(F.abs("obs_rho")).alias("value"), F.bool_or("connected").alias("connected"), F.bool_or("causal_evidence").alias("significant"))
    return rows.select(F.lit("pairs").alias("unit"), "value", "connected", "significant")


def contrast_summary(rows: DataFrame) -> DataFrame:
    """(unit, n, medians and shares of significance of both groups)."""
    mid = lambda on: F.percentile(F.when(F.col("connected") == on, F.col("value")), F.lit(0.5))
    share = lambda on: F.avg(F.when(F.col("connected") == on, F.col("significant").cast("double")))
    return rows.groupBy("unit").agg(
        F.count(F.when(F.col("connected"), 1)).alias("n_connected"), F.count(F.when(~F.col("connected"), 1)).alias("n_unconnected"),
        mid(True).alias("median_connected"), mid(False).alias("median_unconnected"), share(True).alias("share_connected"), share(False).alias("share_unconnected"),
    )


def winner(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the better method of a significant comparison, '' otherwise."""
    better = F.when(F.col("dm_stat") < 0, F.col("method_1")).otherwise(F.col("method_2"))
    return tests.withColumn("winner", F.when(F.coalesce(F.col("p_fdr") < alpha, F.lit(False)), better).otherwise(""))


def accuracy_summary(tests: DataFrame, entity: str, alpha: float = 0.05, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Per pair of methods: entities, tests, significant ones, those that favour either side, and significant by horizon."""
    sure = F.coalesce(F.col("p_fdr") < alpha, F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return tests.where("p_value IS NOT NULL").groupBy("method_1", "method_2").agg(
        F.count_distinct(entity).alias("entities"), F.count("*").alias("tests"), count(sure).alias("significant"),
        count(sure & (F.col("dm_stat") < 0)).alias("favours_1"), count(sure & (F.col("dm_stat") >= 0)).alias("favours_2"),
        *(count(sure & (F.col("horizon") == h)).alias(f"significant_h{h}") for h in horizons),
    )


def rmse_summary(metrics: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Per method the mean error and the number of entities at each horizon, of entities with origins."""
    rows = metrics.where("n_origins > 0")
    return rows.groupBy("method").agg(*(f for h in horizons for f in (F.avg(F.when(F.col("horizon") == h, F.col("rmse"))).alias(f"rmse_h{h}"), F.count(F.when(F.col("horizon") == h, F.col("rmse"))).alias(f"n_h{h}"))))


def complete_entities(metrics: DataFrame, entity: str, methods: list[str], horizons: list[int]) -> DataFrame:
    """Entities with a valid error in every cell of methods and horizons (relational division)."""
    valid = metrics.where(F.col("method").isin(methods) & F.col("horizon").isin(horizons) & F.col("rmse").isNotNull() & (F.col("n_origins") > 0))
    cells = valid.select(entity, "method", "horizon").distinct().groupBy(entity).agg(F.count("*").alias("_n"))
    return cells.where(F.col("_n") == len(methods) * len(horizons)).select(entity)


def matched_rmse(metrics: DataFrame, entity: str, methods: list[str], horizons: list[int]) -> DataFrame:
    """(method, horizon, rmse, n) over the entities for which all of ``methods`` are valid."""
    rows = metrics.where(F.col("method").isin(methods) & F.col("horizon").isin(horizons)).join(complete_entities(metrics, entity, methods, horizons), entity, "left_semi")
    return rows.groupBy("method", "horizon").agg(F.avg("rmse").alias("rmse"), F.count("*").alias("n"))


def relative_rmse(metrics: DataFrame, entity: str, baseline: str = "Persistence") -> DataFrame:
    """(entity, method, horizon, ratio) to the baseline's error."""
    base = metrics.where(F.col("method") == baseline).select(entity, "horizon", F.col("rmse").alias("_b"))
    return metrics.where(F.col("method") != baseline).join(base, [entity, "horizon"]).select(entity, "method", "horizon", F.try_divide("rmse", "_b").alias("ratio"))


def better_than_baseline(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("method", "horizon").agg(F.count(F.when(F.col("ratio") < 1, 1)).alias("n_better"), F.count("ratio").alias("n"))


def configuration_matrix(results: DataFrame, entity: str, methods: list[str], digits: int = 4) -> DataFrame:
    """Entities by methods: the error as text, 'n/a' where there is none."""
    text = F.when(F.col("rmse").isNotNull(), F.format_string(f"%.{digits}f", "rmse"))
    wide = results.withColumn("_t", text).groupBy(entity).pivot("method", methods).agg(F.first("_t"))
    return wide.na.fill("n/a", methods)


def supported_drivers(edges: DataFrame, target: str) -> DataFrame:
    """Significant edges into the target, strongest first within an entity."""
    order = Window.partitionBy("entity").orderBy(F.round("obs_rho", 9).desc(), "cause")  # equal but for the last digits: by name
    rows = edges.where(F.col("statistically_significant") & (F.col("effect") == target))
    return rows.select("entity", F.row_number().over(order).alias("place"), "cause", "obs_lag", "obs_rho", "p_fdr", "lag_resolution")


def driver_matrix(edges: DataFrame, target: str, drivers: list[str]) -> DataFrame:
    """Entities by drivers: the skill of significant edges into the target."""
    rows = edges.where(F.col("statistically_significant") & (F.col("effect") == target))
    return rows.groupBy("entity").pivot("cause", drivers).agg(F.first("obs_rho"))


def lag_classes(edges: DataFrame) -> DataFrame:
    """(lag_class, edges) of significant edges: positive, zero, negative."""
    d = F.col("obs_lag")
    return edges.where("statistically_significant").groupBy(F.when(d > 0, "positive").when(d == 0, "zero").otherwise("negative").alias("lag_class")).agg(F.count("*").alias("edges"))


def support_counts(edges: DataFrame) -> DataFrame:
    """(cause, effect, entities, supported): in how many entities an edge is significant."""
    return edges.groupBy("cause", "effect").agg(F.count_distinct("entity").alias("entities"), F.count(F.when(F.col("statistically_significant"), 1)).alias("supported"))


def tier_boxes(pairs: DataFrame) -> DataFrame:
    """(tier, n, quartiles and ends of strength)."""
    q = lambda p: F.percentile("strength", F.lit(p))
    return pairs.groupBy("tier").agg(F.count("*").alias("n"), F.min("strength").alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("strength").alias("high"))


def availability(panel: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, n_missing, std, iqr, span) of a series; spread of the centred values, sample deviation and linear quantiles."""
    x = F.col(value) - F.avg(value).over(Window.partitionBy(*by))
    q = lambda p: F.percentile("_x", F.lit(p))
    return panel.withColumn("_x", x).groupBy(*by).agg(F.count("_x").alias("n"), F.count(F.when(F.col("_x").isNull(), 1)).alias("n_missing"), F.stddev_samp("_x").alias("std"), (q(0.75) - q(0.25)).alias("iqr"), (F.max("_x") - F.min("_x")).alias("span"))


def embedding_matrix(sizes: DataFrame, variables: list[str]) -> DataFrame:
    return sizes.groupBy("entity").pivot("variable", variables).agg(F.first("size"))


def embedding_changes(sizes: DataFrame) -> DataFrame:
    """How many dimensions and delays differ from earlier ones."""
    changed = lambda a, b: F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1))
    return sizes.agg(F.count("*").alias("series"), changed("size", "old_size").alias("size_changed"), changed("tau", "old_tau").alias("tau_changed"))


def edges_with_embedding(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges with the dimension and delay of their effect."""
    return edges.join(sizes.select("entity", F.col("variable").alias("effect"), "size", "tau"), ["entity", "effect"], "left")


def dataset_layers(raw: DataFrame, anomaly: DataFrame) -> DataFrame:
    """Raw and deseasonalised rows (entity, month, variable, value) as one long table with the layer's name."""
    return raw.withColumn("layer", F.lit("raw")).unionByName(anomaly.withColumn("layer", F.lit("deseasonalised")))


def completeness(rows: DataFrame) -> DataFrame:
    """(layer, variable, percent) of values that are present."""
    return rows.groupBy("layer", "variable").agg((100 * F.avg(F.col("value").isNotNull().cast("double"))).alias("percent"))


def centred(panel: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value less its mean over the entity."""
    return panel.withColumn("centred", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def labelled(df: DataFrame, column: str, labels: dict[str, str], name: str = "label") -> DataFrame:
    """Display labels, and their order as a sort key; values without a label keep their own and come last."""
    pairs = [F.lit(x) for k, v in labels.items() for x in (k, v)]
    ranks = [x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))]
    return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column))).withColumn(f"{name}_rank", F.coalesce(F.try_element_at(F.create_map(*ranks), F.col(column)), F.lit(len(labels))))


def markdown(df: DataFrame, digits: dict[str, int] | None = None, limit: int = 1000) -> str:
    """A small result as a Markdown table, with decimals per column; more than ``limit`` rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table for reading has at most {limit} rows")

    def cell(name, v):
        if v is None:
            return ""
        return f"{v:.{digits[name]}f}" if digits and name in digits else str(v)

    lines = [df.columns, ["---"] * len(df.columns), *([cell(c, r[c]) for c in df.columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
