"""Edge families, graphs, selection and reports on them.

The tables carry no causal signal. Here an edge's skill is its largest lagged correlation, and its p-value comes from
the digest of its name (small for strong edges), so that every rule after the test is exercised and can be checked.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation, fingerprint, haversine_km, name_tokens, pair_seed
from ..operators import graph, report, screening, selection, stats
from ..sources import grid
from ..sources import panels as P
from ..sources.files import durable, last_by, remaining
from . import corr, query, r6, rounded

E = ["entity"]
LAGS = list(range(-3, 4))
VARIABLES = P.HOURLY


def _with_p(rows, key):
    digest = F.md5(key)
    k = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    return rows.withColumns({
        "status": F.when(F.substring(digest, 9, 1) == "0", "insufficient_data").otherwise("OK"),
        "p_value": (F.when(F.col("obs_rho") > 0.15, k % 5).otherwise(k % 500) + 1) / 501.0,
        "convergence_diagnostic_pass": (F.substring(digest, 5, 1) < "e") & (F.col("obs_rho") > 0),
    })


def _p_sql(key: str) -> str:
    k = f"('0x' || substr(md5({key}), 1, 4))::BIGINT"
    return f"""CASE WHEN substr(md5({key}), 9, 1) = '0' THEN 'insufficient_data' ELSE 'OK' END AS status,
  (CASE WHEN obs_rho > 0.15 THEN {k} % 5 ELSE {k} % 500 END + 1) / 501.0::DOUBLE AS p_value, substr(md5({key}), 5, 1) < 'e' AND obs_rho > 0 AS convergence_diagnostic_pass"""


def _strongest(rows, keys):
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("obs_rho"), "obs_lag"))
    return rows.where(F.col("obs_rho").isNotNull()).withColumn("_k", order).where("_k = 1").drop("_k")


def within(spark, d):
    """(entity, cause, effect, obs_lag, obs_rho, obs_n, status, p_value, …) of the hourly variables."""
    long = P.hourly(spark, d).select("entity", "pos", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(v).alias("x")) for v in VARIABLES))).alias("s")).select("entity", "pos", "s.*")
    cause = long.select("entity", F.col("v").alias("cause"), "x", F.explode(F.array(*map(F.lit, LAGS))).alias("obs_lag"), "pos").withColumn("pos", F.col("pos") + F.col("obs_lag"))
    effect = long.select("entity", F.col("v").alias("effect"), F.col("x").alias("y"), "pos")
    rows = cause.join(effect, ["entity", "pos"]).where("cause <> effect").groupBy("entity", "cause", "effect", "obs_lag")
    rows = rows.agg(correlation("x", "y").alias("obs_rho"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("obs_n"))
    return _with_p(_strongest(rows, ["entity", "cause", "effect"]), F.concat_ws("|", "entity", "cause", "effect"))


WITHIN_SQL = P.HOURLY_SQL + f""", long AS (SELECT entity, pos, unnest({VARIABLES}) AS v, unnest([{', '.join(VARIABLES)}]) AS x FROM hourly),
within_lagged AS (
  SELECT a.entity, a.v AS cause, b.v AS effect, l.lag::INTEGER AS obs_lag, {corr("a.x", "b.x")} AS obs_rho, count(CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN 1 END) AS obs_n
  FROM long a CROSS JOIN (SELECT unnest({LAGS}) AS lag) l JOIN long b ON b.entity = a.entity AND b.pos = a.pos + l.lag AND b.v <> a.v GROUP BY ALL
), within_edges AS (
  SELECT *, {_p_sql("entity || '|' || cause || '|' || effect")}
  FROM (SELECT * FROM within_lagged WHERE obs_rho IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, cause, effect ORDER BY obs_rho DESC, obs_lag) = 1)
)"""


def _evidence_sql(table: str, keys: str) -> str:
    return f""",
valid AS (SELECT {keys}, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, {keys}) AS q, row_number() OVER (ORDER BY p_value, {keys}) AS r FROM {table} WHERE status = 'OK'),
adjusted AS (SELECT {keys}, least(1.0, min(q) OVER (ORDER BY r DESC)) AS p_fdr FROM valid),
significant AS (SELECT e.*, p_fdr, coalesce(p_fdr < 0.05 AND convergence_diagnostic_pass AND obs_lag IS NOT NULL, false) AS statistically_significant FROM {table} e LEFT JOIN adjusted USING ({keys})),
evidence AS (SELECT *, CASE WHEN NOT statistically_significant THEN 'not_significant' WHEN obs_lag > 0 THEN 'resolved' WHEN obs_lag = 0 THEN 'unresolved' ELSE 'rejected_reverse' END AS lag_resolution,
  statistically_significant AND obs_lag >= 0 AS causal_evidence FROM significant)"""


EVIDENCE_SQL = WITHIN_SQL + _evidence_sql("within_edges", "entity, cause, effect")


def evidence(spark, d):
    return stats.causal_evidence(within(spark, d))


def between(spark, d):
    """(cause, effect, obs_lag, obs_rho, …, connected) of nations' monthly levels; connected: neighbours in a region."""
    rows = P.monthly_positions(spark, d, "n_name").select("entity", "month", F.col("level").alias("x"))
    cause = rows.select(F.col("entity").alias("cause"), "x", F.explode(F.array(*map(F.lit, LAGS))).alias("obs_lag"), "month").withColumn("month", F.expr("add_months(month, obs_lag)"))
    effect = rows.select(F.col("entity").alias("effect"), F.col("x").alias("y"), "month")
    agg = cause.join(effect, "month").where("cause <> effect").groupBy("cause", "effect", "obs_lag").agg(correlation("x", "y").alias("obs_rho"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("obs_n"))
    edges = _with_p(_strongest(agg, ["cause", "effect"]), F.concat_ws("|", "cause", "effect"))
    key = F.concat_ws("|", F.least("cause", "effect"), F.greatest("cause", "effect"))
    joined = connected(spark, d).select(F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")).alias("k"), F.lit(True).alias("connected"))
    return edges.withColumn("k", key).join(joined, "k", "left").withColumn("connected", F.coalesce("connected", F.lit(False))).drop("k")


def connected(spark, d):
    """(a, b) of nations that follow each other by key within their region."""
    nations = spark.read.parquet(f"{d}/nation.parquet")
    after = F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return nations.select(F.col("n_name").alias("a"), after.alias("b")).where("b IS NOT NULL")


CONNECTED_SQL = "connected AS (SELECT * FROM (SELECT n_name AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL)"
BETWEEN_SQL = P.monthly_positions_sql("n_name") + f""", {CONNECTED_SQL}, between_lagged AS (
  SELECT a.entity AS cause, b.entity AS effect, l.lag::INTEGER AS obs_lag, {corr("a.level", "b.level")} AS obs_rho, count(CASE WHEN a.level IS NOT NULL AND b.level IS NOT NULL THEN 1 END) AS obs_n
  FROM panel a CROSS JOIN (SELECT unnest({LAGS}) AS lag) l JOIN panel b ON b.month = (a.month + to_months(l.lag::INTEGER))::DATE AND b.entity <> a.entity GROUP BY ALL
), between_edges AS (
  SELECT e.*, c.a IS NOT NULL AS connected FROM (
    SELECT *, {_p_sql("cause || '|' || effect")}
    FROM (SELECT * FROM between_lagged WHERE obs_rho IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cause, effect ORDER BY obs_rho DESC, obs_lag) = 1)
  ) e LEFT JOIN connected c ON (e.cause = c.a AND e.effect = c.b) OR (e.cause = c.b AND e.effect = c.a)
)"""
BETWEEN_EVIDENCE_SQL = BETWEEN_SQL + _evidence_sql("between_edges", "cause, effect")


def between_evidence(spark, d):
    return stats.causal_evidence(between(spark, d))


# --- the family ------------------------------------------------------------------------------------------------------


@query(f"WITH {WITHIN_SQL}{_evidence_sql('within_edges', 'entity, cause, effect')} SELECT entity, cause, effect, status, {r6('p_value')} AS p_value, {r6('p_fdr')} AS p_fdr FROM evidence")
def bh_fdr(spark, d):
    return evidence(spark, d).select("entity", "cause", "effect", "status", rounded("p_value").alias("p_value"), rounded("p_fdr").alias("p_fdr"))


@query(f"WITH {EVIDENCE_SQL} SELECT entity, cause, effect, obs_lag, {r6('obs_rho')} AS obs_rho, obs_n, convergence_diagnostic_pass, statistically_significant, lag_resolution, causal_evidence FROM evidence")
def causal_evidence(spark, d):
    rows = evidence(spark, d)
    return rows.select("entity", "cause", "effect", "obs_lag", rounded("obs_rho").alias("obs_rho"), "obs_n", "convergence_diagnostic_pass", "statistically_significant", "lag_resolution", "causal_evidence")


@query(f"WITH {EVIDENCE_SQL} SELECT CASE WHEN obs_lag > 0 THEN 'positive' WHEN obs_lag = 0 THEN 'zero' ELSE 'negative' END AS lag_class, count(*) AS edges FROM evidence WHERE statistically_significant GROUP BY ALL")
def lag_resolution(spark, d):
    return report.lag_classes(evidence(spark, d))


@query("WITH v AS (SELECT unnest(['level', 'p', 'r', 't', 'swe', 'evap']) AS v), n AS (SELECT DISTINCT event_type AS entity FROM events) SELECT entity, a.v AS cause, b.v AS effect, ('0x' || substr(md5(a.v || '|' || b.v), 1, 8))::BIGINT AS seed FROM n CROSS JOIN v a JOIN v b ON a.v <> b.v")
def edges_cross_product(spark, d):
    entities = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("entity")).distinct()
    names = F.array(*map(F.lit, VARIABLES))
    rows = entities.select("entity", F.explode(names).alias("cause")).withColumn("effect", F.explode(names)).where("cause <> effect")
    return rows.withColumn("seed", pair_seed("cause", "effect"))


@query(f"WITH {WITHIN_SQL} SELECT entity, cause, effect FROM within_edges WHERE NOT (status = 'OK' AND obs_lag > 0)")
def resume_anti_join(spark, d):
    edges = within(spark, d)
    return remaining(edges.select("entity", "cause", "effect"), edges.where("status = 'OK' AND obs_lag > 0"), ["entity", "cause", "effect"])


@query(f"WITH {WITHIN_SQL} SELECT count(*) AS expected, count(CASE WHEN status = 'OK' THEN 1 END) AS present, count(*) = count(CASE WHEN status = 'OK' THEN 1 END) AS complete FROM within_edges")
def completeness_gate(spark, d):
    n, ok = F.count("*"), F.count(F.when(F.col("status") == "OK", 1))
    return within(spark, d).agg(n.alias("expected"), ok.alias("present"), (n == ok).alias("complete"))


# --- rank tests ------------------------------------------------------------------------------------------------------


@query(f"""WITH {P.monthly_positions_sql('n_name')}, x AS (SELECT entity, pos, level, qty FROM panel WHERE NOT is_train)
SELECT entity, count(*) AS n, {r6('any_value(tau)')} AS tau FROM x JOIN (
  SELECT a.entity, sum(sign(b.level - a.level) * sign(b.qty - a.qty)) / nullif(sqrt(sum(abs(sign(b.level - a.level))) * sum(abs(sign(b.qty - a.qty)))), 0) AS tau FROM x a JOIN x b ON a.entity = b.entity AND a.pos < b.pos GROUP BY a.entity) USING (entity) GROUP BY entity""")
def kendall_exact(spark, d):
    rows = P.monthly_positions(spark, d, "n_name").where("NOT is_train")
    return stats.kendall_tau(rows, E, "pos", "level", "qty").select("entity", "n", rounded("tau").alias("tau"))


@query(f"""WITH {BETWEEN_SQL}, g AS (SELECT abs(obs_rho) AS v, connected FROM between_edges)
SELECT 'edges' AS unit, any_value(n1) AS n1, any_value(n0) AS n0, {r6('sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END)')} AS u, {r6('sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) / count(*)')} AS auc
FROM g a JOIN g b ON a.connected AND NOT b.connected, (SELECT count(CASE WHEN connected THEN 1 END) AS n1, count(CASE WHEN NOT connected THEN 1 END) AS n0 FROM g)""")
def mann_whitney_auc(spark, d):
    rows = report.connected_contrast(between(spark, d).withColumn("causal_evidence", F.lit(False)), False)
    return stats.mann_whitney(rows, ["unit"], "value", "connected").select("unit", "n1", "n0", rounded("u").alias("u"), rounded("auc").alias("auc"))


# --- graphs and selection --------------------------------------------------------------------------------------------

USABLE_SQL = ", usable AS (SELECT * FROM evidence WHERE causal_evidence AND obs_lag IS NOT NULL AND obs_lag >= 0)"
#: The forecast lag of a variable here: its strongest lag of 1 to 3; the positive lag: the same over edges of either sign.
FORECAST_SQL = ", forecast AS (SELECT entity, cause AS variable, obs_lag AS lag FROM within_lagged WHERE effect = 'level' AND obs_lag >= 1 AND obs_rho IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, cause ORDER BY obs_rho DESC, obs_lag) = 1)"


def forecast_lags(spark, d):
    """(entity, variable, lag) in one pass: every lag is a column, every correlation an aggregate."""
    w = Window.partitionBy("entity").orderBy("pos")
    cells = [(v, k) for v in VARIABLES[1:] for k in (1, 2, 3)]
    wide = P.hourly(spark, d).select("entity", "level", *(F.lag(v, k).over(w).alias(f"{v}_{k}") for v, k in cells))
    wide = wide.groupBy("entity").agg(*(correlation(f"{v}_{k}", "level").alias(f"{v}_{k}") for v, k in cells))
    rows = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(k).alias("obs_lag"), F.col(f"{v}_{k}").alias("obs_rho")) for v, k in cells))
    long = wide.select("entity", F.explode(rows).alias("s")).select("entity", "s.*")
    return _strongest(long, ["entity", "variable"]).select("entity", "variable", F.col("obs_lag").alias("lag"))


@query(f"""WITH RECURSIVE {EVIDENCE_SQL}{USABLE_SQL}, up AS (SELECT entity, cause AS variable FROM usable WHERE effect = 'level' UNION SELECT u.entity, u.cause FROM usable u JOIN up ON u.entity = up.entity AND u.effect = up.variable)
SELECT entity, variable FROM up WHERE variable <> 'level'""")
def ancestors(spark, d):
    return graph.ancestors(durable(selection.usable(evidence(spark, d))), E, "level")


@query(f"""WITH {EVIDENCE_SQL}{USABLE_SQL}{FORECAST_SQL} SELECT u.entity, u.cause AS variable, obs_lag AS causal_lag, CASE WHEN obs_lag >= 1 THEN obs_lag ELSE f.lag END AS lag
FROM usable u LEFT JOIN forecast f ON f.entity = u.entity AND f.variable = u.cause WHERE effect = 'level' AND CASE WHEN obs_lag >= 1 THEN obs_lag ELSE f.lag END IS NOT NULL""")
def direct_lags(spark, d):
    return selection.direct_lags(evidence(spark, d), E, "level", forecast_lags(spark, d)).select("entity", "variable", "causal_lag", "lag")


ANCESTOR_SQL = f"""{EVIDENCE_SQL}{USABLE_SQL}{FORECAST_SQL}, up AS (SELECT entity, cause AS variable FROM usable WHERE effect = 'level' UNION SELECT u.entity, u.cause FROM usable u JOIN up ON u.entity = up.entity AND u.effect = up.variable),
chosen AS (SELECT a.entity, a.variable, u.obs_lag AS causal_lag, CASE WHEN u.obs_lag >= 1 THEN u.obs_lag ELSE f.lag END AS lag FROM (SELECT * FROM up WHERE variable <> 'level') a
  LEFT JOIN usable u ON u.entity = a.entity AND u.cause = a.variable AND u.effect = 'level' LEFT JOIN forecast f ON f.entity = a.entity AND f.variable = a.variable)"""


def _ancestor_lags(spark, d):
    edges, lags = durable(evidence(spark, d)), durable(forecast_lags(spark, d))  # each is read several times
    return selection.ancestor_lags(edges, E, "level", lags, lags, lags.select("entity", "variable"))


@query(f"WITH RECURSIVE {ANCESTOR_SQL} SELECT * FROM chosen WHERE lag IS NOT NULL")
def ancestor_lags(spark, d):
    return _ancestor_lags(spark, d).select("entity", "variable", "causal_lag", "lag")


@query(f"""WITH RECURSIVE {ANCESTOR_SQL}, c AS (SELECT * FROM chosen WHERE lag IS NOT NULL)
SELECT entity, string_agg(variable, ',' ORDER BY variable) AS selected_vars, '{{' || string_agg('"' || variable || '":' || coalesce(causal_lag::VARCHAR, 'null'), ',' ORDER BY variable) || '}}' AS old_lags,
  '{{' || string_agg('"' || variable || '":' || lag, ',' ORDER BY variable) || '}}' AS new_lags FROM c GROUP BY entity""")
def selected_lag_report(spark, d):
    return selection.lag_report(_ancestor_lags(spark, d), E)


@query(f"WITH {BETWEEN_EVIDENCE_SQL} SELECT effect AS entity, cause AS neighbour, obs_lag AS causal_lag, CASE WHEN obs_lag >= 1 THEN obs_lag ELSE 2 END AS lag FROM evidence WHERE causal_evidence")
def neighbour_lags(spark, d):
    """Lags of 0 become 2 here, as the forecast scan's answer."""
    edges = between_evidence(spark, d)
    forecast = edges.select(F.col("effect").alias("entity"), F.col("cause").alias("neighbour"), F.lit(2).alias("lag"))
    return selection.neighbour_lags(edges, forecast).select("entity", "neighbour", "causal_lag", "lag")


@query(f"""WITH RECURSIVE {CONNECTED_SQL}, both_ways AS (SELECT a, b FROM connected UNION SELECT b, a FROM connected), reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def components(spark, d):
    return graph.components(connected(spark, d))


TIER_SQL = f"""{CONNECTED_SQL}, p AS (SELECT a.n_name AS a, b.n_name AS b, CASE WHEN EXISTS (SELECT 1 FROM connected c WHERE (c.a = a.n_name AND c.b = b.n_name) OR (c.a = b.n_name AND c.b = a.n_name)) THEN 1
  WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 4 END::INTEGER AS tier FROM nation a JOIN nation b ON a.n_name < b.n_name)"""


def _tiers(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    groups = nations.join(graph.components(connected(spark, d)), F.col("n_name") == F.col("node"), "left").select(F.col("n_name").alias("node"), "component", F.col("n_regionkey").alias("system"))
    one, two = nations.select(F.col("n_name").alias("a"), F.lit(1).alias("k")), nations.select(F.col("n_name").alias("b"), F.lit(1).alias("k"))
    return graph.tiers(one.join(two, "k").where("a < b").select("a", "b"), connected(spark, d), groups)


@query(f"WITH {TIER_SQL} SELECT * FROM p")
def tier(spark, d):
    return _tiers(spark, d)


@query("WITH RECURSIVE a AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS next_down FROM nation), up AS (SELECT 1 AS node UNION SELECT a.node FROM a JOIN up ON a.next_down = up.node) SELECT node FROM up")
def upstream_trace(spark, d):
    areas = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") > 0, F.expr("(n_nationkey - 1) div 2").cast("int")).alias("next_down"))
    return graph.upstream(areas, areas.where("node = 1"))


@query("SELECT s_nationkey AS station, max(s_suppkey)::BIGINT AS id, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY ALL")
def last_wins_dedup(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("station"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("o"))
    return last_by(rows, ["station"], "o").select("station", "id", "name")


# --- reports ---------------------------------------------------------------------------------------------------------


STRENGTH_SQL = BETWEEN_EVIDENCE_SQL + ", strength AS (SELECT least(cause, effect) AS a, greatest(cause, effect) AS b, avg(abs(obs_rho)) AS strength, bool_or(coalesce(statistically_significant AND convergence_diagnostic_pass AND obs_lag >= 0, false)) AS detected FROM evidence GROUP BY ALL)"


@query(f"WITH {STRENGTH_SQL} SELECT a, b, {r6('strength.strength')} AS strength, detected FROM strength")
def pair_strength(spark, d):
    return report.pair_strength(between_evidence(spark, d)).select("a", "b", rounded("strength").alias("strength"), "detected")


@query(f"""WITH {BETWEEN_EVIDENCE_SQL}, x AS (SELECT 'edges' AS unit, abs(obs_rho) AS value, connected, causal_evidence AS s FROM evidence
  UNION ALL SELECT 'pairs', avg(abs(obs_rho)), bool_or(connected), bool_or(causal_evidence) FROM evidence GROUP BY least(cause, effect), greatest(cause, effect))
SELECT unit, count(CASE WHEN connected THEN 1 END) AS n_connected, count(CASE WHEN NOT connected THEN 1 END) AS n_unconnected, {r6('median(CASE WHEN connected THEN value END)')} AS median_connected,
  {r6('median(CASE WHEN NOT connected THEN value END)')} AS median_unconnected, {r6('avg(CASE WHEN connected THEN s::INT END)')} AS share_connected, {r6('avg(CASE WHEN NOT connected THEN s::INT END)')} AS share_unconnected FROM x GROUP BY unit""")
def connected_summary(spark, d):
    edges = between_evidence(spark, d)
    out = report.contrast_summary(report.connected_contrast(edges, False).union(report.connected_contrast(edges, True)))
    return out.select("unit", "n_connected", "n_unconnected", *(rounded(c).alias(c) for c in ("median_connected", "median_unconnected", "share_connected", "share_unconnected")))


@query(f"""WITH {STRENGTH_SQL}, {TIER_SQL[len(CONNECTED_SQL) + 2:]}
SELECT tier, count(*) AS n, {r6('min(strength)')} AS low, {r6('quantile_cont(strength, 0.25)')} AS q1, {r6('median(strength)')} AS median, {r6('quantile_cont(strength, 0.75)')} AS q3, {r6('max(strength)')} AS high FROM strength JOIN p USING (a, b) GROUP BY tier""")
def tier_boxes(spark, d):
    rows = report.pair_strength(between_evidence(spark, d)).join(_tiers(spark, d), ["a", "b"])
    return report.tier_boxes(rows).select("tier", "n", *(rounded(c).alias(c) for c in ("low", "q1", "median", "q3", "high")))


@query(f"WITH {EVIDENCE_SQL} SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY round(evidence.obs_rho, 9) DESC, cause))::INTEGER AS place, cause, obs_lag, {r6('evidence.obs_rho')} AS obs_rho, {r6('evidence.p_fdr')} AS p_fdr, lag_resolution FROM evidence WHERE statistically_significant AND effect = 'level'")
def supported_drivers(spark, d):
    rows = report.supported_drivers(evidence(spark, d), "level")
    return rows.select("entity", "place", "cause", "obs_lag", rounded("obs_rho").alias("obs_rho"), rounded("p_fdr").alias("p_fdr"), "lag_resolution")


_DRIVERS = VARIABLES[1:]


@query(f"WITH {EVIDENCE_SQL} SELECT entity, {', '.join(f'{r6(f"""max(CASE WHEN cause = '{v}' THEN obs_rho END)""")} AS {v}' for v in _DRIVERS)} FROM evidence WHERE statistically_significant AND effect = 'level' GROUP BY entity")
def driver_matrix(spark, d):
    return report.driver_matrix(evidence(spark, d), "level", _DRIVERS).select("entity", *(rounded(v).alias(v) for v in _DRIVERS))


@query(f"WITH {EVIDENCE_SQL} SELECT cause, effect, count(DISTINCT entity) AS entities, count(CASE WHEN statistically_significant THEN 1 END) AS supported FROM evidence GROUP BY ALL")
def support_counts(spark, d):
    return report.support_counts(evidence(spark, d))


SIZES_SQL = "sizes AS (SELECT DISTINCT event_type AS entity, v AS variable, (('0x' || substr(md5(event_type || v), 1, 2))::BIGINT % 9 + 2)::INTEGER AS size, 1::INTEGER AS tau, (('0x' || substr(md5(v || event_type), 1, 2))::BIGINT % 9 + 2)::INTEGER AS old_size, 1::INTEGER AS old_tau FROM events, (SELECT unnest(['level', 'p', 'r', 't', 'swe', 'evap']) AS v))"


def _sizes(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("entity")).distinct().withColumn("variable", F.explode(F.array(*map(F.lit, VARIABLES))))
    draw = lambda *c: (F.conv(F.substring(F.md5(F.concat(*c)), 1, 2), 16, 10).cast("long") % 9 + 2).cast("int")
    return rows.withColumns({"size": draw("entity", "variable"), "tau": F.lit(1), "old_size": draw("variable", "entity"), "old_tau": F.lit(1)})


@query(f"WITH {SIZES_SQL} SELECT entity, {', '.join(f"""max(CASE WHEN variable = '{v}' THEN size END) AS {v}""" for v in VARIABLES)} FROM sizes GROUP BY entity")
def embedding_matrix(spark, d):
    return report.embedding_matrix(_sizes(spark, d), VARIABLES)


@query(f"WITH {SIZES_SQL} SELECT count(*) AS series, count(CASE WHEN size IS DISTINCT FROM old_size THEN 1 END) AS size_changed, count(CASE WHEN tau IS DISTINCT FROM old_tau THEN 1 END) AS tau_changed FROM sizes")
def embedding_audit(spark, d):
    return report.embedding_changes(_sizes(spark, d))


@query(f"WITH {WITHIN_SQL}, {SIZES_SQL} SELECT e.entity, cause, e.effect, {r6('e.obs_rho')} AS obs_rho, size, tau FROM within_edges e LEFT JOIN sizes s ON s.entity = e.entity AND s.variable = e.effect")
def edges_with_embedding(spark, d):
    return report.edges_with_embedding(within(spark, d), _sizes(spark, d)).select("entity", "cause", "effect", rounded("obs_rho").alias("obs_rho"), "size", "tau")


# --- screening -------------------------------------------------------------------------------------------------------

#: Made-up coordinates and drainage areas of suppliers (flow gauges) and customers (level gauges).
GAUGES_SQL = """
flows AS (SELECT s_suppkey AS id, s_name || CASE WHEN s_suppkey % 11 = 0 THEN ' ABOVE DAM' ELSE ' LAKE' END AS name, s_nationkey AS region, 40 + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS lat, -100 + (s_suppkey * 53 % 1000) / 100.0::DOUBLE AS lon, 500 + (s_suppkey * 17 % 400) / 1.0::DOUBLE AS area, (s_suppkey % 3 > 0)::INT AS regulated FROM supplier),
levels AS (SELECT c_custkey + 1000000 AS id, c_name || ' LAKE' AS name, c_nationkey AS region, 40 + (c_custkey * 31 % 1000) / 100.0::DOUBLE AS lat, -100 + (c_custkey * 59 % 1000) / 100.0::DOUBLE AS lon, 500 + (c_custkey * 13 % 400) / 1.0::DOUBLE AS area FROM customer)"""
KM_SQL = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(f.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - l.lon) / 2), 2)))"


def gauges(spark, d):
    place = lambda k, a, b, c: ((40 + (F.col(k) * a % 1000) / 100.0).alias("lat"), (-100 + (F.col(k) * b % 1000) / 100.0).alias("lon"), (500 + (F.col(k) * c % 400) / 1.0).alias("area"))
    s, c = spark.read.parquet(f"{d}/supplier.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 11 == 0, " ABOVE DAM").otherwise(" LAKE"))
    flows = s.select(F.col("s_suppkey").alias("id"), name.alias("name"), F.col("s_nationkey").alias("region"), *place("s_suppkey", 37, 53, 17), (F.col("s_suppkey") % 3 > 0).cast("int").alias("regulated"))
    levels = c.select((F.col("c_custkey") + 1000000).alias("id"), F.concat("c_name", F.lit(" LAKE")).alias("name"), F.col("c_nationkey").alias("region"), *place("c_custkey", 31, 59, 13))
    return levels, flows


@query(f"""WITH {GAUGES_SQL}, pairs AS (SELECT l.id, f.id AS flow_id, round(f.area / l.area, 3) AS ratio, {KM_SQL} AS km, f.area / l.area AS exact FROM levels l JOIN flows f USING (region)
  WHERE f.regulated = 1 AND NOT regexp_matches(upper(f.name), '\\b(ABOVE|INLET)\\b'))
SELECT id, flow_id, {r6('pairs.ratio')} AS ratio, {r6('km')} AS distance_km, CASE WHEN ratio BETWEEN 0.95 AND 1.05 THEN 'high' ELSE 'review' END AS confidence
FROM pairs WHERE exact BETWEEN 0.85 AND 1.20 AND km <= 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(abs(pairs.ratio - 1), 3), flow_id) = 1""")
def outlet_match_theta_argmin(spark, d):
    levels, flows = gauges(spark, d)
    return screening.match_outlets(levels, flows).select("id", "flow_id", rounded("ratio").alias("ratio"), rounded("distance_km").alias("distance_km"), "confidence")


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(upper(p_name || ' Lake, near the (River)'), '[().,''\\-\\s]+', ' ', 'g')), ' ')), lambda x: x NOT IN ('LAKE', 'NEAR', 'THE', 'RIVER', ''))), ' ') AS tokens FROM part")
def name_confidence(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(" Lake, near the (River)")).alias("name"))
    return rows.select("p_partkey", F.array_join(F.array_sort(name_tokens("name", screening.STOP)), " ").alias("tokens"))


@query(f"WITH {GAUGES_SQL} SELECT l.id, f.id AS flow_id, {r6(KM_SQL)} AS km FROM levels l JOIN flows f USING (region) WHERE {KM_SQL} <= 50")
def haversine_pairs(spark, d):
    levels, flows = gauges(spark, d)
    f = flows.select("region", F.col("id").alias("flow_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = levels.join(f, "region").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where("km <= 50")
    return pairs.select("id", "flow_id", rounded("km").alias("km"))


@query(f"""WITH {GAUGES_SQL}, boxes AS (SELECT n_nationkey AS area, 40 + n_nationkey * 0.35 AS south, 40 + n_nationkey * 0.35 + 0.9 AS north, -100 + n_nationkey * 0.35 AS west, -100 + n_nationkey * 0.35 + 1.3 AS east, (n_nationkey * 7 % 25)::DOUBLE AS size FROM nation),
x AS (SELECT id AS point, area, size, sqrt(pow(greatest(west - lon, lon - east, 0), 2) + pow(greatest(south - lat, lat - north, 0), 2)) AS dist FROM flows, boxes)
SELECT point, x.area, CASE WHEN dist = 0 THEN 'contains' ELSE 'near' END AS relation FROM (SELECT point, area, size, dist FROM x) x WHERE dist <= 0.05
QUALIFY row_number() OVER (PARTITION BY point ORDER BY (dist = 0) DESC, CASE WHEN dist = 0 THEN -size ELSE dist END, x.area) = 1""".replace("SELECT id AS point, area, size, sqrt", "SELECT id AS point, boxes.area, size, sqrt"))
def containing_area(spark, d):
    # Corners in decimals as in the SQL: in doubles some lie a last place off, and points just as far as the limit would be lost.
    corner = lambda x: (F.col("n_nationkey") * F.expr("0.35BD") + F.expr(f"{x}BD")).cast("double")
    boxes = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("area"), *(corner(x).alias(n) for n, x in (("south", "40"), ("north", "40.9"), ("west", "-100"), ("east", "-98.7"))), (F.col("n_nationkey") * 7 % 25).cast("double").alias("size"))
    return screening.holding_area(gauges(spark, d)[1].select(F.col("id").alias("point"), "lat", "lon"), boxes)


#: A concave outline for every nation: offsets of the edges' ends from its corner.
OUTLINE = ((0.0, 0.0), (1.3, 0.2), (0.55, 0.45), (1.1, 0.9), (0.1, 0.75))
OUTLINE_SQL = f"""outlines AS (SELECT n_nationkey AS area, (n_nationkey * 7 % 25)::DOUBLE AS size, -100 + n_nationkey * 0.35::DOUBLE AS w, 40 + n_nationkey * 0.35::DOUBLE AS s FROM nation),
edges AS (SELECT area, size, w + t.a AS x1, s + t.b AS y1, w + t.c AS x2, s + t.e AS y2 FROM outlines, (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for (a, b), (c, e) in zip(OUTLINE, OUTLINE[1:] + OUTLINE[:1]))}) t(a, b, c, e))"""


def _outlines(spark, d):
    w, s = (F.lit(x) + F.col("n_nationkey") * F.lit(0.35) for x in (-100, 40))
    ring = F.array(*(F.struct((w + a).alias("x"), (s + b).alias("y")) for a, b in OUTLINE))
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("area"), F.array(ring).alias("rings"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("size"))


@query(f"""WITH {GAUGES_SQL}, {OUTLINE_SQL},
o AS (SELECT id AS point, edges.area, size, lon, lat, x1, y1, x2, y2, least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS u FROM flows, edges),
x AS (SELECT point, area, size, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 AS inside, min(sqrt(pow(lon - x1 - u * (x2 - x1), 2) + pow(lat - y1 - u * (y2 - y1), 2))) AS dist FROM o GROUP BY point, area, size)
SELECT point, area, CASE WHEN inside THEN 'contains' ELSE 'near' END AS relation FROM x WHERE inside OR dist <= 0.05
QUALIFY row_number() OVER (PARTITION BY point ORDER BY inside DESC, CASE WHEN inside THEN -size ELSE dist END, area) = 1""")
def containing_outline(spark, d):
    """The outline that holds each gauge, or the nearest."""
    return screening.holding_outline(gauges(spark, d)[1].select(F.col("id").alias("point"), "lat", "lon"), _outlines(spark, d))


@query(f"""WITH {OUTLINE_SQL},
b AS (SELECT area, i, unnest(range(floor(w / 0.1::DOUBLE)::BIGINT - 1, floor((w + 1.3::DOUBLE) / 0.1::DOUBLE)::BIGINT + 2)) AS j, w, s FROM (SELECT *, unnest(range(floor(s / 0.1::DOUBLE)::BIGINT - 1, floor((s + 0.9::DOUBLE) / 0.1::DOUBLE)::BIGINT + 2)) AS i FROM outlines)),
q AS (SELECT area, i, j, i * 0.1::DOUBLE AS south, (i + 1) * 0.1::DOUBLE AS north, j * 0.1::DOUBLE AS west, (j + 1) * 0.1::DOUBLE AS east FROM b),
c AS (SELECT q.*, x1, y1, x2, y2, [(x2 - x1) * (south - y1) - (y2 - y1) * (west - x1), (x2 - x1) * (north - y1) - (y2 - y1) * (west - x1), (x2 - x1) * (south - y1) - (y2 - y1) * (east - x1), (x2 - x1) * (north - y1) - (y2 - y1) * (east - x1)] AS sides FROM q JOIN edges USING (area)),
m AS (SELECT area, i, j, bool_or(NOT (greatest(x1, x2) < west OR least(x1, x2) > east OR greatest(y1, y2) < south OR least(y1, y2) > north) AND list_min(sides) <= 0 AND list_max(sides) >= 0) AS cuts,
  count(*) FILTER ((y1 > south) <> (y2 > south) AND west < (x2 - x1) * (south - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM c GROUP BY area, i, j)
SELECT area, round((i + 0.5::DOUBLE) * 0.1::DOUBLE, 6) AS lat, round((j + 0.5::DOUBLE) * 0.1::DOUBLE, 6) AS lon FROM m WHERE cuts OR inside""")
def outline_cells(spark, d):
    """Grid squares that an outline touches, for every nation."""
    return grid.cells_of_outline(_outlines(spark, d))


# --- the rest of the inventory ---------------------------------------------------------------------------------------


@query()
def kendall_p(spark, d):
    """Exact p-values of Kendall's tau."""
    return stats.kendall_test(P.monthly_positions(spark, d, "n_name").where("NOT is_train"), E, "pos", "level", "qty")


@query()
def mann_whitney_p(spark, d):
    return stats.mann_whitney_test(report.connected_contrast(between(spark, d).withColumn("causal_evidence", F.lit(False)), True), ["unit"], "value", "connected")


@query(f"WITH {WITHIN_SQL} SELECT cause, effect, max_by(entity, entity) AS entity, {r6('max_by(obs_rho, entity)')} AS obs_rho FROM within_edges GROUP BY cause, effect")
def build_digraph(spark, d):
    """One edge per pair, the last entity's."""
    rows = graph.last_edges(within(spark, d).select("cause", "effect", "entity", "obs_rho"), [], "entity")
    return rows.select("cause", "effect", "entity", rounded("obs_rho").alias("obs_rho"))


@query(f"WITH {BETWEEN_EVIDENCE_SQL}, {TIER_SQL[len(CONNECTED_SQL) + 2:]} SELECT cause, effect, obs_lag, {r6('obs_rho')} AS obs_rho, statistically_significant, tier FROM evidence JOIN p ON p.a = least(cause, effect) AND p.b = greatest(cause, effect)")
def between_edges_tier(spark, d):
    edges = between_evidence(spark, d).withColumn("a", F.least("cause", "effect")).withColumn("b", F.greatest("cause", "effect"))
    return edges.join(_tiers(spark, d), ["a", "b"]).select("cause", "effect", "obs_lag", rounded("obs_rho").alias("obs_rho"), "statistically_significant", "tier")


@query("""SELECT n_nationkey AS k, substr(sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'), 1, 16) AS fingerprint FROM nation""")
def config_fingerprint(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet")
    return rows.select(F.col("n_nationkey").alias("k"), fingerprint(F.struct("n_name", "n_regionkey")).alias("fingerprint"))


@query("""SELECT n_nationkey AS area, (round(i * 0.1, 6) + 0.0)::DOUBLE AS lat, (round(j * 0.1, 6) + 0.0)::DOUBLE AS lon FROM (
  SELECT n_nationkey, j, unnest(range(ceil((n_nationkey * 0.3 - 0.15) / 0.1 - 0.5)::BIGINT, floor((n_nationkey * 0.3 + 0.57 + 0.15) / 0.1 + 0.5)::BIGINT + 1)) AS i FROM (
    SELECT n_nationkey, unnest(range(ceil((n_nationkey * 0.2 - 0.15) / 0.1 - 0.5)::BIGINT, floor((n_nationkey * 0.2 + 0.33 + 0.15) / 0.1 + 0.5)::BIGINT + 1)) AS j FROM nation))""".replace("* 0.3 - 0.15", "* 0.31::DOUBLE - 0.15").replace("* 0.3 + 0.57", "* 0.31::DOUBLE + 0.57").replace("* 0.2 - 0.15", "* 0.23::DOUBLE - 0.15").replace("* 0.2 + 0.33", "* 0.23::DOUBLE + 0.33"))
def area_cells(spark, d):
    """Grid cells of a box for every nation."""
    n = F.col("n_nationkey")
    boxes = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("area"), (n * 0.31).alias("south"), (n * 0.31 + 0.57).alias("north"), (n * 0.23).alias("west"), (n * 0.23 + 0.33).alias("east"))
    return grid.cells_in_box(boxes).select("area", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))


@query(f"""WITH c AS (SELECT c_nationkey AS area, round(floor((c_custkey % 7 * 0.1::DOUBLE + 0.03) / 0.1 + 0.5) * 0.1, 6) AS lat, round(floor((c_custkey % 5 * 0.1::DOUBLE + 0.03) / 0.1 + 0.5) * 0.1, 6) AS lon FROM customer),
g AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(floor((o_orderkey % 7 * 0.1::DOUBLE + 0.02) / 0.1 + 0.5) * 0.1, 6) AS lat, round(floor((o_orderkey % 5 * 0.1::DOUBLE + 0.02) / 0.1 + 0.5) * 0.1, 6) AS lon, o_orderpriority AS variable, o_totalprice AS value FROM orders),
p AS (SELECT DISTINCT area, lat, lon FROM c) SELECT area, variable, month, {r6('avg(value)')} AS value FROM g JOIN p USING (lat, lon) GROUP BY ALL""")
def grid_area_means(spark, d):
    at = lambda key, k, x: (F.col(key) % k * 0.1 + x)
    cells = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("area"), at("c_custkey", 7, 0.03).alias("lat"), at("c_custkey", 5, 0.03).alias("lon")).distinct()
    values = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("time"), at("o_orderkey", 7, 0.02).alias("lat"), at("o_orderkey", 5, 0.02).alias("lon"), F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("value"))
    return grid.area_means(values, cells).select("area", "variable", "month", rounded("value").alias("value"))


@query("SELECT s_nationkey AS station, max(s_suppkey % 3)::BIGINT AS regulated, count(*)::INTEGER AS n_periods, min(1950 + s_suppkey % 50)::BIGINT AS first_year FROM supplier GROUP BY s_nationkey")
def regulation_history(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("station"), (1950 + F.col("s_suppkey") % 50).alias("year_from"), (2000 + F.col("s_suppkey") % 9).alias("year_to"), (F.col("s_suppkey") % 3).alias("regulated"))
    out = screening.regulated_stations(rows)
    return out.select("station", "regulated", F.size("periods").alias("n_periods"), F.col("periods")[0]["year_from"].alias("first_year"))


@query(f"WITH {P.SPARSE_SQL} SELECT entity, pos, {r6('x - avg(x) OVER (PARTITION BY entity)')} AS centred FROM sparse")
def centred_levels(spark, d):
    return report.centred(P.sparse(spark, d), E, "x").select("entity", F.col("pos").cast("long").alias("pos"), rounded("centred").alias("centred"))


@query("SELECT event_type AS entity, count(*) AS n, CASE event_type WHEN 'purchase' THEN 'Bought' WHEN 'view' THEN 'Seen' ELSE event_type END AS label, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END::INTEGER AS label_rank FROM events GROUP BY event_type")
def labelled_order(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("entity")).agg(F.count("*").alias("n"))
    return report.labelled(rows, "entity", {"purchase": "Bought", "view": "Seen"}).orderBy("label_rank", F.desc("n"))


@query(f"""WITH {EVIDENCE_SQL}, a AS (SELECT cause, effect FROM evidence WHERE statistically_significant), b AS (SELECT effect AS cause, cause AS effect FROM evidence WHERE statistically_significant)
SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'one', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def direction_sets(spark, d):
    """Pairs of variables significant in both directions somewhere, and in one only."""
    rows = evidence(spark, d).where("statistically_significant")
    a, b = rows.select("cause", "effect"), rows.select(F.col("effect").alias("cause"), F.col("cause").alias("effect"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "cause", "effect").unionByName(a.subtract(b).select(F.lit("one").alias("kind"), "cause", "effect"))


@query(f"WITH {EVIDENCE_SQL} SELECT entity, cause, effect, {r6('obs_rho')} AS obs_rho, (row_number() OVER (ORDER BY statistically_significant DESC, round(evidence.obs_rho, 6) DESC, entity, cause, effect))::INTEGER AS place FROM evidence QUALIFY row_number() OVER (ORDER BY statistically_significant DESC, round(evidence.obs_rho, 6) DESC, entity, cause, effect) <= 20")
def strongest_edges(spark, d):
    """A report's head: the twenty strongest, significant ones first."""
    order = [F.desc("statistically_significant"), F.round("obs_rho", 6).desc(), "entity", "cause", "effect"]
    top = evidence(spark, d).orderBy(*order).limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("entity", "cause", "effect", rounded("obs_rho").alias("obs_rho"), "place")
