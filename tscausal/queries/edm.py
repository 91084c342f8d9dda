"""Embeddings, cross mapping, simplex projection and edge tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, crossmap, edm, stats
from ..params import DEFAULT
from ..sources import panels as P
from ..sources.files import durable
from . import corr, query, r6, rounded

E = ["entity"]
LAGS = list(range(-12, 13))


def _points_sql(table: str, cause: str, effect: str, lags: list[int], size: int) -> str:
    parts = []
    for lag in lags:
        v = [f"lead({effect}, {lag - k}) OVER w" if lag >= k else f"lag({effect}, {k - lag}) OVER w" for k in range(size)]
        parts.append(f"SELECT entity, {lag}::INTEGER AS lag, pos, {cause} AS y, {', '.join(f'{x} AS v{k + 1}' for k, x in enumerate(v))} FROM {table} WINDOW w AS (PARTITION BY entity ORDER BY pos)")
    known = " AND ".join(["y IS NOT NULL", *(f"v{k + 1} IS NOT NULL" for k in range(size))])
    return "points AS (SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE {known})"


def _skill_sql(size: int, apart: int = 0, keys: str = "entity, lag") -> str:
    using = keys
    d = " + ".join(f"(a.v{k + 1} - b.v{k + 1}) * (a.v{k + 1} - b.v{k + 1})" for k in range(size))
    names = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
pairs AS (SELECT {names}, a.pos, a.y, b.y AS ny, b.pos AS q, sqrt(0.0 + {d}) AS d FROM points a JOIN points b USING ({using}) WHERE abs(a.pos - b.pos) > {apart}),
near AS (SELECT *, min(d) OVER (PARTITION BY {keys}, pos) AS dm FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY {keys}, pos ORDER BY d, q) <= {size + 1})),
w AS (SELECT *, CASE WHEN dm = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 1e-6 END ELSE greatest(exp(-d / dm), 1e-6) END AS w FROM near),
pred AS (SELECT {keys}, pos, any_value(y) AS y, sum(w * ny) / sum(w) AS p FROM w GROUP BY {keys}, pos),
skill AS (SELECT {keys}, count(*) AS n, {corr("y", "p")} AS rho FROM pred GROUP BY {keys})"""


@query(f"WITH {P.HOURLY_SQL}, {_points_sql('hourly', 'p', 'level', [1], 3)} SELECT entity, lag, pos, {', '.join(f'{r6(c)} AS {c}' for c in ('y', 'v1', 'v2', 'v3'))} FROM points")
def effect_embedding(spark, d):
    rows = edm.embed(P.hourly(spark, d), E, "pos", "level", "p", [1], 3)
    return rows.select("entity", "lag", F.col("pos").cast("long").alias("pos"), *(rounded(c).alias(c) for c in ("y", "v1", "v2", "v3")))


@query(f"WITH {P.HOURLY_SQL}, {_points_sql('hourly', 'p', 'level', [1], 3)}, {_skill_sql(3)} SELECT entity, lag, n, {r6('rho')} AS rho FROM skill")
def crossmap_skill(spark, d):
    return edm.cross_map(P.hourly(spark, d), E, "pos", "p", "level", [1], 3, least=0).select("entity", "lag", "n", rounded("rho").alias("rho"))


def _profile(spark, d, lags=LAGS, least=None):
    return edm.cross_map(P.monthly_positions(spark, d), E, "pos", "qty", "level", lags, 2, least=least)


PROFILE_SQL = f"{P.monthly_positions_sql()}, {_points_sql('panel', 'qty', 'level', LAGS, 2)}, {_skill_sql(2)}, profile AS (SELECT * FROM skill WHERE n >= 20)"


@query(f"WITH {PROFILE_SQL} SELECT entity, lag, n, {r6('rho')} AS rho FROM profile")
def lag_profile(spark, d):
    return _profile(spark, d).select("entity", "lag", "n", rounded("rho").alias("rho"))


BEST = "SELECT entity, lag, n, {} AS rho FROM {} WHERE rho IS NOT NULL {} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY rho DESC, lag) = 1"


@query(f"WITH {PROFILE_SQL} {BEST.format(r6('profile.rho'), 'profile', '').replace('ORDER BY rho', 'ORDER BY profile.rho')}")
def max_over_lags(spark, d):
    return edm.best_lag(_profile(spark, d), E).select("entity", "lag", "n", rounded("rho").alias("rho"))


@query(f"WITH {PROFILE_SQL} {BEST.format(r6('profile.rho'), 'profile', 'AND lag >= 1').replace('ORDER BY rho', 'ORDER BY profile.rho')}")
def best_positive_lag(spark, d):
    return edm.best_lag(_profile(spark, d), E, 1).select("entity", "lag", "n", rounded("rho").alias("rho"))


@query(f"WITH {P.SPARSE_SQL}, two AS (SELECT a.entity, a.pos, a.x AS a, b.x AS b FROM sparse a LEFT JOIN sparse b ON b.entity = a.entity AND b.pos = a.pos + 24), {_points_sql('two', 'b', 'a', [-1, 0, 1], 2)}, {_skill_sql(2)} SELECT entity, lag, n, {r6('rho')} AS rho FROM skill")
def lag_scan_nullkeeping(spark, d):
    """A scan without a least number of points, over a panel whose gaps stay in place."""
    rows = P.sparse(spark, d)
    later = rows.select("entity", (F.col("pos") - 24).alias("pos"), F.col("x").alias("b"))
    return edm.cross_map(rows.join(later, ["entity", "pos"], "left"), E, "pos", "b", "x", [-1, 0, 1], 2, least=0).select("entity", "lag", "n", rounded("rho").alias("rho"))


FORECAST_SQL = f"{P.monthly_positions_sql()}, {_points_sql('panel', 'qty', 'level', list(range(1, 13)), 2)}, {_skill_sql(2)}"


@query(f"WITH {FORECAST_SQL} {BEST.format(r6('skill.rho'), 'skill', '').replace('ORDER BY rho', 'ORDER BY skill.rho')}")
def forecast_constrained_lag(spark, d):
    return edm.best_lag(_profile(spark, d, list(DEFAULT.forecast_lags), 0), E).select("entity", "lag", "n", rounded("rho").alias("rho"))


def _simplex_sql() -> str:
    # Vectors of every size share the widest list of columns; columns beyond the size are zero on both sides.
    parts = []
    for size in DEFAULT.dimensions:
        v = [("level" if not k else f"lag(level, {k}) OVER w") if k < size else "0.0" for k in range(10)]
        parts.append(f"SELECT entity, {size}::INTEGER AS size, pos, lead(level, 1) OVER w AS y, {', '.join(f'{x} AS v{k + 1}' for k, x in enumerate(v))} FROM panel WINDOW w AS (PARTITION BY entity ORDER BY pos)")
    points = "points AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE y IS NOT NULL AND " + " AND ".join(f"v{k} IS NOT NULL" for k in range(1, 11)) + ")"
    return P.monthly_positions_sql("n_name") + ", " + points + ", " + _skill_sql(10, 1, "entity, size").replace("<= 11)", "<= size + 1)").replace("b.y AS ny", "b.y AS ny, a.size AS s").replace("a.entity, a.size, a.pos", "a.entity, a.size, a.pos")


@query(f"WITH {_simplex_sql()} SELECT entity, size, {r6('rho')} AS rho FROM skill WHERE n >= 2")
def simplex_self_skill(spark, d):
    return edm.simplex_skill(P.monthly_positions(spark, d, "n_name"), E, "pos", "level", list(DEFAULT.dimensions)).select("entity", "size", rounded("rho").alias("rho"))


@query(f"WITH {_simplex_sql()}, best AS (SELECT * FROM skill WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY rho DESC NULLS LAST, size) = 1) SELECT entity, CASE WHEN rho IS NULL THEN 2 ELSE size END AS size FROM best")
def select_embedding_dim(spark, d):
    return edm.choose_size(edm.simplex_skill(P.monthly_positions(spark, d, "n_name"), E, "pos", "level", list(DEFAULT.dimensions)), E)


@query(f"""WITH {P.monthly_positions_sql()}, {_points_sql('panel', 'qty', 'level', [1], 2)},
each AS (SELECT *, row_number() OVER (PARTITION BY entity, sample ORDER BY md5(sample || '|' || pos), pos) AS r FROM points, (SELECT unnest(range(1, 6)) AS sample)),
pairs AS (SELECT a.entity, l.library, a.sample, a.pos, a.y, b.y AS ny, b.pos AS q, sqrt(0.0 + (a.v1 - b.v1) * (a.v1 - b.v1) + (a.v2 - b.v2) * (a.v2 - b.v2)) AS d
  FROM each a JOIN each b ON a.entity = b.entity AND a.sample = b.sample AND a.pos <> b.pos JOIN (SELECT unnest([15, 30, 45, 60]) AS library) l ON b.r <= l.library),
near AS (SELECT *, min(d) OVER (PARTITION BY entity, library, sample, pos) AS dm FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY entity, library, sample, pos ORDER BY d, q) <= 3)),
pred AS (SELECT entity, library, sample, pos, any_value(y) AS y, sum(greatest(exp(-d / dm), 1e-6) * ny) / sum(greatest(exp(-d / dm), 1e-6)) AS p FROM near GROUP BY ALL),
s AS (SELECT entity, library, sample, {corr("y", "p")} AS rho FROM pred GROUP BY ALL)
SELECT entity, library, count(rho) AS n, {r6('avg(rho)')} AS rho FROM s GROUP BY ALL""")
def convergence_curve(spark, d):
    points = edm.embed(P.monthly_positions(spark, d), E, "pos", "level", "qty", [1], 2)
    return edm.convergence(points, E, "pos", 2, [15, 30, 45, 60]).select("entity", "library", "n", rounded("rho").alias("rho"))


SHIFTS = [0, *range(10, 701, 10)]
NULLS_SQL = f"""{P.HOURLY_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM hourly),
nulls AS (SELECT a.entity, s.shift, {corr("a.p", "b.level")} AS rho FROM n a CROSS JOIN (SELECT unnest({SHIFTS}) AS shift) s JOIN n b ON b.entity = a.entity AND b.pos = (a.pos + s.shift) % a.n GROUP BY ALL)"""


@query(f"""WITH {NULLS_SQL}, o AS (SELECT entity, rho AS observed FROM nulls WHERE shift = 0)
SELECT entity, {r6('any_value(observed)')} AS observed, count(rho) AS n_valid, {r6('(count(CASE WHEN rho >= observed THEN 1 END) + 1) / (count(rho) + 1)')} AS p_value, {r6('avg(rho)')} AS null_mean, {r6('stddev_pop(rho)')} AS null_std
FROM nulls JOIN o USING (entity) WHERE shift > 0 GROUP BY entity""")
def empirical_p(spark, d):
    rows = edm.shifted_nulls(P.hourly(spark, d), E, "pos", "p", "level", SHIFTS)
    observed = rows.where("shift = 0").select("entity", F.col("rho").alias("observed"))
    joined = rows.where("shift > 0").join(observed, E)
    return joined.groupBy("entity").agg(
        rounded(F.first("observed")).alias("observed"), F.count("rho").alias("n_valid"), rounded(stats.empirical_p(F.col("rho"), F.col("observed"))).alias("p_value"),
        rounded(F.avg("rho")).alias("null_mean"), rounded(F.stddev_pop("rho")).alias("null_std"),
    )


@query()
def iaaft_surrogates(spark, d):
    """Twenty surrogates of every entity's deseasonalised level: same values, nearly the same spectrum."""
    rows = clean.deseasonalise(P.hourly(spark, d).withColumn("season", F.col("pos") % 24), E, "season", "level", None).where("level IS NOT NULL")

    def run(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("pos")
        name = str(frame["entity"].iloc[0])
        made = crossmap.surrogates(frame["level"].to_numpy(), 20, 100, np.random.default_rng(crossmap.edge_seed(name, "level")))
        return pd.DataFrame({"entity": name, "surrogate": np.repeat(np.arange(20), len(frame)), "pos": np.tile(frame["pos"].to_numpy(), 20), "value": made.ravel()})

    return rows.select("entity", "pos", "level").groupBy("entity").applyInPandas(run, "entity string, surrogate int, pos long, value double")


def edge_pairs(panel, variables, sizes):
    """(entity, cause, effect, size, tau, pos, x, y) of every ordered pair of variables; sizes: (entity, effect, size)."""
    long = panel.select("entity", "pos", F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in variables))).alias("v")).select("entity", "pos", "v.*")
    cause = long.select("entity", "pos", F.col("variable").alias("cause"), F.col("value").alias("x"))
    effect = long.select("entity", "pos", F.col("variable").alias("effect"), F.col("value").alias("y"))
    return cause.join(effect, ["entity", "pos"]).where("cause <> effect").join(sizes, ["entity", "effect"]).withColumn("tau", F.lit(1))


def tested_edges(spark, d):
    panel = P.monthly_positions(spark, d)
    variables = F.array(*(F.struct(F.lit(v).alias("effect"), F.col(v).alias("value")) for v in P.MONTHLY))
    long = panel.select("entity", "pos", F.explode(variables).alias("v")).select("entity", "pos", "v.*")
    skill = edm.simplex_skill(long, ["entity", "effect"], "pos", "value", list(DEFAULT.dimensions), DEFAULT.tau)
    sizes = durable(edm.choose_size(skill, ["entity", "effect"]))
    return crossmap.edge_tests(edge_pairs(panel, P.MONTHLY, sizes), E, "pos", DEFAULT)


@query()
def ccm_edge_test(spark, d):
    """Edge tests of all pairs of variables of the monthly panel, each effect embedded in the size that predicts it best, adjusted as one family."""
    return stats.causal_evidence(tested_edges(spark, d))


@query()
def coupled_map_edges(spark, d):
    """Both directions between two maps of which x drives y: x to y has evidence, y to x is rejected by its lag."""
    rows = spark.createDataFrame([(pos, x, y) for pos, x, y in P.coupled_maps()], "pos long, x double, y double")
    pairs = rows.select(F.lit("x").alias("cause"), F.lit("y").alias("effect"), "pos", "x", "y").union(rows.select(F.lit("y"), F.lit("x"), "pos", "y", "x"))
    pairs = pairs.withColumns({"entity": F.lit("maps"), "size": F.lit(4), "tau": F.lit(1)})
    return stats.causal_evidence(crossmap.edge_tests(pairs, E, "pos", DEFAULT))
