"""python -m tscausal STAGE --stations CSV --drivers CSV --out FOLDER: the stages of an analysis, each resumable."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from ..params import DEFAULT
from ..sources.files import LEVELS, read_csv
from . import edges, forecasts

DRIVERS = "entity string, month date, variable string, value double"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tscausal", description=__doc__)
    parser.add_argument("stage", choices=["panel", "embed", "within", "between", "forecast", "all"])
    parser.add_argument("--stations", required=True, help="CSV: entity, station, month, value")
    parser.add_argument("--drivers", required=True, help="CSV: entity, month, variable, value")
    parser.add_argument("--out", required=True, help="folder for Parquet results")
    parser.add_argument("--surrogates", type=int, default=DEFAULT.surrogates)
    parser.add_argument("--horizon", type=int, default=DEFAULT.horizon)
    args = parser.parse_args(argv)
    params = replace(DEFAULT, surrogates=args.surrogates, horizon=args.horizon)
    spark = SparkSession.builder.appName("tscausal").getOrCreate()
    stages = ["panel", "embed", "within", "between", "forecast"] if args.stage == "all" else [args.stage]

    def read(name):
        return spark.read.parquet(f"{args.out}/{name}")

    def write(df, name):
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")

    if "panel" in stages:
        write(edges.entity_panel(read_csv(spark, args.stations, LEVELS), read_csv(spark, args.drivers, DRIVERS), params), "panel")
    if "embed" in stages:
        write(edges.embedding_sizes(read("panel"), params), "sizes")
    if "within" in stages:
        write(edges.run(edges.within_pairs(read("panel"), read("sizes")), ["entity"], f"{args.out}/within_shards", params), "within")
    if "between" in stages:
        write(edges.run(edges.between_pairs(read("panel"), read("sizes"), params), ["scope"], f"{args.out}/between_shards", params), "between")
    if "forecast" in stages:
        panel = edges.usable_variables(read("panel"), params)
        drivers = sorted(r.variable for r in panel.where("variable <> 'level'").select("variable").distinct().collect())
        for name, df in forecasts.run(panel, read("within"), read("sizes"), drivers, params=params).items():
            write(df, f"forecast_{name}")


if __name__ == "__main__":
    main()
