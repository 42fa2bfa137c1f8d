"""Single-command run: ``python -m surveylens --input raw.csv --out results --as-of-year 2025``."""

from __future__ import annotations

import argparse

from .plans.survey_run import run_all
from .session import build_session


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="surveylens")
    ap.add_argument("--input", required=True, help="raw survey table (CSV/TSV by default)")
    ap.add_argument("--format", default=None, help="parquet | json | csv (default: delimited)")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--as-of-year", type=int, required=True, help="year used to turn birth years into ages")
    ap.add_argument("--iso", default=None, help="country dimension file (alpha2, alpha3, name, continent); default: built in")
    ap.add_argument("--world", default=None, help="GeoJSON boundary file for the choropleth table")
    ap.add_argument("--no-models", action="store_true", help="skip the forest/boosting fits")
    ap.add_argument("--rf-trees", type=int, default=500)
    ap.add_argument("--rf-depth", type=int, default=30)
    ap.add_argument("--stage-to", default=None, help="write the analysis table here and read it back")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    paths = run_all(spark, a.input, a.out, a.as_of_year, a.iso, a.world, a.format,
                    not a.no_models, a.rf_trees, a.rf_depth, a.stage_to)
    for name, path in sorted(paths.items()):
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
