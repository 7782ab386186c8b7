"""Command line: run studies, configured studies and single queries, list what there is, or show a demonstration."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

#: The steps of a full study, each on its own: a failing step does not stop the others.
STUDY = ["q01_self_similarity", "q02_cross_dataset", "q02_ranking_agreement", "q03_perturbation_sensitivity", "q04_paired_shifts", "q04_paired_tests", "q01_self_similarity_full", "q02_cross_dataset_full", "q02_ranking_agreement_full", "q03_sensitivity_full", "q04_contrast_families", "q04_family_tests", "q05_bootstrap_stability", "q06_summary"]


def run_steps(spark: SparkSession, folder: str, steps: list[str], out: str | None) -> dict[str, str]:
    """Run steps and write each as CSV below ``out``, or show it; returns the problems by step."""
    from drift_atlas.plans import catalog

    queries, problems = catalog.queries(), {}
    for name in steps:
        try:
            rows = queries[name](spark, folder)
            if out:
                rows.write.mode("overwrite").option("header", "true").csv(f"{out}/{name}")
            else:
                rows.show(20, truncate=False)
        except Exception as problem:
            problems[name] = str(problem)
            print(f"{name} failed: {problem}", file=sys.stderr)
    return problems


def demo(spark: SparkSession) -> float:
    """Distance of two seeded random sets of vectors."""
    import numpy as np

    from drift_atlas.operators import distance, moments

    rng = np.random.Generator(np.random.PCG64(42))
    rows = [(s, k, (rng.normal(s * 0.5, 1, 64)).tolist()) for s in (0, 1) for k in range(100)]
    vectors = spark.createDataFrame(rows, "set_id long, row_id long, embedding array<double>")
    return distance.full_pairs(moments.full_moments(vectors)).first()["fmd"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="drift_atlas", description=__doc__)
    parser.add_argument("mode", choices=["study", "run", "query", "list", "demo"])
    parser.add_argument("names", nargs="*", help="queries to run, or steps of a configured study")
    parser.add_argument("--data", help="folder of the tables; for run, the table of vectors")
    parser.add_argument("--config", help="TOML or JSON file of a configured study")
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    if args.mode == "list":
        from drift_atlas.plans import catalog

        print("\n".join(sorted(catalog.queries())))
        return 0
    if args.mode in ("study", "query") and not args.data:
        parser.error("--data names the folder of the tables")
    if args.mode == "run" and not (args.data and args.config and args.out):
        parser.error("run takes --data, --config and --out")
    spark = SparkSession.builder.appName("drift_atlas").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.mode == "demo":
        print(f"{demo(spark):.6f}")
        return 0
    if args.mode == "run":
        from drift_atlas.operators import compiled

        report = compiled.Study(compiled.load(args.config), spark.read.parquet(args.data), args.out).run(args.names)
        print("\n".join(" ".join(filter(None, (r["status"], r["step"], r["dataset"], r["configuration"], r["problem"]))) for r in report))
        return int(any(r["status"] in ("failed", "blocked") for r in report))
    return int(bool(run_steps(spark, args.data, STUDY if args.mode == "study" else args.names, args.out)))


if __name__ == "__main__":
    sys.exit(main())
