"""The studies on whole vectors, and the paired contrasts over configurations."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from drift_atlas.operators import study
from drift_atlas.plans import distance_queries as dq
from drift_atlas.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def pipelines(vectors):
    """Three pipelines of different dimension: the whole vector and its halves."""
    cuts = (("whole", 1, 64), ("lower", 1, 32), ("upper", 33, 32))
    some = F.array(*[F.struct(F.lit(n).alias("configuration"), F.slice("embedding", first, size).alias("embedding")) for n, first, size in cuts])
    return vectors.select("set_id", "row_id", F.explode(some).alias("c")).select("set_id", "row_id", "c.configuration", "c.embedding")


def _vectors(spark, sf):
    return pipelines(fx.embedding_sets(spark, sf))


def _shown(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("q01_self_similarity_full")
def q01_full(spark, sf):
    return _shown(study.self_similarity(_vectors(spark, sf)), "split_half_fmd")


@query("q02_cross_dataset_full")
def q02_full(spark, sf):
    return _shown(study.cross_distances(_vectors(spark, sf)), "fmd")


@query("q02_ranking_agreement_full")
def q02_agreement_full(spark, sf):
    return _shown(study.ranking_agreement(study.cross_distances(_vectors(spark, sf))), "spearman_tau")


def _versions(spark, sf):
    """The sets and their perturbed version, under every pipeline."""
    sets = fx.embedding_sets(spark, sf)
    return pipelines(sets), pipelines(dq.perturbed(sets)).withColumn("perturbation", F.lit("halved"))


@query("q03_sensitivity_full")
def q03_full(spark, sf):
    """Distance, interval, floor, ratio, permutation p and verdict on whole vectors."""
    out = study.sensitivity(*_versions(spark, sf), dq.FLOOR_REPS, dq.BOOT_REPS, dq.PERM_REPS)
    return _shown(out, "fmd_vs_original", "fmd_boot_mean", "fmd_ci_lower", "fmd_ci_upper", "noise_floor_mean", "noise_floor_ci_upper", "snr", "perm_p_value")


@query("r04_perturbation_bootstrap_full")
def r04_full(spark, sf):
    original, changed = _versions(spark, sf)
    return _shown(study.perturbation_interval(original, changed, dq.BOOT_REPS, ["configuration", "set_id"]), "fmd_boot_mean", "fmd_ci_lower", "fmd_ci_upper")


@query("q05_bootstrap_stability_full")
def q05_full(spark, sf):
    """Stability of the distance of one pair of sets on whole vectors, under every pipeline."""
    vectors = _vectors(spark, sf)
    out = study.bootstrap_stability(vectors.where("set_id = 0"), vectors.where("set_id = 1"), dq.STABILITY_REPS, 500)
    return _shown(out, "fmd_mean", "fmd_std", "fmd_ci_lower", "fmd_ci_upper", "cv")


# Paired contrasts -----------------------------------------------------------


def _pairs(spark, sf):
    """Conditions of every file under two pipelines; a part of the files lacks one condition."""
    sets = fx.embedding_sets(spark, sf)
    changed = dq.changed_twice(sets).where("not (condition = 'dropped' and row_id % 11 = 3)")
    cuts = F.array(*[F.struct(F.lit(n).alias("configuration"), F.slice("embedding", k, 32).alias("embedding")) for n, k in (("lower", 1), ("upper", 33))])
    conditions = changed.select("set_id", "row_id", "condition", F.inline(cuts))
    shifts = study.complete_shifts(sets.select("set_id", "row_id", F.inline(cuts)), conditions)
    # The statistics read the pairs several times; they are numbers only.
    return study.contrast_pairs(shifts, "halved", "dropped", ("lower", "upper")).persist(StorageLevel.DISK_ONLY)


_FAMILIES = f"""WITH {fx.SETS_CTE}, c0 AS (SELECT '__retest__' AS condition, set_id, row_id, v FROM e UNION ALL SELECT 'halved', set_id, row_id, {dq._PV} FROM e
  UNION ALL SELECT 'dropped', set_id, row_id, list_transform(range(len(v)), lambda i: CASE WHEN i < 4 THEN CAST(0 AS DOUBLE) ELSE v[i + 1] END) FROM e WHERE row_id % 11 <> 3),
ok AS (SELECT set_id, row_id FROM c0 GROUP BY set_id, row_id HAVING count(DISTINCT condition) = 3),
en AS (SELECT set_id FROM ok GROUP BY set_id HAVING count(*) >= 10),
p AS (SELECT set_id, row_id, 'lower' AS configuration, list_slice(v, 1, 32) AS v FROM e UNION ALL SELECT set_id, row_id, 'upper', list_slice(v, 33, 64) FROM e),
q AS (SELECT condition, set_id, row_id, 'lower' AS configuration, list_slice(v, 1, 32) AS v FROM c0 UNION ALL SELECT condition, set_id, row_id, 'upper', list_slice(v, 33, 64) FROM c0),
sh AS (SELECT q.condition, q.configuration, q.set_id, q.row_id, round({dq._COS('p', 'q', '1e-12')}, 9) AS shift FROM p JOIN q ON p.set_id = q.set_id AND p.row_id = q.row_id AND p.configuration = q.configuration
  JOIN ok ON ok.set_id = q.set_id AND ok.row_id = q.row_id WHERE q.set_id IN (SELECT set_id FROM en)),
w AS (SELECT configuration, set_id, row_id, max(shift) FILTER (WHERE condition = '__retest__') AS rest, max(shift) FILTER (WHERE condition = 'halved') AS halved, max(shift) FILTER (WHERE condition = 'dropped') AS dropped FROM sh GROUP BY configuration, set_id, row_id),
x AS (SELECT configuration, set_id, row_id, round(halved - rest, 9) AS excess FROM w),
pc AS (SELECT set_id, 'exceeds_retest_noise' AS contrast, configuration, 'halved' AS perturbation, halved AS a, rest AS b FROM w
  UNION ALL SELECT set_id, 'exceeds_retest_noise', configuration, 'dropped', dropped, rest FROM w
  UNION ALL SELECT set_id, 'halved_gt_dropped', configuration, 'halved', halved, dropped FROM w
  UNION ALL SELECT x.set_id, 'control_lower_gt_upper_halved_excess', 'lower_vs_upper', 'halved', x.excess, y.excess FROM x JOIN x y ON x.set_id = y.set_id AND x.row_id = y.row_id AND x.configuration = 'lower' AND y.configuration = 'upper'),
md AS (SELECT set_id, contrast, configuration, perturbation, count(*) AS n_files, median(a) AS ma, median(b) AS mb FROM pc GROUP BY ALL),
nz AS (SELECT *, a - b AS d, abs(a - b) AS ad FROM pc WHERE a <> b),
rk AS (SELECT *, rank() OVER (PARTITION BY set_id, contrast, configuration, perturbation ORDER BY ad) + (count(*) OVER (PARTITION BY set_id, contrast, configuration, perturbation, ad) - 1) / CAST(2 AS DOUBLE) AS r FROM nz),
ag AS (SELECT set_id, contrast, configuration, perturbation, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS stat FROM rk GROUP BY ALL)
SELECT md.set_id AS dataset, md.contrast, md.configuration, md.perturbation, n_files, round(ma, 6) AS median_shift, round(mb, 6) AS median_ref, round(coalesce(stat, 0), 6) AS wilcoxon_stat
FROM md LEFT JOIN ag ON md.set_id = ag.set_id AND md.contrast = ag.contrast AND md.configuration = ag.configuration AND md.perturbation = ag.perturbation"""


@query("q04_contrast_families", _FAMILIES)
def q04_families(spark, sf):
    """Medians and signed-rank statistics of all three families of contrasts."""
    out = study.contrast_statistics(_pairs(spark, sf))
    return out.select(F.col("set_id").alias("dataset"), "contrast", "configuration", "perturbation", F.col("n").alias("n_files"), F.round("median_shift", 6).alias("median_shift"), F.round("median_ref", 6).alias("median_ref"), F.round("stat", 6).alias("wilcoxon_stat"))


@query("q04_family_tests")
def q04_family_tests(spark, sf):
    """Raw and Holm-adjusted p-values over all families of a dataset."""
    out = study.contrast_tests(_pairs(spark, sf))
    return out.select(F.col("set_id").alias("dataset"), "contrast", "configuration", "perturbation", "stat", "p_raw", "p_holm", (F.col("p_holm") < 0.05).alias("significant"))
