"""The studies in the embeddings' own dimension.

Vectors come as (configuration, set_id, row_id, embedding); a configuration may have a
dimension of its own. All distances are Fréchet distances of full covariances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.operators import distance as dist
from drift_atlas.operators import hypothesis as hyp
from drift_atlas.operators import moments as mom
from drift_atlas.operators import relations as rel
from drift_atlas.operators import resample as rs
from drift_atlas.operators import resampled
from drift_atlas.operators.resampled import Plan

#: Pairs of datasets below which two rankings are not compared, and from which the comparison is called interpretable.
LEAST_PAIRS, INTERPRETABLE_PAIRS = 6, 10


def _same(*keys: str):
    test = F.lit(True)
    for k in keys:
        test = test & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return test


def self_similarity(vectors: DataFrame, least: int = rel.LEAST_FILES) -> DataFrame:
    """Distance of two random halves of every set that has enough files, under every configuration."""
    keys = ["configuration", "set_id"]
    halves = rs.split_half(rel.with_enough(vectors, keys, least), "h", keys)
    m = mom.full_moments(halves, ("configuration", "set_id", "half"))
    out = dist.full_distances(m.where("half = 0"), m.where("half = 1"), _same(*keys), {"set_id": "dataset", "configuration": "configuration"}, {k: f"__{k}" for k in keys})
    return out.select("dataset", "configuration", F.col("a_n").alias("n_samples_per_half"), F.col("fmd").alias("split_half_fmd"))


def cross_distances(vectors: DataFrame) -> DataFrame:
    """Distance of all pairs of sets within every configuration."""
    m = mom.full_moments(vectors, ("configuration", "set_id"))
    test = _same("configuration") & (F.col("a_set_id") < F.col("b_set_id"))
    out = dist.full_distances(m, m, test, {"configuration": "configuration", "set_id": "dataset_a"}, {"configuration": "__c", "set_id": "dataset_b"})
    return out.select("configuration", "dataset_a", "dataset_b", F.concat_ws("_vs_", "dataset_a", "dataset_b").alias("pair"), "fmd")


def ranking_agreement(distances: DataFrame) -> DataFrame:
    """Rank correlation of the pairs' distances between every two configurations."""
    x, y = (distances.select("pair", F.col("configuration").alias(f"config_{s}"), F.col("fmd").alias(f"f{s}")) for s in "ab")
    met = x.join(y, "pair").where("config_a < config_b")
    out = hyp.spearman(met, ["config_a", "config_b"], "fa", "fb").where(F.col("n_pairs") >= LEAST_PAIRS)
    return out.select("config_a", "config_b", F.col("rho").alias("spearman_tau"), "n_pairs", (F.col("n_pairs") >= INTERPRETABLE_PAIRS).alias("interpretable"))


def noise_floor(vectors: DataFrame, reps: int) -> DataFrame:
    """Mean and 97.5th percentile of the distances of so many random splits of every set."""
    out = resampled.distances(vectors.withColumn("side", F.lit(0)), ["configuration", "set_id"], Plan("halves", reps, "floor"))
    return out.groupBy("configuration", "set_id").agg(F.avg("fmd").alias("noise_floor_mean"), F.percentile("fmd", 0.975).alias("noise_floor_ci_upper"))


def _two_sides(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return first.select(*keys, "row_id", "embedding", F.lit(0).alias("side")).unionByName(second.select(*keys, "row_id", "embedding", F.lit(1).alias("side")))


def interval(fmd: str = "fmd") -> list:
    """Mean and the 95 % interval of resampled distances."""
    return [F.avg(fmd).alias("fmd_boot_mean"), F.percentile(fmd, 0.025).alias("fmd_ci_lower"), F.percentile(fmd, 0.975).alias("fmd_ci_upper")]


def perturbation_interval(original: DataFrame, changed: DataFrame, reps: int, keys: list[str]) -> DataFrame:
    """Interval of the distance under independent draws with replacement from both versions of every set."""
    out = resampled.distances(_two_sides(original, changed, keys), keys, Plan("drawn", reps, "interval"))
    return out.groupBy(*keys).agg(*interval())


def permutation_p(original: DataFrame, changed: DataFrame, seen: DataFrame, reps: int, keys: list[str]) -> DataFrame:
    """Add-one share of relabelled distances that reach the one that was seen (the keys, fmd)."""
    drawn = resampled.distances(_two_sides(original, changed, keys), keys, Plan("relabelled", reps, "permutation"))
    met = drawn.join(seen.select(*keys, F.col("fmd").alias("__seen")), keys)
    return met.groupBy(*keys).agg(((F.count_if(F.col("fmd") >= F.col("__seen")) + 1) / (F.count("fmd") + 1)).alias("perm_p_value"))


def sensitivity(original: DataFrame, changed: DataFrame, floor_reps: int, boot_reps: int, perm_reps: int) -> DataFrame:
    """Distance of every set to its changed versions: floor, interval, signal-to-noise ratio, permutation p and verdict.

    ``changed`` also has ``perturbation``; every version is tested against the whole
    original set. A set whose floor is too small to divide by has no ratio and is not
    detected.
    """
    keys, all_keys = ["configuration", "set_id"], ["configuration", "set_id", "perturbation"]
    a, b = mom.full_moments(original, tuple(keys)), mom.full_moments(changed, tuple(all_keys))
    moved = dist.full_distances(a, b, _same(*keys), {k: f"__{k}" for k in keys}, {k: k for k in all_keys}).select(*all_keys, "fmd", "a_n", "b_n")
    every = resampled.sized_join(original, changed.select(*all_keys).distinct(), keys)  # an original set once for each of its few versions
    met = moved.join(noise_floor(original, floor_reps), keys)
    met = met.join(perturbation_interval(every, changed, boot_reps, all_keys), all_keys).join(permutation_p(every, changed, moved, perm_reps, all_keys), all_keys)
    snr = F.when(F.col("noise_floor_mean") > 1e-12, F.col("fmd") / F.col("noise_floor_mean"))
    seen = F.coalesce((F.col("perm_p_value") < 0.05) & (snr >= 1.0), F.lit(False))
    return met.select(
        F.col("set_id").alias("dataset"), "configuration", "perturbation", F.col("fmd").alias("fmd_vs_original"), "fmd_boot_mean", "fmd_ci_lower", "fmd_ci_upper",
        "noise_floor_mean", "noise_floor_ci_upper", snr.alias("snr"), (F.col("fmd") > F.col("noise_floor_ci_upper")).alias("above_floor"), "perm_p_value", seen.alias("significant"), F.col("a_n").alias("n_original"), F.col("b_n").alias("n_perturbed"),
    )


def bootstrap_stability(first: DataFrame, second: DataFrame, reps: int, cap: int) -> DataFrame:
    """Mean, deviation, interval and variation of the distance of two sets under draws of at most ``cap`` rows, by configuration."""
    keys = ["configuration"]
    rows = _two_sides(first, second, keys)
    sizes = rows.groupBy(*keys).agg(*[F.least(F.count_if(F.col("side") == k), F.lit(cap)).alias(f"sample_size_{n}") for k, n in ((0, "a"), (1, "b"))])
    mean, std = F.avg("fmd"), F.stddev_pop("fmd")
    out = resampled.distances(rows, keys, Plan("drawn", reps, "stability", cap)).groupBy(*keys).agg(
        F.count("fmd").alias("n_resamples"), mean.alias("fmd_mean"), std.alias("fmd_std"), F.percentile("fmd", 0.025).alias("fmd_ci_lower"), F.percentile("fmd", 0.975).alias("fmd_ci_upper"), (std / F.greatest(mean, F.lit(1e-8))).alias("cv"))
    return out.join(sizes, keys)


# Paired contrasts -----------------------------------------------------------

RETEST = "__retest__"


def complete_shifts(original: DataFrame, conditions: DataFrame, least: int = rel.LEAST_FILES) -> DataFrame:
    """Cosine shift of every file under every condition, for the files that have all of a configuration's conditions.

    Configurations of a set with fewer than ``least`` such files are left out.
    """
    keys = ["configuration", "set_id", "row_id"]
    wanted = conditions.select("configuration", "condition").distinct().groupBy("configuration").agg(F.count("*").alias("wanted"))
    have = conditions.join(original.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count_distinct("condition").alias("have"))
    whole = have.join(wanted, "configuration").where("have = wanted").select(*keys)
    whole = rel.with_enough(whole, ["configuration", "set_id"], least)
    met = original.join(conditions.withColumnRenamed("embedding", "changed"), keys).join(whole, keys, "left_semi")
    return met.select(*keys, "condition", F.round(dist.cosine_distance(F.col("embedding"), F.col("changed"), dist.PAIRED_EPS), 9).alias("shift"))


def contrast_pairs(shifts: DataFrame, first: str, second: str, control: tuple[str, str], least: int = rel.LEAST_FILES) -> DataFrame:
    """The paired values of three families: set_id, contrast, configuration, perturbation, row_id, a, b.

    Every perturbation against the retest; one perturbation against another; and, of
    two configurations, the excess of the first perturbation over the retest, for sets
    with ``least`` such files. A file's shifts are few and meet in one row.
    """
    entry = F.struct("configuration", "condition", "shift")
    files = shifts.groupBy("set_id", "row_id").agg(F.collect_list(entry).alias("all"))
    name = lambda x: F.concat_ws("|", x["configuration"], x["condition"])
    files = files.withColumn("of", F.map_from_entries(F.transform("all", lambda x: F.struct(name(x), x["shift"]))))

    def shift(configuration, condition):
        return F.try_element_at("of", F.concat_ws("|", configuration, F.lit(condition)))

    def row(contrast: str, configuration, perturbation, a, b):
        return F.struct(F.lit(contrast).alias("contrast"), configuration.alias("configuration"), perturbation.alias("perturbation"), a.alias("a"), b.alias("b"))

    noise = F.transform(F.filter("all", lambda x: x["condition"] != RETEST), lambda x: row("exceeds_retest_noise", x["configuration"], x["condition"], x["shift"], shift(x["configuration"], RETEST)))
    other = F.transform(F.filter("all", lambda x: x["condition"] == first), lambda x: row(f"{first}_gt_{second}", x["configuration"], F.lit(first), x["shift"], shift(x["configuration"], second)))
    excess = [F.round(shift(F.lit(c), first) - shift(F.lit(c), RETEST), 9) for c in control]
    held = F.array(row(f"control_{control[0]}_gt_{control[1]}_{first}_excess", F.lit("_vs_".join(control)), F.lit(first), *excess))
    pairs = files.select("set_id", "row_id", F.inline(F.concat(noise, other, held))).where("a is not null and b is not null")
    few = pairs.where(F.col("contrast").startswith("control_")).groupBy("set_id", "contrast").count().where(F.col("count") < least)
    return pairs.join(few.drop("count"), ["set_id", "contrast"], "left_anti")


def contrast_statistics(pairs: DataFrame) -> DataFrame:
    """Medians and the one-sided signed-rank statistic of every contrast."""
    keys = ["set_id", "contrast", "configuration", "perturbation"]
    medians = pairs.groupBy(*keys).agg(F.median("a").alias("median_shift"), F.median("b").alias("median_ref"))
    return medians.join(hyp.signed_rank(pairs, keys), keys)


def contrast_tests(pairs: DataFrame) -> DataFrame:
    """The statistics with raw p-values and Holm's over all families of a set."""
    out = contrast_statistics(pairs).withColumn("p_raw", hyp.signed_rank_p("n", "n_nonzero", "ties", "stat", "z"))
    return hyp.holm(out, "p_raw", ["set_id"], ["contrast", "configuration", "perturbation"])
