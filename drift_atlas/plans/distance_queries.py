"""Queries of the moments, distance, resampling and test families, and the composite studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drift_atlas.operators import distance as dist
from drift_atlas.operators import hausdorff
from drift_atlas.operators import hypothesis as hyp
from drift_atlas.operators import moments as mom
from drift_atlas.operators import relations as rel
from drift_atlas.operators import order, pairwise
from drift_atlas.operators import resample as rs
from drift_atlas.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLOOR_REPS, BOOT_REPS, PERM_REPS = 100, 100, 200
STABILITY_REPS = 50


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {fx.SETS_CTE}{sql}"
        return f

    return add


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return fx.embedding_sets(spark, sf)


def _plane(spark: SparkSession, sf: str) -> DataFrame:
    return fx.plane(_sets(spark, sf))


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _moments_sql(source: str, keys: str, x: str = "x", y: str = "y") -> str:
    cov = lambda a, b: f"coalesce(covar_samp({a}, {b}), 0)"
    return f"SELECT {keys}, count(*) AS n, avg({x}) AS mx, avg({y}) AS my, {cov(x, x)} AS cxx, {cov(x, y)} AS cxy, {cov(y, y)} AS cyy FROM {source} GROUP BY {keys}"


_MO = f", mo AS ({_moments_sql('e', 'set_id')})"
_FR = dist.frechet_sql("a.", "b.")
_PAIR = f"{_MO}, pr AS (SELECT a.set_id AS a, b.set_id AS b, {_FR} AS fmd FROM mo a JOIN mo b ON a.set_id < b.set_id)"
_BOTH = f"{_PAIR}, sym AS (SELECT a, b, fmd FROM pr UNION ALL SELECT b, a, fmd FROM pr)"
_EL = f", el AS (SELECT set_id, row_id, unnest(range(64)) AS i, unnest(v) AS val FROM e)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dist.plane_pairs(mom.plane_moments(_plane(spark, sf), ["set_id"]))


@query("a01_mean_vector", f"{_EL} SELECT set_id, i, round(avg(val), 6) AS mean FROM el GROUP BY set_id, i")
def a01(spark, sf):
    return _round(mom.mean_vector(_sets(spark, sf)), "mean")


def _cov_sql(ridge: str) -> str:
    return f"{_EL} SELECT p.set_id, p.i, q.i AS j, round(coalesce(covar_samp(p.val, q.val), 0){ridge}, 6) AS cov FROM el p JOIN el q ON p.set_id = q.set_id AND p.row_id = q.row_id AND p.i <= q.i GROUP BY p.set_id, p.i, q.i"


@query("a02_covariance", _cov_sql(""))
def a02(spark, sf):
    return _round(mom.covariance(_sets(spark, sf)), "cov")


@query("a03_ridge", _cov_sql(" + CASE WHEN p.i = q.i THEN CAST(0.0001 AS DOUBLE) ELSE 0 END"))
def a03(spark, sf):
    return _round(mom.covariance(_sets(spark, sf), mom.RIDGE), "cov")


@query("a04_statistics", f"{_EL} SELECT set_id, i, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, count(*) AS n FROM el GROUP BY set_id, i")
def a04(spark, sf):
    return _round(mom.vector_statistics(_sets(spark, sf)), "mean", "std")


@query("a05_batch_summary", f"{_PAIR} SELECT round(avg(fmd), 6) AS mean, round(median(fmd), 6) AS median, round(stddev_pop(fmd), 6) AS std, round(max(fmd), 6) AS max, round(min(fmd), 6) AS min FROM pr")
def a05(spark, sf):
    return _round(dist.batch_summary(_pairs(spark, sf)), "mean", "median", "std", "max", "min")


@query("m01_frechet_distance", f"{_PAIR} SELECT a, b, round(fmd, 6) AS fmd FROM pr")
def m01(spark, sf):
    return _round(_pairs(spark, sf), "fmd")


@query("m01_frechet_diagonal", f"{_EL}, st AS (SELECT set_id, i, avg(val) AS m, coalesce(stddev_samp(val), 0) AS s FROM el GROUP BY set_id, i) SELECT a.set_id AS a, b.set_id AS b, round(sum((a.m - b.m) * (a.m - b.m) + (a.s - b.s) * (a.s - b.s)), 6) AS fmd FROM st a JOIN st b ON a.i = b.i AND a.set_id < b.set_id GROUP BY a.set_id, b.set_id")
def m01_diagonal(spark, sf):
    return _round(dist.diagonal_pairs(_sets(spark, sf)), "fmd")


@query("m01_frechet_full")
def m01_full(spark, sf):
    """Full-dimensional distance of all pairs of sets."""
    return _round(dist.full_pairs(mom.full_moments(_sets(spark, sf))), "fmd")


_MEAN, _TRACE = dist.frechet_terms("a.", "b.")


@query("m02_mean_term", f"{_MO} SELECT a.set_id AS a, b.set_id AS b, round({_MEAN}, 6) AS mean_term FROM mo a JOIN mo b ON a.set_id < b.set_id")
def m02(spark, sf):
    vectors = _plane(spark, sf).groupBy("set_id").agg(F.array(F.avg("x"), F.avg("y")).alias("mu"))
    a, b = vectors.alias("a"), vectors.alias("b")
    gap = F.zip_with(F.col("a.mu"), F.col("b.mu"), lambda x, y: (x - y) * (x - y))
    met = a.join(b, F.col("a.set_id") < F.col("b.set_id"))
    return met.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), F.round(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x), 6).alias("mean_term"))


@query("m03_trace_term", f"{_MO} SELECT a.set_id AS a, b.set_id AS b, round({_TRACE}, 6) AS trace_term FROM mo a JOIN mo b ON a.set_id < b.set_id")
def m03(spark, sf):
    moments = mom.plane_moments(_plane(spark, sf), ["set_id"])
    a, b = dist.side(moments, "a_", "set_id"), dist.side(moments, "b_", "set_id")
    trace = F.expr(dist.frechet_terms("a_", "b_")[1])
    return a.join(b, F.col("a_set_id") < F.col("b_set_id")).select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"), F.round(trace, 6).alias("trace_term"))


@query("m04_eigenvalue_trace")
def m04(spark, sf):
    """Trace of the root of the product of two covariances, from eigenvalues clipped at 0."""
    return _round(dist.root_traces(mom.full_moments(_sets(spark, sf))), "root_trace")


_DIST = "sqrt(list_sum(list_transform(range(len(p.v)), lambda i: (p.v[i + 1] - q.v[i + 1]) * (p.v[i + 1] - q.v[i + 1]))))"


@query("m05_hausdorff", f""", d AS (SELECT p.set_id AS a, q.set_id AS b, p.row_id AS r, q.row_id AS s, {_DIST} AS d FROM e p JOIN e q ON p.set_id < q.set_id),
f AS (SELECT a, b, min(d) AS m FROM d GROUP BY a, b, r), g AS (SELECT a, b, min(d) AS m FROM d GROUP BY a, b, s)
SELECT a, b, round(max(m), 6) AS hausdorff FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY a, b""")
def m05(spark, sf):
    return _round(hausdorff.hausdorff_pairs(_sets(spark, sf)), "hausdorff")


QUERIES["a18_minmax_reduction"], SQL["a18_minmax_reduction"] = QUERIES["m05_hausdorff"], SQL["m05_hausdorff"]


@query("m06_batch_distance", f"{_MO} SELECT a.set_id AS a, b.set_id AS b, round({_FR}, 6) AS fmd FROM mo a JOIN mo b ON true")
def m06(spark, sf):
    pairs = dist.plane_pairs(mom.plane_moments(_plane(spark, sf), ["set_id"]), inclusive=True)
    return _round(dist.mirrored(pairs), "fmd")


@query("m07_rank_by_distance", f"{_BOTH} SELECT a AS ref, b AS set_id, row_number() OVER (PARTITION BY a ORDER BY fmd, b) AS place, round(fmd, 6) AS fmd FROM sym")
def m07(spark, sf):
    return _round(dist.rank_by_distance(_pairs(spark, sf)), "fmd")


QUERIES["o02_argsort_ranking"], SQL["o02_argsort_ranking"] = QUERIES["m07_rank_by_distance"], SQL["m07_rank_by_distance"]


@query("m08_ranking_stability", f"""{_BOTH}, k AS (SELECT a AS ranking, b AS item, row_number() OVER (PARTITION BY a ORDER BY fmd, b) AS place FROM sym),
o AS (SELECT p.ranking, p.item AS i, q.item AS j, p.place < q.place AS less FROM k p JOIN k q ON p.ranking = q.ranking AND p.item < q.item),
s AS (SELECT avg(CASE WHEN x.less = y.less THEN 1 ELSE 0 END) AS score FROM o x JOIN o y ON x.i = y.i AND x.j = y.j AND x.ranking < y.ranking GROUP BY x.ranking, y.ranking)
SELECT round(coalesce(avg(score), 1), 6) AS stability FROM s""")
def m08(spark, sf):
    ranks = dist.rank_by_distance(_pairs(spark, sf)).select(F.col("ref").alias("ranking"), F.col("set_id").alias("item"), "place")
    return _round(dist.ranking_stability(ranks), "stability")


@query("m09_self_distance", f"{_MO} SELECT a.set_id, round({_FR}, 6) AS fmd FROM mo a JOIN mo b ON a.set_id = b.set_id")
def m09(spark, sf):
    pairs = dist.plane_pairs(mom.plane_moments(_plane(spark, sf), ["set_id"]), inclusive=True)
    return _round(pairs.where("a = b").select(F.col("a").alias("set_id"), "fmd"), "fmd")


@query("m10_compare_models", f"{_PAIR} SELECT concat('set', a, '_vs_set', b) AS pair, round(fmd, 6) AS fmd FROM pr")
def m10(spark, sf):
    return _round(_pairs(spark, sf).select(F.concat(F.lit("set"), "a", F.lit("_vs_set"), "b").alias("pair"), "fmd"), "fmd")


def _two(spark, sf):
    rows = _sets(spark, sf)
    return rows.where("set_id = 0"), rows.where("set_id = 1")


@query("m11_pairwise_euclidean", f" SELECT p.row_id AS row_a, q.row_id AS row_b, round({_DIST}, 6) AS distance FROM e p, e q WHERE p.set_id = 0 AND q.set_id = 1")
def m11(spark, sf):
    return _round(pairwise.pairwise_distances(*_two(spark, sf)), "distance")


_DOT = lambda p, q: f"list_sum(list_transform(range(len({p}.v)), lambda i: {p}.v[i + 1] * {q}.v[i + 1]))"
_COS = lambda p, q, e: f"1 - {_DOT(p, q)} / ((sqrt({_DOT(p, p)}) + CAST({e} AS DOUBLE)) * (sqrt({_DOT(q, q)}) + CAST({e} AS DOUBLE)))"


@query("m12_pairwise_cosine", f" SELECT p.row_id AS row_a, q.row_id AS row_b, round({_COS('p', 'q', '1e-8')}, 6) AS distance FROM e p, e q WHERE p.set_id = 0 AND q.set_id = 1")
def m12(spark, sf):
    return _round(pairwise.pairwise_distances(*_two(spark, sf), metric="cosine"), "distance")


QUERIES["j12_pairwise_cross"], SQL["j12_pairwise_cross"] = QUERIES["m11_pairwise_euclidean"], SQL["m11_pairwise_euclidean"]

#: A second version of every vector, with its first coordinate halved and the third dropped.
_PV = "list_transform(range(len(v)), lambda i: CASE WHEN i = 0 THEN v[1] * CAST(0.5 AS DOUBLE) WHEN i = 2 THEN CAST(0 AS DOUBLE) ELSE v[i + 1] END)"


def perturbed(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i == 0, x * 0.5).when(i == 2, F.lit(0.0)).otherwise(x)))


def cosine_shifts(original: DataFrame, changed: DataFrame) -> DataFrame:
    """Cosine distance of each file's vector to its changed version."""
    other = changed.select("set_id", "row_id", F.col("embedding").alias("changed"))
    met = original.join(other, ["set_id", "row_id"])
    return met.select("set_id", "row_id", dist.cosine_distance(F.col("embedding"), F.col("changed"), dist.PAIRED_EPS).alias("shift"))


def corpus_scale(vectors: DataFrame) -> DataFrame:
    """Median cosine distance between distinct files of a set."""
    return order.median(order.PairDistances(vectors), "scale")


_SHIFT = f", c AS (SELECT set_id, row_id, v AS v, {_PV} AS w2 FROM e), p AS (SELECT set_id, row_id, v FROM c), q AS (SELECT set_id, row_id, w2 AS v FROM c), sh AS (SELECT p.set_id, p.row_id, {_COS('p', 'q', '1e-12')} AS shift FROM p JOIN q ON p.set_id = q.set_id AND p.row_id = q.row_id)"
_SCALE = f", sc AS (SELECT p.set_id, median({_COS('p', 'q', '1e-12')}) AS scale FROM e p JOIN e q ON p.set_id = q.set_id AND p.row_id < q.row_id GROUP BY p.set_id)"


@query("m13_cosine_shift", f"{_SHIFT} SELECT set_id, row_id, round(shift, 6) AS shift FROM sh")
def m13(spark, sf):
    rows = _sets(spark, sf)
    return _round(cosine_shifts(rows, perturbed(rows)), "shift")


@query("a11_corpus_scale", f"{_SCALE} SELECT set_id, round(scale, 6) AS scale FROM sc")
def a11(spark, sf):
    return _round(corpus_scale(_sets(spark, sf)), "scale")


@query("m14_normalized_shift", f"{_SHIFT}{_SCALE} SELECT sh.set_id, row_id, round(CASE WHEN scale > 1e-12 THEN shift / scale END, 6) AS normalized_shift FROM sh JOIN sc ON sh.set_id = sc.set_id")
def m14(spark, sf):
    rows = _sets(spark, sf)
    met = cosine_shifts(rows, perturbed(rows)).join(corpus_scale(rows), "set_id")
    return met.select("set_id", "row_id", F.round(F.when(F.col("scale") > 1e-12, F.col("shift") / F.col("scale")), 6).alias("normalized_shift"))


# Resampling -----------------------------------------------------------------

_KEY = lambda seed, *parts: "md5(concat_ws('|', '" + seed + "', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"
_REPS = lambda n: f"(SELECT unnest(range({n})) AS rep)"


@query("r01_seeded_sample", f" SELECT set_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {_KEY('s', 'row_id')}, row_id) AS k FROM e) WHERE k <= 10")
def r01(spark, sf):
    return rs.sample(_plane(spark, sf), 10, "s", ["set_id"], "row_id").select("set_id", "row_id")


QUERIES["s02_sampled_listing"], SQL["s02_sampled_listing"] = QUERIES["r01_seeded_sample"], SQL["r01_seeded_sample"]

_HALF = lambda source, keys, parts: f"""SELECT * FROM (SELECT *, CASE WHEN k <= floor(m / 2) THEN 0 WHEN k <= 2 * floor(m / 2) THEN 1 END AS half FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_KEY('h', *parts)}, row_id) AS k, count(*) OVER (PARTITION BY {keys}) AS m FROM {source})) WHERE half IS NOT NULL"""  # noqa: E731


@query("r02_split_half", f" SELECT set_id, row_id, CAST(half AS BIGINT) AS half FROM ({_HALF('e', 'set_id', ['row_id'])})")
def r02(spark, sf):
    return rs.split_half(_plane(spark, sf), "h", ["set_id"]).select("set_id", "row_id", "half")


def noise_floor(points: DataFrame, reps: int) -> DataFrame:
    """Split-half distances: set_id, rep, fmd."""
    halves = rs.split_half(points, "h", ["set_id"], reps=reps)
    met = dist.both_sides(mom.plane_moments(halves, ["set_id", "rep", "half"]), ["set_id", "rep"], "half")
    return met.select("set_id", "rep", F.expr(dist.frechet_sql("a_", "b_")).alias("fmd"))


def _floor_sql(reps: int) -> str:
    return f""", er AS (SELECT e.*, rep FROM e, {_REPS(reps)}), hv AS ({_HALF('er', 'set_id, rep', ['rep', 'row_id'])}), hm AS ({_moments_sql('hv', 'set_id, rep, half')}),
nf AS (SELECT a.set_id, a.rep, {_FR} AS fmd FROM hm a JOIN hm b ON a.set_id = b.set_id AND a.rep = b.rep AND a.half = 0 AND b.half = 1)"""


@query("r03_noise_floor", f"{_floor_sql(FLOOR_REPS)} SELECT set_id, rep, round(fmd, 6) AS fmd FROM nf")
def r03(spark, sf):
    return _round(noise_floor(_plane(spark, sf), FLOOR_REPS), "fmd")


@query("a09_noise_floor_summary", f"{_floor_sql(FLOOR_REPS)} SELECT set_id, round(avg(fmd), 6) AS noise_floor_mean, round(quantile_cont(fmd, 0.975), 6) AS noise_floor_ci_upper FROM nf GROUP BY set_id")
def a09(spark, sf):
    floor = noise_floor(_plane(spark, sf), FLOOR_REPS)
    return _round(floor_summary(floor), "noise_floor_mean", "noise_floor_ci_upper")


def floor_summary(floor: DataFrame) -> DataFrame:
    return floor.groupBy("set_id").agg(F.avg("fmd").alias("noise_floor_mean"), F.percentile("fmd", 0.975).alias("noise_floor_ci_upper"))


def changed_plane(points: DataFrame) -> DataFrame:
    """The planar stand-in of a perturbation: x shrunk, y shifted."""
    return points.withColumns({"x": F.col("x") * 0.5, "y": F.col("y") + 0.05})


_CH = ", ch AS (SELECT set_id, row_id, x * CAST(0.5 AS DOUBLE) AS x, y + CAST(0.05 AS DOUBLE) AS y FROM e)"


def _boot_sql(source: str, name: str, reps: int, seed: str, cap: str = "n") -> str:
    return f""", {name}_i AS (SELECT set_id, x, y, row_number() OVER (PARTITION BY set_id ORDER BY row_id) - 1 AS idx FROM {source}),
{name}_n AS (SELECT set_id, count(*) AS n FROM {source} GROUP BY set_id),
{name}_d AS (SELECT set_id, rep, n, unnest(range({cap})) AS j FROM {name}_n, {_REPS(reps)}),
{name}_k AS (SELECT set_id, rep, CAST('0x' || substr({_KEY(seed, 'set_id', 'rep', 'j')}, 1, 8) AS BIGINT) % n AS idx FROM {name}_d),
{name}_b AS (SELECT k.set_id, k.rep, i.x, i.y FROM {name}_k k JOIN {name}_i i ON k.set_id = i.set_id AND k.idx = i.idx),
{name} AS ({_moments_sql(f'{name}_b', 'set_id, rep')})"""


def perturbation_bootstrap(original: DataFrame, changed: DataFrame, reps: int) -> DataFrame:
    """Distances of independent resamples of both sets: set_id, rep, fmd."""
    a = dist.side(mom.plane_moments(rs.bootstrap(original, reps, "bo"), ["set_id", "rep"]), "a_", "set_id", "rep")
    b = dist.side(mom.plane_moments(rs.bootstrap(changed, reps, "bp"), ["set_id", "rep"]), "b_", "set_id", "rep")
    met = a.join(b, (F.col("a_set_id") == F.col("b_set_id")) & (F.col("a_rep") == F.col("b_rep")))
    return met.select(F.col("a_set_id").alias("set_id"), F.col("a_rep").alias("rep"), F.expr(dist.frechet_sql("a_", "b_")).alias("fmd"))


_PB = f"{_CH}{_boot_sql('e', 'bo', BOOT_REPS, 'bo')}{_boot_sql('ch', 'bp', BOOT_REPS, 'bp')}, pb AS (SELECT a.set_id, a.rep, {_FR} AS fmd FROM bo a JOIN bp b ON a.set_id = b.set_id AND a.rep = b.rep)"


@query("r04_perturbation_bootstrap", f"{_PB} SELECT set_id, rep, round(fmd, 6) AS fmd FROM pb")
def r04(spark, sf):
    points = _plane(spark, sf)
    return _round(perturbation_bootstrap(points, changed_plane(points), BOOT_REPS), "fmd")


def permutation_test(original: DataFrame, changed: DataFrame, reps: int) -> DataFrame:
    """Observed distance and add-one permutation p by set: set_id, fmd, perm_p_value."""
    pool = original.select(F.col("set_id").alias("pair"), F.concat(F.lit("a"), "row_id").alias("pooled_id"), "x", "y", F.lit(0).cast("long").alias("side"))
    pool = pool.unionByName(changed.select(F.col("set_id").alias("pair"), F.concat(F.lit("b"), "row_id").alias("pooled_id"), "x", "y", F.lit(1).cast("long").alias("side")))

    def distances(rows: DataFrame, keys: list[str]) -> DataFrame:
        met = dist.both_sides(mom.plane_moments(rows, [*keys, "side"]), keys, "side")
        return met.select(*keys, F.expr(dist.frechet_sql("a_", "b_")).alias("fmd"))

    seen = distances(pool, ["pair"]).withColumnRenamed("fmd", "observed")
    drawn = distances(rs.relabel(pool, reps, "pm", F.count_if(F.col("side") == 0)), ["pair", "rep"])
    out = drawn.join(seen, "pair").groupBy("pair", "observed").agg(((F.count_if(F.col("fmd") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("perm_p_value"))
    return out.select(F.col("pair").alias("set_id"), F.col("observed").alias("fmd"), "perm_p_value")


_PT = f"""{_CH}, po AS (SELECT set_id, 'a' || row_id AS pid, x, y, 0 AS side FROM e UNION ALL SELECT set_id, 'b' || row_id, x, y, 1 FROM ch),
pz AS (SELECT *, count(*) FILTER (WHERE side = 0) OVER (PARTITION BY set_id) AS na FROM po),
rl AS (SELECT set_id, rep, x, y, CASE WHEN row_number() OVER (PARTITION BY set_id, rep ORDER BY {_KEY('pm', 'rep', 'pid')}, pid) <= na THEN 0 ELSE 1 END AS side FROM pz, {_REPS(PERM_REPS)}),
om AS ({_moments_sql('po', 'set_id, side')}), rm AS ({_moments_sql('rl', 'set_id, rep, side')}),
ob AS (SELECT a.set_id, {_FR} AS observed FROM om a JOIN om b ON a.set_id = b.set_id AND a.side = 0 AND b.side = 1),
dr AS (SELECT a.set_id, a.rep, {_FR} AS fmd FROM rm a JOIN rm b ON a.set_id = b.set_id AND a.rep = b.rep AND a.side = 0 AND b.side = 1),
pt AS (SELECT dr.set_id, observed AS fmd, (count(*) FILTER (WHERE dr.fmd >= observed) + 1) / CAST(count(*) + 1 AS DOUBLE) AS perm_p_value FROM dr JOIN ob ON dr.set_id = ob.set_id GROUP BY dr.set_id, observed)"""


@query("r05_permutation_pvalue", f"{_PT} SELECT set_id, round(fmd, 6) AS fmd, round(perm_p_value, 6) AS perm_p_value FROM pt")
def r05(spark, sf):
    points = _plane(spark, sf)
    return _round(permutation_test(points, changed_plane(points), PERM_REPS), "fmd", "perm_p_value")


QUERIES["a17_permutation_exceedance"], SQL["a17_permutation_exceedance"] = QUERIES["r05_permutation_pvalue"], SQL["r05_permutation_pvalue"]


def bootstrap_pairs(points: DataFrame, reps: int, cap: int) -> DataFrame:
    """Distances of resamples of all pairs of sets: a, b, rep, fmd."""
    m = mom.plane_moments(rs.bootstrap(points, reps, "st", cap), ["set_id", "rep"])
    a, b = dist.side(m, "a_", "set_id", "rep"), dist.side(m, "b_", "set_id", "rep")
    met = a.join(b, (F.col("a_rep") == F.col("b_rep")) & (F.col("a_set_id") < F.col("b_set_id")))
    return met.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"), F.col("a_rep").alias("rep"), F.expr(dist.frechet_sql("a_", "b_")).alias("fmd"), F.col("a_n").alias("size_a"), F.col("b_n").alias("size_b"))


def stability_summary(resampled: DataFrame) -> DataFrame:
    """Mean, population deviation, interval and variation of resampled distances."""
    mean, std = F.avg("fmd"), F.stddev_pop("fmd")
    return resampled.groupBy("a", "b").agg(
        F.count("*").alias("n_resamples"), F.max("size_a").alias("sample_size_a"), F.max("size_b").alias("sample_size_b"), mean.alias("fmd_mean"), std.alias("fmd_std"),
        F.percentile("fmd", 0.025).alias("fmd_ci_lower"), F.percentile("fmd", 0.975).alias("fmd_ci_upper"), (std / F.greatest(mean, F.lit(1e-8))).alias("cv"),
    )


_BS = f"{_boot_sql('e', 'st', STABILITY_REPS, 'st', 'least(n, 100)')}, bs AS (SELECT a.set_id AS a, b.set_id AS b, a.rep, {_FR} AS fmd, a.n AS size_a, b.n AS size_b FROM st a JOIN st b ON a.rep = b.rep AND a.set_id < b.set_id)"
_BSUM = "a, b, count(*) AS n_resamples, max(size_a) AS sample_size_a, max(size_b) AS sample_size_b, round(avg(fmd), 6) AS fmd_mean, round(stddev_pop(fmd), 6) AS fmd_std, round(quantile_cont(fmd, 0.025), 6) AS fmd_ci_lower, round(quantile_cont(fmd, 0.975), 6) AS fmd_ci_upper, round(stddev_pop(fmd) / greatest(avg(fmd), 1e-8), 6) AS cv"
_BCOLS = ("fmd_mean", "fmd_std", "fmd_ci_lower", "fmd_ci_upper", "cv")


@query("r06_pair_bootstrap", f"{_BS} SELECT a, b, rep, round(fmd, 6) AS fmd FROM bs")
def r06(spark, sf):
    return _round(bootstrap_pairs(_plane(spark, sf), STABILITY_REPS, 100).select("a", "b", "rep", "fmd"), "fmd")


@query("a08_bootstrap_summary", f"{_BS} SELECT {_BSUM} FROM bs GROUP BY a, b")
def a08(spark, sf):
    return _round(stability_summary(bootstrap_pairs(_plane(spark, sf), STABILITY_REPS, 100)), *_BCOLS)


@query("q05_bootstrap_stability", f"{_BS} SELECT {_BSUM} FROM bs WHERE a = 0 AND b = 1 GROUP BY a, b")
def q05(spark, sf):
    """Stability of one pair of sets: only its two sets are resampled."""
    points = _plane(spark, sf).where("set_id in (0, 1)")
    return _round(stability_summary(bootstrap_pairs(points, STABILITY_REPS, 100)), *_BCOLS)


@query("r10_shuffle_take_valid", f" SELECT set_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY {_KEY('t', 'row_id')}, row_id) AS k FROM e WHERE x > 0) WHERE k <= 5")
def r10(spark, sf):
    """Shuffle and take while valid equals taking the first k of the valid ones."""
    return rs.sample(_plane(spark, sf).where("x > 0"), 5, "t", ["set_id"], "row_id").select("set_id", "row_id")


# Tests ----------------------------------------------------------------------

_SIGNED = """, df AS (SELECT set_id, x AS a, y AS b, x - y AS d FROM e), nz AS (SELECT *, abs(d) AS ad FROM df WHERE d <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY set_id ORDER BY ad) + (count(*) OVER (PARTITION BY set_id, ad) - 1) / CAST(2 AS DOUBLE) AS r, CAST(count(*) OVER (PARTITION BY set_id, ad) AS DOUBLE) AS t FROM nz),
ag AS (SELECT set_id, CAST(count(*) AS DOUBLE) AS m, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS stat, sum(t * t - 1) AS tie FROM rk GROUP BY set_id),
sg AS (SELECT set_id, CAST(m AS BIGINT) AS n_nonzero, stat, (stat - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - tie / 48) AS z FROM ag)"""


@query("r07_signed_rank", f"{_SIGNED} SELECT sg.set_id, n, n_nonzero, round(stat, 6) AS stat, round(z, 6) AS z FROM sg JOIN (SELECT set_id, count(*) AS n FROM df GROUP BY set_id) c ON c.set_id = sg.set_id")
def r07(spark, sf):
    return _round(hyp.signed_rank(_plane(spark, sf), ["set_id"], "x", "y").select("set_id", "n", "n_nonzero", "stat", "z"), "stat", "z")


@query("r07_signed_rank_p")
def r07_p(spark, sf):
    tested = hyp.signed_rank(_plane(spark, sf), ["set_id"], "x", "y")
    return tested.select("set_id", "stat", F.round(hyp.signed_rank_p("n", "n_nonzero", "ties", "stat", "z"), 9).alias("p_raw"))


@query("r08_holm", """, t AS (SELECT set_id, row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE abs(x) END AS p FROM e),
s AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS m, row_number() OVER (PARTITION BY set_id ORDER BY p ASC NULLS LAST, row_id) AS k FROM t)
SELECT set_id, row_id, round(max(CASE WHEN p IS NULL THEN 1 ELSE least(1, (m - k + 1) * p) END) OVER (PARTITION BY set_id ORDER BY p ASC NULLS LAST, row_id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""")
def r08(spark, sf):
    tests = _plane(spark, sf).select("set_id", "row_id", F.when(F.col("row_id") % 7 != 0, F.abs("x")).alias("p"))
    return hyp.holm(tests, "p", ["set_id"], ["row_id"]).select("set_id", "row_id", F.round("p_holm", 6).alias("p_holm"))


QUERIES["o08_running_maximum"], SQL["o08_running_maximum"] = QUERIES["r08_holm"], SQL["r08_holm"]

_MID = lambda c, part: f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / CAST(2 AS DOUBLE))"


@query("r09_spearman", f", k AS (SELECT set_id, {_MID('x', 'set_id')} AS rx, {_MID('y', 'set_id')} AS ry FROM e) SELECT set_id, round(corr(rx, ry), 6) AS rho, count(*) AS n_pairs FROM k GROUP BY set_id")
def r09(spark, sf):
    return _round(hyp.spearman(_plane(spark, sf), ["set_id"]), "rho")


@query("r09_spearman_p")
def r09_p(spark, sf):
    out = hyp.spearman(_plane(spark, sf), ["set_id"])
    return out.select("set_id", F.round("rho", 6).alias("rho"), F.round(hyp.spearman_p("rho", "n_pairs"), 9).alias("p_value"), "n_pairs")


# Composite studies ----------------------------------------------------------


def configurations(vectors: DataFrame) -> DataFrame:
    """Three coordinate slices of every vector as three pipelines: configuration, set_id, row_id, x, y."""
    cuts = F.array(*[F.struct(F.lit(n).alias("configuration"), F.get("embedding", F.lit(k)).alias("x"), F.get("embedding", F.lit(k + 1)).alias("y")) for n, k in (("cfg_a", 0), ("cfg_b", 2), ("cfg_c", 4))])
    return vectors.select("set_id", "row_id", F.inline(cuts))


_CF = ", cf AS (SELECT 'cfg_a' AS configuration, set_id, row_id, v[1] AS x, v[2] AS y FROM e UNION ALL SELECT 'cfg_b', set_id, row_id, v[3], v[4] FROM e UNION ALL SELECT 'cfg_c', set_id, row_id, v[5], v[6] FROM e)"


@query("q01_self_similarity", f"""{_CF}, g AS (SELECT *, count(*) OVER (PARTITION BY configuration, set_id) AS m0 FROM cf), ok AS (SELECT * FROM g WHERE m0 >= 10),
hv AS ({_HALF('ok', 'configuration, set_id', ['row_id'])}), hm AS ({_moments_sql('hv', 'configuration, set_id, half')})
SELECT a.set_id AS dataset, a.configuration, a.n AS n_samples_per_half, round({_FR}, 6) AS split_half_fmd FROM hm a JOIN hm b ON a.configuration = b.configuration AND a.set_id = b.set_id AND a.half = 0 AND b.half = 1""")
def q01(spark, sf):
    rows = configurations(_sets(spark, sf))
    keys = ["configuration", "set_id"]
    enough = rel.with_enough(rows, keys, 10)
    met = dist.both_sides(mom.plane_moments(rs.split_half(enough, "h", keys), [*keys, "half"]), keys, "half")
    return met.select(F.col("set_id").alias("dataset"), "configuration", F.col("a_n").alias("n_samples_per_half"), F.round(F.expr(dist.frechet_sql("a_", "b_")), 6).alias("split_half_fmd"))


def cross_distances(rows: DataFrame) -> DataFrame:
    """Distance of all pairs of sets within every configuration."""
    m = mom.plane_moments(rows, ["configuration", "set_id"])
    a, b = dist.side(m, "a_", "configuration", "set_id"), dist.side(m, "b_", "configuration", "set_id")
    met = a.join(b, (F.col("a_configuration") == F.col("b_configuration")) & (F.col("a_set_id") < F.col("b_set_id")))
    pair = F.concat_ws("_vs_", "a_set_id", "b_set_id")
    return met.select(F.col("a_configuration").alias("configuration"), F.col("a_set_id").alias("dataset_a"), F.col("b_set_id").alias("dataset_b"), pair.alias("pair"), F.expr(dist.frechet_sql("a_", "b_")).alias("fmd"))


_CM = f"{_CF}, cm AS ({_moments_sql('cf', 'configuration, set_id')}), cd AS (SELECT a.configuration, a.set_id AS dataset_a, b.set_id AS dataset_b, concat(a.set_id, '_vs_', b.set_id) AS pair, {_FR} AS fmd FROM cm a JOIN cm b ON a.configuration = b.configuration AND a.set_id < b.set_id)"


@query("q02_cross_dataset", f"{_CM} SELECT configuration, dataset_a, dataset_b, pair, round(fmd, 6) AS fmd FROM cd")
def q02(spark, sf):
    return _round(cross_distances(configurations(_sets(spark, sf))), "fmd")


@query("q02_ranking_agreement", f"""{_CM}, al AS (SELECT x.configuration AS config_a, y.configuration AS config_b, x.pair, x.fmd AS fx, y.fmd AS fy FROM cd x JOIN cd y ON x.pair = y.pair AND x.configuration < y.configuration),
k AS (SELECT config_a, config_b, {_MID('fx', 'config_a, config_b')} AS rx, {_MID('fy', 'config_a, config_b')} AS ry FROM al)
SELECT config_a, config_b, round(corr(rx, ry), 6) AS spearman_tau, count(*) AS n_pairs, count(*) >= 10 AS interpretable FROM k GROUP BY config_a, config_b HAVING count(*) >= 6""")
def q02_agreement(spark, sf):
    d = cross_distances(configurations(_sets(spark, sf)))
    x, y = (d.select("pair", F.col("configuration").alias(f"config_{s}"), F.col("fmd").alias(f"f{s}")) for s in "ab")
    met = x.join(y, "pair").where("config_a < config_b")
    out = hyp.spearman(met, ["config_a", "config_b"], "fa", "fb").where("n_pairs >= 6")
    return out.select("config_a", "config_b", F.round("rho", 6).alias("spearman_tau"), "n_pairs", (F.col("n_pairs") >= 10).alias("interpretable"))


@query("q03_perturbation_sensitivity", f"""{_PT}{_PB.removeprefix(_CH)}{_floor_sql(FLOOR_REPS)},
fl AS (SELECT set_id, avg(fmd) AS noise_floor_mean, quantile_cont(fmd, 0.975) AS noise_floor_ci_upper FROM nf GROUP BY set_id),
bt AS (SELECT set_id, avg(fmd) AS fmd_boot_mean, quantile_cont(fmd, 0.025) AS fmd_ci_lower, quantile_cont(fmd, 0.975) AS fmd_ci_upper FROM pb GROUP BY set_id)
SELECT pt.set_id AS dataset, round(fmd, 6) AS fmd_vs_original, round(fmd_boot_mean, 6) AS fmd_boot_mean, round(fmd_ci_lower, 6) AS fmd_ci_lower, round(fmd_ci_upper, 6) AS fmd_ci_upper,
  round(noise_floor_mean, 6) AS noise_floor_mean, round(noise_floor_ci_upper, 6) AS noise_floor_ci_upper, round(CASE WHEN noise_floor_mean > 1e-12 THEN fmd / noise_floor_mean END, 6) AS snr,
  round(perm_p_value, 6) AS perm_p_value, coalesce(perm_p_value < 0.05 AND noise_floor_mean > 1e-12 AND fmd / noise_floor_mean >= 1, false) AS significant
FROM pt JOIN fl ON pt.set_id = fl.set_id JOIN bt ON pt.set_id = bt.set_id""")
def q03(spark, sf):
    """Floor, distance, interval, signal-to-noise ratio, permutation p and verdict of a perturbation of every set."""
    points = _plane(spark, sf)
    changed = changed_plane(points)
    tested = permutation_test(points, changed, PERM_REPS)
    boot = perturbation_bootstrap(points, changed, BOOT_REPS).groupBy("set_id").agg(F.avg("fmd").alias("fmd_boot_mean"), F.percentile("fmd", 0.025).alias("fmd_ci_lower"), F.percentile("fmd", 0.975).alias("fmd_ci_upper"))
    out = tested.join(boot, "set_id").join(floor_summary(noise_floor(points, FLOOR_REPS)), "set_id")
    snr = signal_to_noise(F.col("fmd"), F.col("noise_floor_mean"))
    out = out.select(F.col("set_id").alias("dataset"), F.col("fmd").alias("fmd_vs_original"), "fmd_boot_mean", "fmd_ci_lower", "fmd_ci_upper", "noise_floor_mean", "noise_floor_ci_upper", snr.alias("snr"), "perm_p_value", detected(F.col("perm_p_value"), snr).alias("significant"))
    return _round(out, "fmd_vs_original", "fmd_boot_mean", "fmd_ci_lower", "fmd_ci_upper", "noise_floor_mean", "noise_floor_ci_upper", "snr", "perm_p_value")


def signal_to_noise(distance, floor):
    """Null where the floor is too small to divide by."""
    return F.when(floor > 1e-12, distance / floor)


def detected(p, snr):
    """p below 0.05 and a ratio of 1 or more; a missing ratio is not detected."""
    return F.coalesce((p < 0.05) & (snr >= 1.0), F.lit(False))


def changed_twice(vectors: DataFrame) -> DataFrame:
    """The conditions of the paired study for every vector: a retest and two perturbations."""
    retest = vectors.withColumn("condition", F.lit("__retest__"))
    one = perturbed(vectors).withColumn("condition", F.lit("halved"))
    two = vectors.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < 4, F.lit(0.0)).otherwise(x))).withColumn("condition", F.lit("dropped"))
    return retest.unionByName(one).unionByName(two)


_PSHIFT = f""", cs AS (SELECT '__retest__' AS condition, set_id, row_id, v FROM e UNION ALL SELECT 'halved', set_id, row_id, {_PV} FROM e
  UNION ALL SELECT 'dropped', set_id, row_id, list_transform(range(len(v)), lambda i: CASE WHEN i < 4 THEN CAST(0 AS DOUBLE) ELSE v[i + 1] END) FROM e),
ss AS (SELECT q.condition, q.set_id, q.row_id, round({_COS('p', 'q', '1e-12')}, 9) AS shift FROM e p JOIN cs q ON p.set_id = q.set_id AND p.row_id = q.row_id)"""


def paired_shifts(vectors: DataFrame) -> DataFrame:
    """Cosine shift of every file under every condition, for files that have all conditions."""
    conditions = changed_twice(vectors)
    complete = conditions.groupBy("set_id", "row_id").agg(F.count_distinct("condition").alias("k")).where("k = 3")
    other = conditions.join(complete, ["set_id", "row_id"], "left_semi").withColumnRenamed("embedding", "changed")
    met = vectors.join(other, ["set_id", "row_id"])
    return met.select("condition", "set_id", "row_id", F.round(dist.cosine_distance(F.col("embedding"), F.col("changed"), dist.PAIRED_EPS), 9).alias("shift"))


@query("q04_paired_shifts", f"{_PSHIFT} SELECT condition, set_id, row_id, round(shift, 6) AS shift FROM ss")
def q04_shifts(spark, sf):
    return _round(paired_shifts(_sets(spark, sf)), "shift")


def paired_contrasts(shifts: DataFrame) -> DataFrame:
    """Every perturbation against the retest, by set, with medians and the signed-rank statistic."""
    rest = shifts.where("condition = '__retest__'").select("set_id", "row_id", F.col("shift").alias("b"))
    met = shifts.where("condition <> '__retest__'").withColumnRenamed("shift", "a").join(rest, ["set_id", "row_id"])
    medians = met.groupBy("set_id", "condition").agg(F.median("a").alias("median_shift"), F.median("b").alias("median_ref"))
    return medians.join(hyp.signed_rank(met, ["set_id", "condition"]), ["set_id", "condition"])


@query("q04_paired_contrasts", f"""{_PSHIFT}, pc AS (SELECT a.set_id, a.condition, a.shift AS a, b.shift AS b, a.shift - b.shift AS d FROM ss a JOIN ss b ON a.set_id = b.set_id AND a.row_id = b.row_id AND b.condition = '__retest__' WHERE a.condition <> '__retest__'),
md AS (SELECT set_id, condition, count(*) AS n_files, median(a) AS median_shift, median(b) AS median_ref FROM pc GROUP BY set_id, condition),
nz AS (SELECT *, abs(d) AS ad FROM pc WHERE d <> 0),
rk AS (SELECT *, {_MID('ad', 'set_id, condition')} AS r FROM nz), ag AS (SELECT set_id, condition, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS stat FROM rk GROUP BY set_id, condition)
SELECT md.set_id AS dataset, md.condition AS perturbation, n_files, round(median_shift, 6) AS median_shift, round(median_ref, 6) AS median_ref, round(coalesce(stat, 0), 6) AS wilcoxon_stat FROM md LEFT JOIN ag ON md.set_id = ag.set_id AND md.condition = ag.condition""")
def q04(spark, sf):
    out = paired_contrasts(paired_shifts(_sets(spark, sf)))
    return out.select(F.col("set_id").alias("dataset"), F.col("condition").alias("perturbation"), F.col("n").alias("n_files"), F.round("median_shift", 6).alias("median_shift"), F.round("median_ref", 6).alias("median_ref"), F.round("stat", 6).alias("wilcoxon_stat"))


@query("q04_paired_tests")
def q04_tests(spark, sf):
    """The contrasts with raw and Holm-adjusted p-values per dataset."""
    out = paired_contrasts(paired_shifts(_sets(spark, sf)))
    out = out.withColumn("p_raw", hyp.signed_rank_p("n", "n_nonzero", "ties", "stat", "z"))
    adjusted = hyp.holm(out, "p_raw", ["set_id"], ["condition"])
    return adjusted.select(F.col("set_id").alias("dataset"), F.col("condition").alias("perturbation"), "stat", "p_raw", "p_holm", (F.col("p_holm") < 0.05).alias("significant"))


@query("a10_median_shift", f"{_PSHIFT} SELECT set_id, condition, round(median(shift), 6) AS median_shift FROM ss GROUP BY set_id, condition")
def a10(spark, sf):
    return _round(order.median(order.Rows(paired_shifts(_sets(spark, sf)), ["set_id", "condition"], "shift"), "median_shift"), "median_shift")


@query("j07_control_contrast", f"""{_PSHIFT}, ex AS (SELECT a.set_id, a.row_id, a.condition, a.shift - b.shift AS excess FROM ss a JOIN ss b ON a.set_id = b.set_id AND a.row_id = b.row_id AND b.condition = '__retest__' WHERE a.condition <> '__retest__')
SELECT x.set_id, x.row_id, round(x.excess - y.excess, 6) AS excess_gap FROM ex x JOIN ex y ON x.set_id = y.set_id AND x.row_id = y.row_id AND x.condition = 'halved' AND y.condition = 'dropped'""")
def j07(spark, sf):
    shifts = paired_shifts(_sets(spark, sf))
    rest = shifts.where("condition = '__retest__'").select("set_id", "row_id", F.col("shift").alias("ref"))
    excess = shifts.where("condition <> '__retest__'").join(rest, ["set_id", "row_id"]).select("set_id", "row_id", "condition", (F.col("shift") - F.col("ref")).alias("excess"))
    x = excess.where("condition = 'halved'").select("set_id", "row_id", F.col("excess").alias("ex"))
    y = excess.where("condition = 'dropped'").select("set_id", "row_id", F.col("excess").alias("ey"))
    return x.join(y, ["set_id", "row_id"]).select("set_id", "row_id", F.round(F.col("ex") - F.col("ey"), 6).alias("excess_gap"))
