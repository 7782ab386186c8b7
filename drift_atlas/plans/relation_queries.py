"""Queries of the pairing, guard, counter, order, set and integer families over the studies' own frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from drift_atlas.functions import scalar as sc
from drift_atlas.functions.transliterate import to_ascii
from drift_atlas.operators import distance as dist
from drift_atlas.operators import encoders as enc
from drift_atlas.operators import relations as rel
from drift_atlas.plans import distance_queries as dq
from drift_atlas.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


_Q1, _Q2, _Q3 = (f"({dq.SQL[k]})" for k in ("q01_self_similarity", "q02_cross_dataset", "q03_perturbation_sensitivity"))
_MODELS = list(enc.RULES)
_MODEL_ROWS = ", ".join(f"({k}, '{m}')" for k, m in enumerate(_MODELS))


def _models(spark):
    return spark.createDataFrame(list(enumerate(_MODELS)), "place int, model string")


# Guards and formats ---------------------------------------------------------


@query("p12_minimum_samples", "WITH d AS (SELECT * FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10)), g AS (SELECT source, lang, count(*) AS n FROM d GROUP BY source, lang) SELECT source, lang, n FROM g WHERE n >= 10 AND source IS NOT NULL AND lang IS NOT NULL")
def p12(spark, sf):
    """Datasets of too few files go first, then configurations of too few."""
    rows = rel.with_enough(fx.load(spark, sf, "documents"), ["source"])
    return rel.with_enough(rows, ["source", "lang"]).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("p13_optional_admission", "SELECT n_nationkey AS dataset FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def p13(spark, sf):
    nations = fx.load(spark, sf, "nation").select(F.col("n_nationkey").alias("dataset"))
    files = fx.load(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("dataset"))
    return rel.admitted(nations.where("dataset % 5 = 0"), nations.where("dataset % 5 <> 0"), files, "dataset")


_CUST_MODEL = "CASE c_custkey % 6 WHEN 0 THEN 'tokens' WHEN 1 THEN 'tokens-large' WHEN 2 THEN 'text' WHEN 3 THEN 'patches-bars' WHEN 4 THEN 'patches-messages' ELSE 'nothing' END"


def _asked(spark, sf):
    names = F.array(*map(F.lit, [*_MODELS, "nothing"]))
    return fx.load(spark, sf, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("model"))


@query("p16_infer_format", f"WITH m AS (SELECT c_custkey, {_CUST_MODEL} AS model FROM customer) SELECT c_custkey, model, CASE WHEN model LIKE 'tokens%' THEN 'MIDITOK' WHEN model = 'text' THEN 'TEXT' WHEN model = 'patches-bars' THEN 'ABC' WHEN model = 'patches-messages' THEN 'MTF' END AS fmt FROM m")
def p16(spark, sf):
    return _asked(spark, sf).withColumn("fmt", enc.default_format(F.col("model")))


@query("p17_requires_notes", f"WITH m AS (SELECT c_custkey, {_CUST_MODEL} AS model FROM customer) SELECT c_custkey, model LIKE 'patches%' AS needs FROM m")
def p17(spark, sf):
    return _asked(spark, sf).select("c_custkey", enc.requires_notes(enc.default_format(F.col("model"))).alias("needs"))


@query("p22_nan_removal", f"WITH q AS {_Q2}, v AS (SELECT configuration, CASE WHEN dataset_a = 0 THEN CAST('NaN' AS DOUBLE) ELSE fmd END AS fmd FROM q) SELECT configuration, count(*) AS n, round(avg(fmd), 4) AS mean, round(min(fmd), 4) AS least FROM v WHERE NOT isnan(fmd) GROUP BY configuration")
def p22(spark, sf):
    """Distances to a broken set are NaN and must not reach the statistics."""
    rows = dq.q02(spark, sf).withColumn("fmd", F.when(F.col("dataset_a") == 0, F.lit(float("nan"))).otherwise(F.col("fmd")))
    return rel.without_nan(rows, "fmd").groupBy("configuration").agg(F.count("*").alias("n"), F.round(F.avg("fmd"), 4).alias("mean"), F.round(F.min("fmd"), 4).alias("least"))


def _parse_token(text: str) -> int:
    return int(text)


@query("p23_isolated_failures", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS result, CASE WHEN event_id % 3 = 0 THEN 'ValueError' WHEN event_id % 7 = 0 THEN 'TypeError' END AS problem FROM events")
def p23(spark, sf):
    """Token texts parsed one by one; the bad ones fail alone and are named."""
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string"))
    rows = fx.load(spark, sf, "events").select("event_id", text.alias("text"))
    return rel.isolated(rows, "text", _parse_token, "long").drop("text")


# Pairs and joins ------------------------------------------------------------


@query("j01_dataset_pairs", "WITH d AS (SELECT DISTINCT label AS k FROM embeddings) SELECT 'set' || a.k AS dataset_a, 'set' || b.k AS dataset_b FROM d a, d b WHERE a.k < b.k")
def j01(spark, sf):
    sets = fx.embedding_sets(spark, sf).select("set_id").distinct().select("set_id", F.concat(F.lit("set"), "set_id").alias("dataset"))
    return rel.ordered_pairs(sets, "set_id", "dataset")


@query("j02_configuration_pairs", f"WITH q AS {_Q1}, c AS (SELECT DISTINCT configuration FROM q) SELECT a.configuration AS configuration_a, b.configuration AS configuration_b FROM c a JOIN c b ON a.configuration < b.configuration")
def j02(spark, sf):
    return rel.ordered_pairs(dq.q01(spark, sf).select("configuration").distinct(), "configuration", "configuration")


@query("j03_model_pairs", f"WITH a AS (SELECT DISTINCT {_CUST_MODEL} AS model FROM customer), m(place, model) AS (VALUES {_MODEL_ROWS}), f AS (SELECT m.*, CASE WHEN m.model LIKE 'patches%' THEN 'notes' ELSE 'tokens' END AS family FROM m JOIN a ON a.model = m.model) SELECT a.model AS model_a, b.model AS model_b FROM f a JOIN f b ON a.family = b.family AND a.place < b.place")
def j03(spark, sf):
    """Models of one family that customers ask for, in the order of their registry."""
    notes = enc.requires_notes(enc.default_format(F.col("model")))
    asked = _models(spark).join(_asked(spark, sf).select("model").distinct(), "model", "left_semi")
    return rel.ordered_pairs(asked.withColumn("family", F.when(notes, "notes").otherwise("tokens")), "place", "model", within="family")


@query("j04_key_lookup", "WITH e AS (SELECT label AS s, vec_id, unnest(['cfg_a', 'cfg_b', 'cfg_c']) AS configuration FROM embeddings), n AS (SELECT s, configuration, count(*) AS n FROM e WHERE NOT (configuration = 'cfg_b' AND s = 1) GROUP BY s, configuration) SELECT x.configuration, x.n AS a, y.n AS b FROM n x JOIN n y ON x.configuration = y.configuration AND x.s = 0 AND y.s = 1")
def j04(spark, sf):
    """Two datasets meet under the configurations that both have."""
    rows = dq.configurations(fx.embedding_sets(spark, sf)).where("not (configuration = 'cfg_b' and set_id = 1)")
    sizes = rows.groupBy("set_id", "configuration").agg(F.count("*").alias("n"))
    return rel.paired(sizes.where("set_id = 0"), sizes.where("set_id = 1"), ["configuration"], "n")


@query("j05_ranking_alignment", f"WITH q AS {_Q2} SELECT x.pair, round(x.fmd, 4) AS a, round(y.fmd, 4) AS b FROM q x JOIN q y ON x.pair = y.pair WHERE x.configuration = 'cfg_a' AND y.configuration = 'cfg_c'")
def j05(spark, sf):
    out = rel.aligned_rankings(dq.q02(spark, sf), "cfg_a", "cfg_c")
    return out.select("pair", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("j06_paired_files", f"WITH {fx.SETS_CTE}{dq._PSHIFT} SELECT x.set_id, x.row_id, round(x.shift, 6) AS a, round(y.shift, 6) AS b FROM ss x JOIN ss y ON x.set_id = y.set_id AND x.row_id = y.row_id WHERE x.condition = 'halved' AND y.condition = 'dropped' AND x.row_id % 3 <> 0 AND y.row_id % 5 <> 0")
def j06(spark, sf):
    """Shifts of the files that two conditions share."""
    shifts = dq.paired_shifts(fx.embedding_sets(spark, sf))
    a = shifts.where("condition = 'halved' and row_id % 3 <> 0")
    b = shifts.where("condition = 'dropped' and row_id % 5 <> 0")
    out = rel.paired(a, b, ["set_id", "row_id"], "shift")
    return out.select("set_id", "row_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("j08_complete_cases", "WITH t AS (SELECT DISTINCT user_id, event_type FROM events), k AS (SELECT user_id FROM t GROUP BY user_id HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)) SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM k) GROUP BY user_id")
def j08(spark, sf):
    rows = fx.load(spark, sf, "events").select("user_id", "event_type")
    return rel.complete_cases(rows, ["user_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("n"))


@query("j10_floor_lookup", f"WITH q AS {_Q2}, f AS {_Q1} SELECT q.configuration, q.pair, isnan(coalesce(f.split_half_fmd, CAST('NaN' AS DOUBLE))) AS missing, round(coalesce(f.split_half_fmd, 0), 4) AS floor FROM q LEFT JOIN f ON f.configuration = q.configuration AND f.dataset = q.dataset_b AND f.dataset % 2 = 0")
def j10(spark, sf):
    """Every distance with the floor of its second dataset, NaN where that is not known."""
    floors = dq.q01(spark, sf).where("dataset % 2 = 0").select("configuration", F.col("dataset").alias("dataset_b"), F.col("split_half_fmd").alias("floor"))
    out = rel.with_default(dq.q02(spark, sf), floors, ["configuration", "dataset_b"], "floor")
    return out.select("configuration", "pair", F.isnan("floor").alias("missing"), F.round(sc.finite_or(F.col("floor")), 4).alias("floor"))


@query("j14_registry_intersection", f"""WITH m(place, model) AS (VALUES {_MODEL_ROWS}), a AS (SELECT c_mktsegment, {_CUST_MODEL} AS model FROM customer), s AS (SELECT DISTINCT model FROM a WHERE c_mktsegment = 'BUILDING' AND model <> 'text')
SELECT 'some' AS wanted, m.model FROM m JOIN s ON s.model = m.model UNION ALL SELECT 'none', model FROM m""")
def j14(spark, sf):
    """What customers name and the registry has; the whole registry if that is nothing."""
    asked = _asked(spark, sf).join(fx.load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    named = {"some": asked.where("c_mktsegment = 'BUILDING' and model <> 'text'"), "none": asked.where("model = 'nothing'")}
    frames = [rel.in_registry(rows.select("model").distinct(), _models(spark), "model", "place").select(F.lit(k).alias("wanted"), "model") for k, rows in named.items()]
    return rel.concat_frames(frames)


# Counters and order ---------------------------------------------------------


@query("a07_counters", "WITH p AS (SELECT coalesce(split_part(url, '/', 3), '') AS host, page_id, coalesce(length(html), 0) > 1000 AS ok FROM pages) SELECT host, count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, md5(coalesce(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (WHERE NOT ok), '')) AS failed_items FROM p GROUP BY host")
def a07(spark, sf):
    """Pages of a host that are long enough to be worked on, and the ids of the others."""
    pages = fx.load(spark, sf, "pages").select(F.coalesce(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("")).alias("host"), "page_id", (F.coalesce(F.length("html"), F.lit(0)) > 1000).alias("ok"))
    out = rel.counters(pages, F.col("ok"), "page_id", "host")
    return out.withColumn("failed_items", F.md5(F.array_join(F.col("failed_items").cast("array<string>"), ",").cast("binary")))


@query("a14_tag_counts", "WITH t AS (SELECT trim(unnest(string_split(p_type, ' '))) AS tag FROM part) SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY tag")
def a14(spark, sf):
    return rel.tag_counts(fx.load(spark, sf, "part").select(F.explode(F.split("p_type", " ")).alias("t")), "t")


@query("o09_report_order", f"WITH q AS {_Q2}, p AS (SELECT pair, max(fmd) FILTER (WHERE configuration = 'cfg_a') AS first, max(fmd) FILTER (WHERE configuration = 'cfg_b') AS second FROM q GROUP BY pair), o AS (SELECT *, row_number() OVER (ORDER BY first DESC, pair) AS place FROM p), k(place2, pair) AS (VALUES (1, '2_vs_3'), (2, '0_vs_1'), (3, 'missing')) SELECT k.pair, o.place, round(first, 4) AS first, round(second, 4) AS second FROM k LEFT JOIN o ON o.pair = k.pair")
def o09(spark, sf):
    """Places by the first column, then a fixed order of some rows; one of them has no row."""
    wide = dq.q02(spark, sf).groupBy("pair").pivot("configuration", ["cfg_a", "cfg_b"]).agg(F.max("fmd"))
    places = dist.placed(wide, "cfg_a", "pair")
    out = rel.reindexed(places, "pair", ["2_vs_3", "0_vs_1", "missing"])
    return out.select("pair", "place", F.round("cfg_a", 4).alias("first"), F.round("cfg_b", 4).alias("second"))


@query("o10_multi_key_sort", f"WITH q AS {_Q2} SELECT configuration, dataset_a, dataset_b FROM q ORDER BY configuration, dataset_a, dataset_b")
def o10(spark, sf):
    return dq.q02(spark, sf).orderBy("configuration", "dataset_a", "dataset_b").select("configuration", "dataset_a", "dataset_b")


# Sets -----------------------------------------------------------------------


@query("u01_concat_frames", f"WITH q AS {_Q1}, r AS {_Q2} SELECT configuration, dataset, CAST(NULL AS VARCHAR) AS pair, round(split_half_fmd, 4) AS fmd FROM q UNION ALL SELECT configuration, NULL, pair, round(fmd, 4) FROM r")
def u01(spark, sf):
    """Result frames of two studies as one."""
    one = dq.q01(spark, sf).select("configuration", "dataset", F.round("split_half_fmd", 4).alias("fmd"))
    two = dq.q02(spark, sf).select("configuration", "pair", F.round("fmd", 4).alias("fmd"))
    return rel.concat_frames([one, two]).select("configuration", "dataset", "pair", "fmd")


@query("u02_pool_sets", "SELECT CASE WHEN label = 0 THEN 'a' ELSE 'b' END AS side, vec_id AS row_id FROM embeddings WHERE label <= 1")
def u02(spark, sf):
    sets = fx.embedding_sets(spark, sf)
    return rel.pooled(sets.where("set_id = 0"), sets.where("set_id = 1")).select("side", "row_id")


@query("u03_key_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u03(spark, sf):
    return rel.common_keys(fx.load(spark, sf, "documents"), fx.load(spark, sf, "labels"), "doc_id")


@query("u04_distinct", f"WITH {fx.NOTES_CTE} SELECT file_id, count(DISTINCT pitch) AS n_pitches, md5(string_agg(DISTINCT CAST(pitch AS VARCHAR), ',' ORDER BY CAST(pitch AS VARCHAR))) AS pitches FROM n GROUP BY file_id")
def u04(spark, sf):
    """The pitches of every file, each once."""
    pitches = F.array_sort(F.collect_set(F.col("pitch").cast("string")))
    rows = fx.notes(spark, sf).groupBy("file_id").agg(pitches.alias("p"))  # a pitch is one of 128
    return rows.select("file_id", F.size("p").cast("long").alias("n_pitches"), F.md5(F.array_join("p", ",").cast("binary")).alias("pitches"))


@query("u06_membership_union", f"WITH q AS ({dq.SQL['q02_ranking_agreement']}) SELECT config_a AS configuration FROM q UNION SELECT config_b FROM q")
def u06(spark, sf):
    return rel.members(dq.q02_agreement(spark, sf), "config_a", "config_b", "configuration")


@query("u07_difference", f"WITH {fx.FILES_CTE}, done AS (SELECT path FROM files WHERE file_id % 4 = 0) SELECT file_id, path FROM files WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.path = files.path)")
def u07(spark, sf):
    """Files that are not copied yet."""
    files = fx.inventory(spark, sf)
    return rel.without(files, files.where("file_id % 4 = 0").select("path"), ["path"]).select("file_id", "path")


# Numbers --------------------------------------------------------------------


@query("f05_integer_math", "SELECT event_id, CAST(round_even(event_id / CAST(2 AS DOUBLE), 0) AS BIGINT) AS nearest, CAST(floor(event_id / CAST(7 AS DOUBLE)) AS BIGINT) AS bar, event_id % 7 AS beat, greatest(1, event_id % 5) AS length FROM events")
def f05(spark, sf):
    k = F.col("event_id")
    return fx.load(spark, sf, "events").select("event_id", sc.half_even(k / 2.0).alias("nearest"), sc.floor_div(k, 7).alias("bar"), (k % 7).alias("beat"), sc.at_least(k % 5, 1).alias("length"))


@query("f06_float_math", f"WITH {fx.SETS_CTE} SELECT row_id, round(sqrt(list_sum(list_transform(v, lambda q: q * q))), 6) AS norm, round(greatest(x, CAST(0 AS DOUBLE)), 6) AS clipped, CASE WHEN row_id % 4 IN (1, 2) THEN CAST(0 AS DOUBLE) ELSE round(x, 6) END AS finite FROM e")
def f06(spark, sf):
    rows = fx.plane(fx.embedding_sets(spark, sf)).join(fx.embedding_sets(spark, sf).select("row_id", "embedding"), "row_id")
    k = F.col("row_id") % 4
    broken = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.col("x"))
    return rows.select("row_id", F.round(sc.norm(F.col("embedding")), 6).alias("norm"), F.round(sc.at_least(F.col("x"), 0.0), 6).alias("clipped"), F.round(sc.finite_or(broken), 6).alias("finite"))


@query("f03_ascii_fold", "SELECT doc_id, md5(regexp_replace(replace(strip_accents(text), 'ß', 'ss'), '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents")
def f03(spark, sf):
    """Every text in ASCII."""
    return fx.load(spark, sf, "documents").select("doc_id", F.md5(to_ascii(F.col("text")).cast("binary")).alias("folded"))
