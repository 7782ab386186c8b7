"""Queries of the rendering, patching, tokenizer and encoder families."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.operators import chain
from drift_atlas.operators import distance as dist
from drift_atlas.operators import encoders as enc
from drift_atlas.operators import messages as ms
from drift_atlas.operators import moments as mom
from drift_atlas.operators import notes as note_ops
from drift_atlas.operators import rendering as rd
from drift_atlas.operators import spectral as sp
from drift_atlas.operators.cache import EmbeddingStore, encode_through
from drift_atlas.sources import fixtures as fx
from drift_atlas.sources.staging import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}
PATCH = rd.PATCH


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {fx.NOTES_CTE}{sql}"
        return f

    return add


def _notes(spark, sf):
    rows = fx.notes(spark, sf)
    return rows, fx.tempos(rows)


_UNIT = "(CAST(60 AS DOUBLE) / tempo_bpm / CAST(4 AS DOUBLE))"
_ABCP = """CASE WHEN pitch // 12 - 1 >= 5 THEN lower(cls) || repeat('''', CAST(pitch // 12 - 6 AS INTEGER)) ELSE cls || repeat(',', CAST(5 - pitch // 12 AS INTEGER)) END"""
_CHORDS = f""", g AS (SELECT file_id, CAST(round_even(start_s / {_UNIT}, 0) AS BIGINT) AS onset, pitch, greatest(1, CAST(round_even((end_s - start_s) / {_UNIT}, 0) AS BIGINT)) AS dur,
   ['C','^C','D','^D','E','F','^F','G','^G','A','^A','B'][pitch % 12 + 1] AS cls FROM n WHERE NOT is_drum),
gp AS (SELECT *, {_ABCP} AS nm FROM g),
gd AS (SELECT DISTINCT file_id, onset, pitch, nm FROM gp),
ch AS (SELECT file_id, onset, max(dur) AS duration FROM gp GROUP BY file_id, onset),
cn AS (SELECT file_id, onset, string_agg(nm, '' ORDER BY pitch) AS names, string_agg(CAST(pitch AS VARCHAR), ',' ORDER BY pitch) AS pitches, count(*) AS k FROM gd GROUP BY file_id, onset),
cg AS (SELECT ch.file_id, ch.onset, duration, names, pitches, k FROM ch JOIN cn ON ch.file_id = cn.file_id AND ch.onset = cn.onset)"""


@query("t20_abc_pitch", f", p AS (SELECT DISTINCT pitch, ['C','^C','D','^D','E','F','^F','G','^G','A','^A','B'][pitch % 12 + 1] AS cls FROM n) SELECT pitch, {_ABCP} AS name FROM p")
def t20(spark, sf):
    return fx.notes(spark, sf).select("pitch").distinct().select("pitch", rd.abc_pitch(F.col("pitch")).alias("name"))


QUERIES["f12_pitch_names"], SQL["f12_pitch_names"] = QUERIES["t20_abc_pitch"], SQL["t20_abc_pitch"]


@query("a16_chord_groups", f"{_CHORDS} SELECT file_id, onset, duration, pitches, names FROM cg")
def a16(spark, sf):
    return rd.chord_groups(*_notes(spark, sf)).select("file_id", "onset", "duration", F.array_join(F.col("pitches").cast("array<string>"), ",").alias("pitches"), "names")


_ABC = f"""{_CHORDS}, cl AS (SELECT *, row_number() OVER w AS place, onset - coalesce(lag(onset + duration) OVER w, 0) AS gap, onset // 16 AS bar, coalesce(lag(onset // 16) OVER w, 0) AS prior FROM cg WINDOW w AS (PARTITION BY file_id ORDER BY onset)),
pt AS (SELECT file_id, onset, concat_ws(' ', CASE WHEN gap > 1 THEN 'z' || gap WHEN gap = 1 THEN 'z' END, CASE WHEN bar > prior THEN '|' END, CASE WHEN bar > prior AND bar % 4 = 0 THEN chr(10) END,
  CASE WHEN k = 1 THEN names || CASE WHEN duration = 1 THEN '' ELSE CAST(duration AS VARCHAR) END ELSE '[' || names || ']' || CASE WHEN duration = 1 THEN '' ELSE CAST(duration AS VARCHAR) END END) AS part FROM cl WHERE place <= 4096),
bd AS (SELECT file_id, string_agg(part, ' ' ORDER BY onset) AS body FROM pt GROUP BY file_id),
ab AS (SELECT f.file_id, 'X:1' || chr(10) || 'M:4/4' || chr(10) || 'L:1/16' || chr(10) || 'Q:' || CAST(CAST(tempo_bpm AS BIGINT) AS VARCHAR) || chr(10) || 'K:C' || chr(10) || coalesce(body || ' |' || chr(10), 'z16 |' || chr(10)) AS abc
  FROM (SELECT DISTINCT file_id, tempo_bpm FROM n) f LEFT JOIN bd ON bd.file_id = f.file_id)"""


@query("t19_abc_text", f"{_ABC} SELECT file_id, abc FROM ab")
def t19(spark, sf):
    return rd.abc_text(*_notes(spark, sf))


QUERIES["o07_previous_state"], SQL["o07_previous_state"] = QUERIES["t19_abc_text"], SQL["t19_abc_text"]


@query("o04_first_groups", f"{_CHORDS} SELECT file_id, onset FROM (SELECT file_id, onset, row_number() OVER (PARTITION BY file_id ORDER BY onset) AS k FROM cg) WHERE k <= {rd.MAX_GROUPS}")
def o04(spark, sf):
    from pyspark.sql import Window

    groups = rd.chord_groups(*_notes(spark, sf))
    return groups.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("onset"))).where(F.col("k") <= rd.MAX_GROUPS).select("file_id", "onset")


@query("velocity_invariance", f"{_ABC} SELECT file_id, CAST(0 AS BIGINT) AS changed FROM ab")
def velocity_invariance(spark, sf):
    """ABC text is blind to velocity: rendering the flattened notes changes no file."""
    rows, tempo = _notes(spark, sf)
    flat = rd.abc_text(note_ops.remove_velocity(rows), tempo).withColumnRenamed("abc", "flat")
    return rd.abc_text(rows, tempo).join(flat, "file_id").select("file_id", (F.col("abc") != F.col("flat")).cast("long").alias("changed"))


# Lines of ABC bodies, with their bars, in DuckDB: pieces between delimiters, a leading delimiter merged, then pairs.
_BARS = f"""{_ABC}, ln AS (SELECT file_id, unnest(string_split(abc, chr(10))) AS line, unnest(range(len(string_split(abc, chr(10))))) AS no FROM ab),
ps AS (SELECT file_id, no, list_filter(string_split(regexp_replace(line, '(\\|:|::|:\\||\\[\\||\\|\\||\\|\\]|\\|)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS b FROM ln WHERE line <> '' AND NOT regexp_matches(line, '^[A-Za-z]:')),
mg AS (SELECT file_id, no, CASE WHEN b[1] IN ('|:','::',':|','[|','||','|]','|') THEN CASE WHEN len(b) > 1 THEN list_concat([b[1] || b[2]], b[3:]) ELSE [] END ELSE b END AS b FROM ps),
br AS (SELECT file_id, no, CASE WHEN len(b) < 2 THEN b ELSE list_transform(range(len(b) // 2), lambda i: b[2 * i + 1] || b[2 * i + 2]) END AS bars FROM mg)"""


def _body_lines(spark, sf) -> DataFrame:
    lines = rd.abc_text(*_notes(spark, sf)).select("file_id", F.posexplode(F.split("abc", "\n")).alias("no", "line"))
    return lines.where((F.col("line") != "") & ~F.col("line").rlike("^[A-Za-z]:")).withColumn("no", F.col("no").cast("long"))


@query("t21_split_bars", f"{_BARS} SELECT file_id, no, array_to_string(bars, '~') AS bars, len(bars) AS n FROM br")
def t21(spark, sf):
    rows = _body_lines(spark, sf).select("file_id", "no", rd.split_bars(F.col("line")).alias("bars"))
    return rows.select("file_id", "no", F.array_join("bars", "~").alias("bars"), F.size("bars").cast("long").alias("n"))


QUERIES["f02_regex_split"], SQL["f02_regex_split"] = QUERIES["t21_split_bars"], SQL["t21_split_bars"]


@query("t22_bar_patch", f"""{_BARS}, xb AS (SELECT file_id, no, unnest(bars) AS bar, unnest(range(len(bars))) AS k FROM br)
SELECT file_id, no, k, array_to_string(list_concat(list_concat([1], list_transform(string_split(bar, ''), lambda c: CAST(ascii(c) AS INTEGER))), list_concat([2], list_transform(range(16), lambda i: 0)))[1:16], ' ') AS codes FROM xb""")
def t22(spark, sf):
    bars = _body_lines(spark, sf).select("file_id", "no", F.posexplode(rd.split_bars(F.col("line"))).alias("k", "bar"))
    return bars.select("file_id", "no", F.col("k").cast("long").alias("k"), F.array_join(rd.bar_patch(F.col("bar"), 16).cast("array<string>"), " ").alias("codes"))


QUERIES["f03_codepoints"], SQL["f03_codepoints"] = QUERIES["t22_bar_patch"], SQL["t22_bar_patch"]
QUERIES["o05_truncation"], SQL["o05_truncation"] = QUERIES["t22_bar_patch"], SQL["t22_bar_patch"]


@query("t23_abc_patches")
def t23(spark, sf):
    """Whole patch encoding of the ABC texts, with marks."""
    out = rd.abc_patches(rd.abc_text(*_notes(spark, sf)), PATCH, special=True)
    return out.select("file_id", "patch_idx", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query("t24_patch_tensor")
def t24(spark, sf):
    """Patches of a file as one nested array, cut to the limit."""
    rows = rd.abc_patches(rd.abc_text(*_notes(spark, sf)), PATCH)
    nested = rows.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("patch_idx", "codes"))), lambda p: p["codes"]).alias("patches"))
    return nested.select("file_id", F.size("patches").cast("long").alias("n_patches"), F.to_json("patches").alias("patches"))


# Tokenizers -----------------------------------------------------------------

_STEP = "(CAST(60 AS DOUBLE) / tempo_bpm / CAST(8 AS DOUBLE))"
_GRID = f""", gr AS (SELECT file_id, note_id, pitch, CAST(round_even(start_s / {_STEP}, 0) AS BIGINT) AS onset, greatest(1, least(64, CAST(round_even((end_s - start_s) / {_STEP}, 0) AS BIGINT))) AS dur, velocity * 32 // 128 AS vel FROM n WHERE pitch BETWEEN 21 AND 108),
ev AS (SELECT *, lag(onset) OVER (PARTITION BY file_id ORDER BY onset, pitch, note_id) AS prior FROM gr)"""
_PVD = "(pitch + 16) || ' ' || (vel + 125) || ' ' || (dur + 156)"
_PARTS = {
    "REMI": f"repeat('4 ', CAST(onset // 32 - coalesce(prior // 32, -1) AS INTEGER)) || CASE WHEN prior IS NULL OR prior <> onset THEN (onset % 32 + 5) || ' ' ELSE '' END || {_PVD}",
    "TSD": f"CASE WHEN onset > coalesce(prior, 0) THEN (least(onset - coalesce(prior, 0), 256) + 220) || ' ' ELSE '' END || {_PVD}",
    "Octuple": f"{_PVD} || ' ' || (onset % 32 + 5) || ' ' || (least(onset // 32, 255) + 221)",
}


def _token_sql(kind: str) -> str:
    if kind == "MIDILike":
        return f"""{_GRID}, oo AS (SELECT file_id, onset AS tm, 1 AS o, pitch, note_id, (pitch + 16) || ' ' || (vel + 125) AS ids FROM gr UNION ALL SELECT file_id, onset + dur, 0, pitch, note_id, CAST(pitch + 456 AS VARCHAR) FROM gr),
ol AS (SELECT *, tm - coalesce(lag(tm) OVER (PARTITION BY file_id ORDER BY tm, o, pitch, note_id), 0) AS gap FROM oo),
tk AS (SELECT file_id, string_agg(CASE WHEN gap > 0 THEN (least(gap, 256) + 220) || ' ' ELSE '' END || ids, ' ' ORDER BY tm, o, pitch, note_id) AS tokens FROM ol GROUP BY file_id)"""
    return f"{_GRID}, tk AS (SELECT file_id, string_agg({_PARTS[kind]}, ' ' ORDER BY onset, pitch, note_id) AS tokens FROM ev GROUP BY file_id)"


def _token_query(name: str, kind: str) -> None:
    @query(name, f"{_token_sql(kind)} SELECT file_id, tokens FROM tk")
    def run(spark, sf):
        return rd.tokenize(*_notes(spark, sf), kind).select("file_id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


for _name, _kind in (("t02_remi", "REMI"), ("t03_tsd", "TSD"), ("t04_octuple", "Octuple"), ("t05_midi_like", "MIDILike")):
    _token_query(_name, _kind)


@query("t06_flatten_tokens", f"{_token_sql('Octuple')} SELECT file_id, len(string_split(tokens, ' ')) AS n FROM tk")
def t06(spark, sf):
    """Nested ids become flat ones; nothing becomes no ids."""
    nested = rd.tokenize(*_notes(spark, sf), "Octuple").select("file_id", F.array(F.col("tokens")).alias("nested"))
    return nested.select("file_id", F.size(F.coalesce(F.flatten("nested"), F.array().cast("array<bigint>"))).cast("long").alias("n"))


@query("t10_sequence_length", f"{_token_sql('REMI')} SELECT file_id, len(string_split(tokens, ' ')) AS length FROM tk")
def t10(spark, sf):
    return rd.tokenize(*_notes(spark, sf), "REMI").select("file_id", F.size("tokens").cast("long").alias("length"))


@query("t11_vocab_size", f"{_token_sql('REMI')}, u AS (SELECT DISTINCT CAST(unnest(string_split(tokens, ' ')) AS BIGINT) AS t FROM tk) SELECT count(*) AS used, CAST({rd.VOCABULARY} AS BIGINT) AS vocab_size, count(*) FILTER (WHERE t BETWEEN 37 AND 124) AS pitches, count(*) FILTER (WHERE t >= {rd.VOCABULARY}) AS unknown FROM u")
def t11(spark, sf):
    """How much of the vocabulary the files' tokens use."""
    used = rd.tokenize(*_notes(spark, sf), "REMI").select(F.explode("tokens").alias("t")).distinct().select(rd.token_name(F.col("t")).alias("name"))
    return used.agg(F.count("*").alias("used"), F.lit(rd.VOCABULARY).cast("long").alias("vocab_size"), F.count_if(F.col("name").startswith("Pitch_")).alias("pitches"), F.count_if(F.col("name").startswith("UNK_")).alias("unknown"))


def _compare_sql() -> str:
    parts = [f"SELECT '{k}' AS tokenizer, sum(len(string_split(tokens, ' '))) AS token_count FROM ({_one(k)})" for k in rd.KINDS]
    return f"{_GRID} SELECT tokenizer, CAST(token_count AS BIGINT) AS token_count, CAST({rd.VOCABULARY} AS BIGINT) AS vocab_size, round(token_count / CAST({rd.VOCABULARY} AS DOUBLE), 6) AS compression_ratio FROM ({' UNION ALL '.join(parts)})"


def _one(kind: str) -> str:
    head, _, body = _token_sql(kind).removeprefix(_GRID).lstrip(", ").rpartition("tk AS (")
    return f"WITH {head.rstrip().rstrip(',')} {body[:-1]}" if head.strip() else body[:-1]


@query("t15_compare_tokenizers", _compare_sql())
def t15(spark, sf):
    rows, tempo = _notes(spark, sf)
    parts = [rd.tokenize(rows, tempo, k).agg(F.sum(F.size("tokens")).cast("long").alias("token_count")).withColumn("tokenizer", F.lit(k)) for k in rd.KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tokenizer", "token_count", F.lit(rd.VOCABULARY).cast("long").alias("vocab_size"), F.round(F.col("token_count") / rd.VOCABULARY, 6).alias("compression_ratio"))


QUERIES["m17_compression_ratio"], SQL["m17_compression_ratio"] = QUERIES["t15_compare_tokenizers"], SQL["t15_compare_tokenizers"]


@query("a06_token_length_summary", f"{_token_sql('TSD')}, l AS (SELECT len(string_split(tokens, ' ')) AS k FROM tk) SELECT round(avg(k), 6) AS mean, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS total FROM l")
def a06(spark, sf):
    n = F.size("tokens").cast("long")
    return rd.tokenize(*_notes(spark, sf), "TSD").agg(F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"))


@query("t14_tokenize_dataset", f"{_token_sql('REMI')}, l AS (SELECT f.file_id, coalesce(len(string_split(tokens, ' ')), 0) AS k FROM (SELECT DISTINCT file_id FROM n) f LEFT JOIN tk ON tk.file_id = f.file_id) SELECT count(*) AS total, count(*) FILTER (WHERE k > 0) AS successful, count(*) FILTER (WHERE k = 0) AS failed, round(avg(k) FILTER (WHERE k > 0), 6) AS mean_length FROM l")
def t14(spark, sf):
    rows, tempo = _notes(spark, sf)
    n = F.size(F.coalesce("tokens", F.array().cast("array<bigint>")))
    met = rows.select("file_id").distinct().join(rd.tokenize(rows, tempo, "REMI"), "file_id", "left").select(n.alias("k"))
    return met.agg(F.count("*").alias("total"), F.count_if(F.col("k") > 0).alias("successful"), F.count_if(F.col("k") == 0).alias("failed"), F.round(F.avg(F.when(F.col("k") > 0, F.col("k"))), 6).alias("mean_length"))


@query("t16_symbolic_text", f"{_token_sql('Octuple')}, x AS (SELECT file_id, unnest(string_split(tokens, ' ')) AS t, unnest(range(len(string_split(tokens, ' ')))) AS k FROM tk), y AS (SELECT *, CAST(t AS BIGINT) AS i FROM x) SELECT file_id, string_agg(CASE WHEN i < 37 THEN 'Position_' || (i - 5) WHEN i < 125 THEN 'Pitch_' || (i - 16) WHEN i < 157 THEN 'Velocity_' || (i - 125) WHEN i < 221 THEN 'Duration_' || (i - 157) ELSE 'TimeShift_' || (i - 221) END, chr(10) ORDER BY k) AS text FROM y GROUP BY file_id")
def t16(spark, sf):
    rows = rd.tokenize(*_notes(spark, sf), "Octuple")
    return rows.select("file_id", F.array_join(F.transform("tokens", rd.token_name), "\n").alias("text"))


@query("t17_tokens_to_text", f"{_token_sql('REMI')} SELECT file_id, array_to_string(string_split(tokens, ' ')[1:512], ' ') AS text FROM tk")
def t17(spark, sf):
    return rd.tokenize(*_notes(spark, sf), "REMI").select("file_id", F.array_join(F.slice(F.col("tokens").cast("array<string>"), 1, 512), " ").alias("text"))


@query("t09_decode", f"{_GRID} SELECT file_id, onset, pitch, vel, dur FROM gr")
def t09(spark, sf):
    """Decoding the REMI tokens gives the quantised notes back."""
    return rd.detokenize(rd.tokenize(*_notes(spark, sf), "REMI"))


# Encoders -------------------------------------------------------------------


def token_items(spark, sf, kind: str = "REMI") -> DataFrame:
    return chain.token_items(*_notes(spark, sf), kind)


def abc_items(notes: DataFrame, tempos: DataFrame) -> DataFrame:
    return chain.patch_items(rd.abc_text(notes, tempos), PATCH)


def _shown(embedded: DataFrame) -> DataFrame:
    norm = F.sqrt(dist.dot(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>")))
    return embedded.select("file_id", F.size("embedding").cast("long").alias("dim"), F.round(norm, 6).alias("norm"))


@query("e02_encode_tokens")
def e02(spark, sf):
    return _shown(enc.encode(token_items(spark, sf), "tokens"))


@query("e06_encode_abc_patches", " SELECT DISTINCT file_id, CAST(64 AS BIGINT) AS dim, CAST(1 AS DOUBLE) AS norm FROM n")
def e06(spark, sf):
    """Patch encoders are on the unit sphere."""
    return _shown(enc.encode(abc_items(*_notes(spark, sf)), "patches-bars"))


@query("e07_encode_message_patches")
def e07(spark, sf):
    patches = rd.message_patches(ms.text(fx.messages(fx.notes(spark, sf))), PATCH).withColumn("codes", rd.bar_patch(F.col("patch"), PATCH))
    items = patches.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("patch_idx", "codes"))), lambda p: p["codes"]).alias("patches"))
    return _shown(enc.encode(items, "patches-messages"))


_SHARES = f"{_token_sql('REMI')}, tz AS (SELECT file_id, list_slice(string_split(tokens, ' '), 1, 512) AS ts FROM tk), tc AS (SELECT file_id, CAST(unnest(ts) AS BIGINT) % 64 AS i, len(ts) AS k FROM tz)"


def _share(value):
    """A share that was kept as a float, as the double it came from to 7 places: of k tokens it lies either on
    a half of the fourth place or 1 / (20,000 k) beside it, more than a float is off for the 512 tokens of an item."""
    return F.round(value.cast("double"), 7)


@query("e02_encode_histogram", f"{_SHARES} SELECT file_id, i, round(count(*) / CAST(max(k) AS DOUBLE), 4) AS share FROM tc GROUP BY file_id, i")
def e02_histogram(spark, sf):
    """Token lists through an encoder that SQL can follow: its coordinates that are not 0."""
    out = enc.encode(token_items(spark, sf), "histogram").select("file_id", F.posexplode("embedding").alias("i", "share"))
    return out.where("share > 0").select("file_id", F.col("i").cast("long").alias("i"), F.round(_share(F.col("share")), 4).alias("share"))


@query("e10_extract_with_cache", f"""{_SHARES}, hs AS (SELECT file_id, i, count(*) AS c, max(k) AS k FROM tc GROUP BY file_id, i), dg AS (SELECT file_id, md5(string_agg(i || ':' || CAST(CAST(round(c * CAST(10000 AS DOUBLE) / k, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS digest FROM hs GROUP BY file_id),
ct AS (SELECT count(DISTINCT CASE WHEN file_id % 2 = 0 THEN ts END) AS evens, count(DISTINCT ts) AS every FROM tz)
SELECT file_id, digest, evens AS encoded_first, every - evens AS encoded_second, 0 AS encoded_third FROM dg, ct""")
def e10(spark, sf):
    """Embeddings through a store that outlives its plans: half of the items, then all, then all again, which encodes nothing."""
    items = token_items(spark, sf)
    store = EmbeddingStore(spark, f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")
    counts = [encode_through(part, store, "histogram")[1] for part in (items.where("file_id % 2 = 0"), items)]
    found, last = encode_through(items, store, "histogram")
    part = F.transform(F.filter(F.transform("embedding", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: p["v"] > 0), lambda p: F.concat(p["i"], F.lit(":"), (F.round(_share(p["v"]), 4) * 10000 + 0.5).cast("long")))
    return found.select("file_id", F.md5(F.array_join(part, ",").cast("binary")).alias("digest"), *[F.lit(n).cast("long").alias(f"encoded_{k}") for k, n in zip(("first", "second", "third"), (*counts, last))])


QUERIES["s26_embedding_cache"], SQL["s26_embedding_cache"] = QUERIES["e10_extract_with_cache"], SQL["e10_extract_with_cache"]


@query("e11_perturbed_embeddings", " SELECT 'no_velocity' AS perturbation, CAST(0 AS DOUBLE) AS fmd FROM (SELECT 1)")
def e11(spark, sf):
    """From notes to distance: removing velocity moves no ABC embedding, so its distance is exactly 0."""
    rows, tempo = _notes(spark, sf)
    kept = note_ops.normalize_instruments(note_ops.filter_note_range(rows))
    one = enc.encode(abc_items(kept, tempo), "patches-bars").withColumn("set_id", F.lit(0).cast("long"))
    two = enc.encode(abc_items(note_ops.remove_velocity(kept), tempo), "patches-bars").withColumn("set_id", F.lit(1).cast("long"))
    both = one.unionByName(two).select("set_id", F.col("file_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    pairs = dist.plane_pairs(mom.plane_moments(fx.plane(both), ["set_id"]))
    return pairs.select(F.lit("no_velocity").alias("perturbation"), F.round("fmd", 6).alias("fmd"))


@query("e11_study_of_all_perturbations", " SELECT DISTINCT file_id % 2 AS dataset, c AS configuration, p AS perturbation, c = 'bars' AND p = 'no_velocity' AS unmoved FROM n, (SELECT unnest(['bars', 'remi']) AS c) x, (SELECT unnest(['no_velocity', 'quantized_time', 'constant_tempo', 'all_combined']) AS p) y")
def e11_all(spark, sf):
    """Every perturbation under two configurations, from notes to distances: only velocity under ABC moves nothing."""
    rows, tempo = _notes(spark, sf)
    embedded = chain.perturbed_embeddings(rows, tempo, fx.beats(rows), {"bars": ("patches-bars", None), "remi": ("tokens", "REMI")}, PATCH)
    sets = tempo.select("file_id", (F.col("file_id") % 2).cast("long").alias("set_id"), F.col("file_id").alias("row_id"))
    out = chain.perturbation_study(embedded, sets, "original", 5, 5, 9)
    return out.select("dataset", "configuration", "perturbation", (F.col("fmd_vs_original") < 1e-9).alias("unmoved"))


@query("s25_embedding_sink", " SELECT count(DISTINCT file_id) AS total, count(DISTINCT file_id) AS successful FROM n WHERE pitch BETWEEN 21 AND 108")
def s25(spark, sf):
    """Embeddings with their counters, as they would be written."""
    out = enc.encode(token_items(spark, sf), "tokens")
    return out.agg(F.count("*").alias("total"), F.count_if(F.size("embedding") > 0).alias("successful"))


_SPECTRAL = f""", sn AS (SELECT file_id, pitch, velocity, start_s, least(end_s, CAST({sp.SECONDS} AS DOUBLE)) AS end_s FROM n),
sf AS (SELECT *, unnest(range(CAST(floor(start_s * {sp.FRAMES_A_SECOND}) AS BIGINT), greatest(CAST(floor(start_s * {sp.FRAMES_A_SECOND}) AS BIGINT), CAST(ceil(end_s * {sp.FRAMES_A_SECOND}) AS BIGINT) - 1) + 1)) AS frame FROM sn WHERE start_s >= 0 AND start_s < end_s),
sh AS (SELECT *, greatest(0, least(end_s, (frame + 1) / CAST({sp.FRAMES_A_SECOND} AS DOUBLE)) - greatest(start_s, frame / CAST({sp.FRAMES_A_SECOND} AS DOUBLE))) * {sp.FRAMES_A_SECOND} AS share, unnest(range(1, {sp.HARMONICS + 1})) AS h FROM sf),
sb AS (SELECT file_id, frame, CAST(floor({sp.BANDS_AN_OCTAVE} * log2(h * {sp.CONCERT_HZ} * power(2, (pitch - {sp.CONCERT_PITCH}) / CAST(12 AS DOUBLE)) / {sp.LOWEST_HZ}) + 1e-9) AS BIGINT) AS band, share * power(velocity / CAST(127 AS DOUBLE) / h, 2) AS e FROM sh),
se AS (SELECT file_id, frame, band, sum(e) AS energy FROM sb WHERE band BETWEEN 0 AND {sp.BANDS - 1} GROUP BY file_id, frame, band),
sl AS (SELECT file_id, greatest(1, ceil(least(max(end_s), CAST({sp.SECONDS} AS DOUBLE)) * {sp.FRAMES_A_SECOND})) AS frames FROM n GROUP BY file_id)"""


@query("e05_band_energies", f"{_SPECTRAL} SELECT file_id, frame, band, round(energy, 6) AS energy FROM se")
def e05_energies(spark, sf):
    return sp.band_energies(fx.notes(spark, sf)).select("file_id", "frame", "band", F.round("energy", 6).alias("energy"))


@query("e05_spectral_embedding", f"{_SPECTRAL}, sv AS (SELECT file_id, band, sum(ln(1 + energy)) AS v FROM se GROUP BY file_id, band) SELECT sl.file_id, b.band, round(coalesce(v, 0) / frames, 6) AS value FROM sl JOIN (SELECT unnest(range({sp.BANDS})) AS band) b ON true LEFT JOIN sv ON sv.file_id = sl.file_id AND sv.band = b.band")
def e05(spark, sf):
    """How every file sounds in its first seconds, band by band."""
    rows = sp.embed(fx.notes(spark, sf)).select("file_id", F.posexplode("embedding").alias("band", "value"))
    return rows.select("file_id", F.col("band").cast("long").alias("band"), F.round("value", 6).alias("value"))
