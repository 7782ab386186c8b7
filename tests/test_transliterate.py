"""Transliteration against spellings written out by hand and a character-wise form."""

import random
import unicodedata

from drift_atlas.functions import transliterate as tr
from drift_atlas.operators import rendering as rd

KNOWN = {
    "Éléonore à Łódź, Ærøskøbing": "Eleonore a Lodz, AEroskobing", "Straße über Größe": "Strasse uber Grosse", "Ελλάδα Ψυχή θέμα": "Ellada Psukhe thema",
    "Щукин Ёлка объезд Юрий": "Shchukin Iolka ob\"ezd Iurii", "Чайковский": "Chaikovskii", "“quoted” – and…": "\"quoted\" - and...", "日本 ok": " ok", "plain": "plain", "": "", "ﬁne №": "fine No", "e\u0301": "e",
}


def test_spellings(spark):
    rows = spark.createDataFrame([(k, v) for k, v in KNOWN.items()] + [(None, None), ("\ue000\uf000x", "x")], "text string, want string")
    for r in rows.select("want", tr.to_ascii(rows.text).alias("got")).collect():
        assert r.got == r.want
    assert all(len(s) > 0 and s.isascii() for s in tr.table().values()) and len(tr.table()) > 900


def test_against_characters_one_by_one(spark):
    """Random text of all ranges, folded by the column and by a walk over its characters."""
    rng = random.Random(4)
    pool = [chr(k) for first, last in [(0x20, 0x7F), *tr._RANGES] for k in range(first, last) if unicodedata.category(chr(k)) != "Cn"]
    texts = ["".join(rng.choice(pool) for _ in range(60)) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in got.select("k", tr.to_ascii(got.text).alias("out")).collect():
        assert r.out == "".join(c if ord(c) < 128 else tr.table().get(c, "") for c in texts[r.k])


def test_patches_are_folded_first(spark):
    texts = spark.createDataFrame([(1, "X:1\nT:Größe\nC D |\n")], "file_id long, abc string")
    codes = rd.abc_patches(texts, 16).orderBy("patch_idx").collect()
    assert "".join(map(chr, codes[1].codes[1:11])) == "T:Grosse\n\x02"
    lines = spark.createDataFrame([(1, "ticks_per_beat 480\nlyrics lyrics Größe 0")], "file_id long, text string")
    assert [r.patch for r in rd.message_patches(lines, 64).orderBy("patch_idx").collect()] == ["ticks_per_beat 480\n", "lyrics lyrics Grosse 0"]
