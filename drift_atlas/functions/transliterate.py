"""Text to ASCII, inside the JVM, by a table that is made from rules.

Letters of Latin script lose their marks by their canonical decomposition. Greek and
Cyrillic letters are spelled by their Unicode names, so all their accented and capital forms follow
from one spelling each. Characters with one ASCII letter go through one ``translate``;
those with several become private code points first, which are then replaced one
kind at a time, and only in texts that hold anything beyond ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of letters by the last word of their names.
GREEK = {
    "ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m",
    "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "FINAL SIGMA": "s", "TAU": "t", "UPSILON": "u", "PHI": "ph", "CHI": "kh", "PSI": "ps", "OMEGA": "o",
}
CYRILLIC = {
    "A": "a", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "io", "ZHE": "zh", "ZE": "z", "I": "i", "SHORT I": "i", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "O": "o", "PE": "p",
    "ER": "r", "ES": "s", "TE": "t", "U": "u", "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "\"", "YERU": "y", "SOFT SIGN": "'", "E": "e", "YU": "iu", "YA": "ia",
    "UKRAINIAN IE": "ie", "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "i", "GHE WITH UPTURN": "g", "SHORT U": "u", "DJE": "dj", "GJE": "gj", "DZE": "dz", "JE": "j", "LJE": "lj", "NJE": "nj", "TSHE": "c", "KJE": "kj", "DZHE": "dzh",
}
#: Letters without a decomposition, and marks.
OTHERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ĳ": "ij", "Ĳ": "IJ", "ŋ": "ng", "Ŋ": "NG", "ŧ": "t", "Ŧ": "T",
    "\u00a0": " ", "¡": "!", "¿": "?", "«": "<<", "»": ">>", "‘": "'", "’": "'", "‚": ",", "“": "\"", "”": "\"", "„": ",,", "–": "-", "—": "--", "…": "...", "•": "*", "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)", "°": "deg", "×": "x", "÷": "/", "½": "1/2", "¼": "1/4", "¾": "3/4", "™": "tm", "‹": "<", "›": ">",
}
#: Blocks whose letters are looked up: Latin with marks, Greek and Cyrillic, their extensions, combining marks, ligatures and wide forms.
_RANGES = [(0x00A0, 0x0250), (0x0300, 0x0460), (0x0490, 0x0530), (0x1E00, 0x2000), (0x2010, 0x2140), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]
_PRIVATE = 0xE000


def _spelled(char: str) -> str | None:
    """A letter by its name: its script's spelling, with the first letter raised for a capital."""
    words = unicodedata.name(char, "").split(" LETTER ")
    if len(words) != 2:
        return None
    script, _, size = words[0].partition(" ")
    table = {"GREEK": GREEK, "CYRILLIC": CYRILLIC}.get(script)
    name = words[1]
    found = table.get(name, table.get(name.split(" WITH ")[0])) if table else None
    return found and (found[0].upper() + found[1:] if size == "CAPITAL" else found)


def fold_char(char: str) -> str:
    """ASCII for one character; nothing for one that is not known."""
    if ord(char) < 128:
        return char
    if char in OTHERS:
        return OTHERS[char]
    if (found := _spelled(char)) is not None:
        return found
    parts = unicodedata.normalize("NFKD", char)
    return "" if parts == char else "".join(map(fold_char, parts))


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """All characters of the ranges that have ASCII of their own."""
    made = {chr(k): fold_char(chr(k)) for first, last in _RANGES for k in range(first, last)} | OTHERS
    return {c: s for c, s in made.items() if s and s.isascii()}


def to_ascii(text: Column) -> Column:
    """The text in ASCII; characters that the table does not know go. Null stays null."""
    known = table()
    several = sorted({s for s in known.values() if len(s) > 1})
    private = {s: chr(_PRIVATE + k) for k, s in enumerate(several)}
    whole = F.regexp_replace(text, r"[\x{E000}-\x{F8FF}]", "")
    folded = F.translate(whole, "".join(known), "".join(s if len(s) == 1 else private[s] for s in known.values()))
    for s, mark in private.items():
        folded = F.replace(folded, F.lit(mark), F.lit(s))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(text)
