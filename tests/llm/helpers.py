"""Small tables with every awkward row, and brute-force forms of the contracts."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {k: k + 32 for k in range(65, 91)}
SPACE = re.compile("[\x20\x09-\x0d]+")
#: Names that operators use inside; as further columns they must do no harm.
CLASHES = ["id", "h", "salt", "norm", "kept", "component", "batch", "bands", "sketch", "rate", "p0", "__t", "__id", "__text", "n", "w", "l", "file", "digest"]


def words(text):
    return [w for w in SPACE.split((text or "").translate(LOWER)) if w]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_rows(seed=1):
    """Nulls, empties, blanks, a very long text, a very long word, copies, near copies, ties and repeated rows."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    other = prose(rng, 200).split(" ")
    near = [" ".join(w if i != k * 37 + 9 else f"edit{k}" for i, w in enumerate(other)) for k in range(5)]
    texts = [
        None, "", " \t\n", base, base.upper(), base, "one two three", "One  two\nthree", "É é E e", "é É e E",
        *near, prose(rng, 20_000), "x" * 150_000, "line that is long enough to count\nshort\nline that is long enough to count",
        "line that is long enough to count\nmore", "LINE that is long enough to count  \n\nend", "#$% <b> & | *", "1234 5678 !!!",
    ]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", None)[k % 2], len(t) if t else None) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base, None, None, None), (None, None, None, None, None)]


def documents(spark, rows=None, clash=True):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}) if clash else df


def labels(spark, rows=None):
    made = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 22)] + [(None, 1, 0), (3, None, None), (999, 0, 1), (4, 1, 1), (4, 0, 1)]
    return spark.createDataFrame(made if rows is None else rows, "doc_id long, quality int, toxic int")


def shingle_set(text):
    w = words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def near_components(rows):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingle_set(r[1]))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for s in sets[a]:
                for t in sets[b]:
                    both = len(s & t)
                    if s and t and 100 * both >= 75 * (len(s) + len(t) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
