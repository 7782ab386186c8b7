"""Exact, near and line deduplication against brute force on awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drift_atlas.llm import common, components, exact_dedup, line_dedup, near_dedup, textkit

from . import helpers as H


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, keep, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_SLICE_ROWS", 2)  # so that groups of three are split
    rows = H.awkward_rows() + [(100 + k, "hot text", "en", "a", 8) for k in range(40)]
    got = exact_dedup.exact_duplicates(H.documents(spark, rows), keep=keep).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(H.LOWER)].append(r[0])
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((r[0], best[t := (r[1] or "").translate(H.LOWER)], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows)
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("copies", [10, 64, 65, 300])
def test_exact_duplicates_with_string_ids_and_repeated_ids(spark, keep, copies):
    """At sizes on both sides of a slice: ids that are strings, one of them many times, and null ids."""
    rows = [(f"k{k:03}", "same") for k in range(copies)] + [("k000", "same")] * copies + [(None, "same")] * copies + [("z", "other")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), keep=keep).collect()
    same = [g for g in got if g.doc_id != "z"]
    best = "k000" if keep == "smallest" else f"k{copies - 1:03}"
    assert {(g.keep_id, g.group_size) for g in same} == {(best, 3 * copies)}
    assert [g.doc_id for g in same if g.kept] == [best] and len(got) == len(rows)


def test_exact_duplicates_empty(spark):
    out = exact_dedup.exact_duplicates(H.documents(spark, []))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0
    assert exact_dedup.drop_exact_duplicates(H.documents(spark, [])).count() == 0


def test_exact_duplicates_refuses_an_unknown_order(spark):
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(H.documents(spark, []), keep="any")


def test_near_duplicates(spark):
    rows = H.awkward_rows()
    got = near_dedup.near_duplicates(H.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = H.near_components(rows)
    for g in got:
        if g.doc_id is not None:
            assert (g.component_id, g.kept) == (want[g.doc_id], want[g.doc_id] == g.doc_id)
    assert Counter((g.doc_id, g.n_shingles) for g in got) == Counter((r[0], len(H.shingle_set(r[1]))) for r in rows)
    assert not any(g.kept for g in got if g.doc_id is None)


def test_near_duplicates_of_a_chain_and_a_crowd(spark):
    """A chain whose ends are no link of each other, and near copies of one text beyond any hub's reach."""
    rng = random.Random(4)
    source = H.prose(rng, 300).split(" ")
    rows = []
    for k in range(12):
        text = list(source)
        for j in range(k):
            text[j * 5 : j * 5 + 5] = [f"c{j}x{i}" for i in range(5)]
        rows.append((k, " ".join(text), None, None, None))
    for k in range(60):
        text = [w if rng.random() > 0.02 else f"e{k}" for w in source]
        rows.append((100 + k, " ".join(text), None, None, None))
    got = {g.doc_id: g.component_id for g in near_dedup.near_duplicates(H.documents(spark, rows)).collect()}
    assert got == H.near_components(rows)


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(H.documents(spark, [])).count() == 0
    blank = [(1, None, None, None, None), (2, " ", None, None, None)]
    assert [tuple(r) for r in near_dedup.near_duplicates(H.documents(spark, blank)).orderBy("doc_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    for share in (0.6, 0.75, 0.9):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, 2000 - len(both), dtype=np.uint64)
            half = len(rest) // 2
            a, b = np.concatenate((both, rest[:half])), np.concatenate((both, rest[half:]))
            x, y = (near_dedup.odd_sketch(near_dedup.minhash(np.unique(s))) for s in (a, b))
            apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            m, k = near_dedup.SKETCH_BITS, near_dedup.SAMPLES
            errors.append(1 + m / (4 * k) * np.log(max(1 - 2 * apart / m, 1e-9)) - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
        assert max(-min(errors), 0) < near_dedup.ESTIMATE_MARGIN


def test_components_match_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(k, k + 1) for k in range(500, 560)] + [(700, 700 + k) for k in range(50)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(H.LOWER)
    holders = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            for k in {key(line) for line in (r[1] or "").split("\n")}:
                if len(k) >= min_chars:
                    holders[k].append(r[0])
    lost = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if r[0] is None or key(x) not in lost or lost[key(x)] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [H.prose(rng, 6) for _ in range(8)] + ["ÀÉÎ" * 7, "short", "", "  " + "y" * 19]
    rows = H.awkward_rows() + [(200 + k, "\n".join(rng.choice(lines) for _ in range(12)), None, None, None) for k in range(30)]
    got = line_dedup.deduplicate_lines(H.documents(spark, rows)).collect()
    assert Counter(tuple(g) for g in got) == brute_lines(rows)
    assert line_dedup.deduplicate_lines(H.documents(spark, [])).count() == 0


def test_line_runs_are_levelled_and_admit_new_lines(spark):
    docs = spark.createDataFrame([(k, f"a line that is shared by all\na line of document {k} alone") for k in range(8)], "doc_id long, text string")
    postings = line_dedup.line_postings(docs, "doc_id", "text", 20)
    runs = line_dedup.LineRuns(spark, fanout=2)
    fresh = [runs.add(postings.where(F.col("id") % 4 == k)).count() for k in range(4)]
    assert fresh == [3, 2, 2, 2]
    assert [len(level) for level in runs.levels] == [0, 0, 1] and len(runs.repeats) <= 2
    assert {r.docs for r in runs.totals().collect()} == {1, 8}
    stored = spark.table(runs.levels[2][0])
    assert stored.count() == stored.select("h1", "h2").distinct().count() == 9
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_a_batch_meets_the_runs_without_moving_them(spark):
    """Only new hashes are admitted, and the anti-join and the merge have no exchange."""
    docs = spark.createDataFrame([(k, f"a line that is shared by all\nline number {k % 5} of the documents") for k in range(40)], "doc_id long, text string")
    postings = line_dedup.line_postings(docs, "doc_id", "text", 20)
    runs = line_dedup.LineRuns(spark, fanout=9)
    for k in range(3):
        runs.add(postings.where(F.col("id") % 3 == k))
    a, b, c = (spark.table(n) for n in runs.runs())
    assert (a.count(), b.count(), c.count()) == (6, 0, 0)
    for plan in (runs._new(a), line_dedup._both(a, b), runs.totals()):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.docs for r in runs.totals().collect()) == [8] * 5 + [40]
    runs.drop()


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB c\nDé\t") for _ in range(rng.randint(0, 50))) for _ in range(300)] + [None, "", "x" * 4000]
    raw, at = textkit.buffers(pa.array(texts))
    whole, offsets = textkit.word_hashes(raw, at)
    assert [int(b - a) for a, b in zip(offsets, offsets[1:], strict=False)] == [len(H.words(t)) for t in texts]
    monkeypatch.setattr(textkit, "SLICE_BYTES", 40)
    again, offsets_again = textkit.word_hashes(raw, at)
    assert (whole == again).all() and (offsets == offsets_again).all()


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_pairs_just_below_the_threshold_are_no_rows(spark, monkeypatch):
    """A crowd of variants of one text that are no links: only links leave the join of a bucket's members."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(400, 6, replace=False):
            words[at] = f"x{i}v{at}"
        rows.append((i, " ".join(words)))
    rows.append((60, rows[59][1] + " more"))
    sets = {i: set(near_dedup.shingle_set(t).tolist()) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    made, write = {}, common.materialize

    def noted(df, label):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(common, "materialize", noted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(H.documents(spark, rows)).collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert max(n for label, n in made.items() if label in ("cross-pairs", "cross-links")) <= len(linked)
