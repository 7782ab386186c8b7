"""Licence scans: the automaton and the operator against plain searches."""

import random

import pytest

from drift_atlas.llm import license_scan

from . import helpers as H


def brute_matches(text, templates):
    """(template, start, first, size) of all runs that are as long as they can be on both sides."""
    out = set()
    for t, own in enumerate(templates):
        for i in range(len(text)):
            for j in range(len(own)):
                if i and j and text[i - 1] == own[j - 1]:
                    continue
                size = 0
                while i + size < len(text) and j + size < len(own) and text[i + size] == own[j + size]:
                    size += 1
                if size >= license_scan.MIN_MATCH:
                    out.add((t, j, i, size))
    return out


def brute_chains(matches, n_templates):
    """Most covered words of a chain ending in each match, comparing all matches."""
    done = []
    for t, start, first, size in sorted(matches, key=lambda m: (m[2] + m[3], m[2], m[0], m[1])):
        best = size
        for u, at, one, many, covered in done:
            if u == t and one + many < first + size and at + many < start + size and first - one - many <= license_scan.MAX_GAP:
                gain = size - max(0, one + many - first, at + many - start)
                best = max(best, covered + gain if gain > 0 else 0)
        done.append((t, start, first, size, best))
    return sorted(done)


def brute_base(text):
    w = license_scan.words(text)
    found = [(k, label) for phrase, label in license_scan.BASE_PHRASES for n in [len(phrase.split(" "))] for k in range(len(w) - n + 1) if w[k : k + n] == phrase.split(" ")]
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def some_texts(seed):
    rng = random.Random(seed)
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = [r[1] for r in H.awkward_rows()]
    texts += ["MIT License", "the mit-license; Apache\nLicense", "General  Public LICENSE general public license", "mitlicense MIT Licenses", "é mit license é", "MİT License", "general public", "apache license" * 3]
    for k in range(60):
        words = rng.choice(notices).split(" ")
        if k % 3:
            words = [w for w in words if rng.random() > 0.05]
        if k % 4 == 0:
            words = [w if rng.random() > 0.04 else rng.choice(["the", "software", "of", "zzz"]) for w in words]
        if k % 5 == 0:
            words = words[: rng.randint(3, len(words))] + rng.choice(notices).split(" ")
        texts.append(H.prose(rng, rng.randint(0, 30)) + " " + " ".join(words) + rng.choice([" ", "\n"]) + H.prose(rng, 5))
    return texts


def test_automaton_against_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        templates = [[rng.randint(1, 4) for _ in range(rng.randint(1, 14))] for _ in range(4)]
        automaton = license_scan.Automaton()
        for t in templates:
            automaton.add(t)
        text = [rng.randint(1, 5) for _ in range(60)]
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for k, (_, run) in enumerate(automaton.walk(text)):
            assert run == max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in runs))


@pytest.mark.parametrize("seed", range(4))
def test_matches_and_chains_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [("x", " ".join(rng.choice("abcd") for _ in range(rng.randint(4, 16)))) for _ in range(3)]
    known = license_scan.Licences(texts, [])
    number = {w: n for s, (_, t) in zip(known.templates, texts) for w, n in zip(t.split(" "), s)}
    text = " ".join(rng.choice("abcdx") if rng.random() < 0.3 else rng.choice(texts)[1] for _ in range(30))
    numbers = [number.get(w, 0) for w in text.split(" ")]
    seen = []
    real = license_scan.chain_matches
    try:
        license_scan.chain_matches = lambda m: seen.append(sorted(m)) or real(m)
        import numpy as np

        license_scan.scan_words(known, np.array(numbers), np.array([0, len(numbers)]))
    finally:
        license_scan.chain_matches = real
    want = brute_matches(numbers, known.templates)
    assert set(seen[0]) == want and len(seen[0]) == len(want)
    chains = sorted((c.template, c.template_last, c.last, c.match_first, c.covered) for c in real(seen[0]))
    assert chains == sorted((t, start + size - 1, first + size - 1, first, best) for t, start, first, size, best in brute_chains(want, 3))


def test_scan_against_plain_search(spark):
    texts = some_texts(1)
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, "mit license", None, None, None), (3, texts[3], None, None, None)]
    got = license_scan.scan_licences(H.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in rows:
        by[r[0], r[1]] = brute_base(r[1])
    for g in got:
        text = "mit license" if g.doc_id is None else texts[g.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == by[g.doc_id, text]
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1 and (g.score == 1) >= (g.n_base > 0) and (g.score > 0) == (g.labels != "")
        assert {s.label for s in g.spans} | set(filter(None, g.base_labels.split(","))) == set(filter(None, g.labels.split(",")))


def test_whole_and_edited_notices_are_found_and_prose_is_not(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k, (label, notice) in enumerate(license_scan.TEMPLATES):
        words = notice.split(" ")
        if len(words) > 20:
            words[len(words) // 2] = "edited"
        rows.append((k, H.prose(rng, 50) + "\n" + "  ".join(words).upper() + "\n" + H.prose(rng, 50), None, None, None))
        want[k] = label
    plain = "the software is a work of the authors and this file is free to use in any form by any person with the rest of it "
    rows += [(500 + k, H.prose(rng, 300) + plain * (k + 1), None, None, None) for k in range(10)]
    got = {g.doc_id: g for g in license_scan.scan_licences(H.documents(spark, rows)).collect()}
    for k, label in want.items():
        assert label in got[k].labels.split(",")
        assert any(s.template == k and s.first_word == 50 and s.last_word - 49 == len(license_scan.words(rows[k][1])) - 100 for s in got[k].spans)
    assert all(got[500 + k].labels == "" and got[500 + k].score == 0 and not got[500 + k].spans for k in range(10))


def test_empty_tables_and_string_ids(spark):
    assert license_scan.scan_licences(H.documents(spark, [])).count() == 0
    out = license_scan.scan_licences(spark.createDataFrame([("a", "MIT License"), ("b", None)], "name string, body string"), "name", "body").collect()
    assert [(r.name, r.n_words, r.base_labels) for r in out] == [("a", 2, "mit"), ("b", 0, "")]
