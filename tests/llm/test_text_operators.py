"""Quality rules, language identification, BPE and HTML extraction."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from drift_atlas.llm import bpe, html_extract, language_id, quality_rules, registry

from . import helpers as H


def brute_statistics(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {i for v in where.values() if len(v) > 1 for k in v for i in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_text_statistics(spark):
    rng = random.Random(5)
    rows = H.awkward_rows() + [(300 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) + "\n" * (k % 3) + "a b\na b", None, None, None) for k in range(40)]
    got = quality_rules.apply_quality_rules(H.documents(spark, rows), H.labels(spark)).collect()
    want = sorted(((r[0] is None, r[0] or 0), *brute_statistics(r[1])) for r in rows)
    assert sorted(((g.doc_id is None, g.doc_id or 0), g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        assert not (g.base_failed and g.kept)


def test_quality_rules_learn_and_leave_clean_documents(spark):
    rng = random.Random(6)
    clean = [(k, H.prose(rng, 60), None, None, None) for k in range(60)]
    junk = [(100 + k, " ".join(w + "###" for w in H.prose(rng, 60).split(" ")), None, None, None) for k in range(30)]
    labels = H.labels(spark, [(r[0], int(r[0] < 100), 0) for r in clean + junk if r[0] % 2])
    got = {r.doc_id: r.kept for r in quality_rules.apply_quality_rules(H.documents(spark, clean + junk), labels).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk)


def test_quality_verdict_against_brute_force(spark):
    """The list read rule by rule in Python gives the verdict of the CASE expression, and rows that stay are those it keeps."""
    rng = random.Random(16)
    rows = [(k, H.prose(rng, rng.randint(5, 80)) + rng.choice(["", " ## **", " a b c d e f g h a b c d e f g h"]) * rng.randint(0, 6), None, None, None) for k in range(160)]
    docs, labels = H.documents(spark, rows), H.labels(spark, [(k, int("#" not in r[1]), 0) for k, r in enumerate(rows) if k % 2])
    sample = quality_rules.labelled_rows(docs, labels, "doc_id", "text", "quality", 1000)
    rules = quality_rules.learn_rules(sample)
    assert rules
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs, labels).collect()}
    for k, text, *_ in rows:
        n, chars, symbols, again, covered = brute_statistics(text)
        lines = [x for x in text.split("\n") if x.strip()]
        f = {"symbols_per_word": symbols / max(n, 1), "repeat_share": covered / max(n, 1), "dup_line_share": again / max(len(lines), 1), "word_length": chars / max(n, 1), "capital_share": 0.0, "distinct_share": len(set(text.split())) / max(n, 1), "words": float(n), "words_per_line": n / max(len(lines), 1)}
        fires = any(all((f[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)
        failed = n < 20 or 100 * covered > 30 * n
        assert (got[k].base_failed, got[k].kept) == (failed, not failed and not fires)
    assert sorted(r.doc_id for r in quality_rules.keep_good_rows(docs, labels).collect()) == sorted(k for k, g in got.items() if g.kept)


def test_quality_rules_without_labels_or_documents(spark):
    out = quality_rules.apply_quality_rules(H.documents(spark), H.labels(spark, []))
    assert all(r.kept == (not r.base_failed) for r in out.collect())
    assert quality_rules.apply_quality_rules(H.documents(spark, []), H.labels(spark)).count() == 0


def test_language_id_held_out_accuracy(spark):
    rng = random.Random(8)
    letters = {"en": "the and of ing tion er", "de": "ung sch ein der ß ü", "fr": "eau é è que oi le"}
    rows = []
    for k in range(400):
        lang = sorted(letters)[k % 3]
        text = " ".join("".join(rng.choices(letters[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80)))
        rows.append((k, text, lang, None, None))
    docs = H.documents(spark, rows + H.awkward_rows()[:3])
    model = language_id.train(docs.where("doc_id % 4 <> 2 and lang is not null"))
    got = {r.doc_id: r for r in language_id.predict(docs.where("doc_id >= 3"), model).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and r[0] >= 3]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())


def test_language_id_learns_from_whole_texts(spark):
    rows = [(k, "lorem ipsum " * 400 + ("bonjour monde entier " if k % 2 else "hello whole world ") * 400, "fr" if k % 2 else "en", None, None) for k in range(40)]
    model = language_id.train(H.documents(spark, rows).selectExpr("doc_id", "text", "if(doc_id % 2 = 1, 'fr', 'en') AS lang"))
    got = language_id.predict(H.documents(spark, rows), model, reject_below=0.0).collect()
    assert all(r.lang_pred == ("fr" if r.doc_id % 2 else "en") for r in got)


def test_language_id_sample_does_not_depend_on_ids(spark):
    """Many rows of one id, on both sides of the size at which rows are left out."""
    for n in (60, 900):
        rows = [(7, f"bonjour monde entier {k}" if k % 2 else f"hello whole world {k}", "fr" if k % 2 else "en", None, None) for k in range(n)]
        docs = H.documents(spark, rows)
        model = language_id.train(docs, sample_rows=200)
        assert model.languages == ("en", "fr")
        got = language_id.predict(docs, model, reject_below=0.0).select("lang_pred").toPandas()["lang_pred"]
        assert (got == ["fr" if k % 2 else "en" for k in range(n)]).mean() > 0.99


def test_language_id_predictions_against_brute_force(spark):
    """Scores text by text, with grams cut out of the words, and a tie that goes to the first language."""
    rng = random.Random(3)
    rows = [(k, H.prose(rng, 30) + ("ß über" if k % 2 else "où été"), "de" if k % 2 else "fr", None, None) for k in range(80)] + [(90, "A1 é-B", None, None, None)]
    docs = H.documents(spark, rows)
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model, reject_below=0.0).collect()}
    for k, text, *_ in rows:
        grams = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            edged = f"\0{word}\0"
            grams += [edged[i : i + n] for n in (1, 2, 3) for i in range(len(edged) - n + 1) if edged[i : i + n].strip("\0")]
        # Neighbouring words share their boundary mark, so a gram over it is none; marks alone count for nothing.
        counts = np.zeros(language_id.BUCKETS)
        for g in grams:
            codes = np.array([0 if c == "\0" else ord(c) for c in g], np.uint32)
            h = np.array([len(g)], np.uint32)
            for i, c in enumerate(codes):
                h = (h ^ c) * language_id._MUL[i]
                h ^= h >> np.uint32(15)
            counts[int(h[0]) & (language_id.BUCKETS - 1)] += 1
        z = (counts @ model.table / counts.sum() + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert abs(got[k].score - p.max()) < 1e-6 and got[k].lang_pred == model.languages[int(p.argmax())]
    flat = language_id.Model(("aa", "bb"), np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2), 1.0)
    tied = language_id.predict(docs, flat, reject_below=0.5).collect()
    assert {(r.lang_pred, r.score) for r in tied} == {("aa", 0.5)}


def test_language_id_rejection_is_calibrated(spark):
    """Scores of held-out texts of mixed difficulty match how often they are right, and what is rejected is wrong more often."""
    rng = random.Random(9)
    rows = []
    for k in range(3000):
        lang = rng.choice(["x", "y"])
        share = rng.choice([0.5, 0.6, 0.75, 1.0])
        own, other = ("abcd", "bcde") if lang == "x" else ("bcde", "abcd")
        rows.append((k, " ".join("".join(rng.choice(own if rng.random() < share else other) for _ in range(4)) for _ in range(6)), lang, None, None))
    docs = H.documents(spark, rows)
    model = language_id.train(docs.where("doc_id % 3 > 0"))
    truth = {r[0]: r[2] for r in rows}
    got = [r for r in language_id.predict(docs.where("doc_id % 3 = 0"), model, reject_below=0.0).collect()]
    score, right = np.array([r.score for r in got]), np.array([r.lang_pred == truth[r.doc_id] for r in got])
    bins = np.minimum((score * 5).astype(int), 4)
    error = sum(abs(score[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert error < 0.08
    kept = [r for r in language_id.predict(docs.where("doc_id % 3 = 0"), model, reject_below=0.8).collect() if r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in kept]) > right.mean() + 0.02 and len(kept) < len(got)


def test_language_id_awkward_rows_and_rejection(spark):
    docs = H.documents(spark)
    nothing = language_id.train(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, nothing).collect()} == {("und", 0.0)}
    model = language_id.train(docs.where("lang is not null"))
    got = language_id.predict(docs, model, reject_below=0.0).collect()
    assert len(got) == len(H.awkward_rows())
    unsaid = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 1, 2} <= unsaid and 21 in unsaid and 3 not in unsaid
    assert all(r.lang_pred == "und" for r in language_id.predict(docs, model, reject_below=1.1).collect())
    assert language_id.predict(H.documents(spark, []), model).count() == 0


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_spec(registry.tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


ALPHABET = ["a", "b", "th", "e", " ", "\n", "ing", "É", "ß", "Σ", "İ", "😂", "🇺🇸", "'s", "'", "1", "２", "<|endoftext|>", "<|start", "\x1c", "\x85", "\xa0", "é", "中", "한", "ﬁ", "!!!", "...", "​", "ΑΣ", "_"]


def test_bpe_equals_the_library(merges, library):
    rng = random.Random(3)
    encoder = bpe.Encoder(merges)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "x" * 3000, "ha" * 70_000, H.prose(rng, 20_000)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == e.ids
        decoder = bpe.Decoder(merges)
        parts = [decoder.feed(ids[k : k + 7]) for k in range(0, len(ids), 7)]
        assert "".join(parts) == library.decode(ids, skip_special_tokens=False)


def test_tokens_fit_where_merging_leaves_both(merges):
    """The walk along two edges against merging the symbols of both tokens."""
    rng = random.Random(11)
    whole = [i for i in rng.sample(sorted(merges.names), 4000) if i not in merges.special.values() and merges.whole(i)]
    left = [i for i in whole if not merges.names[i].endswith(merges.suffix)]
    seen = Counter()
    texts = [merges.names[i] for i in left]
    for k in range(6000):
        a, b = rng.choice(left), rng.choice(whole)
        if k % 2:  # neighbours that were cut out of one token
            t = rng.choice(texts)
            cut = rng.randint(1, max(1, len(t) - 1))
            a, b = merges.vocab.get(t[:cut]), merges.vocab.get(t[cut:])
            if a is None or b is None or not (merges.whole(a) and merges.whole(b)):
                continue
        want = merges.merge(merges._initial(a) + merges._initial(b)) == [a, b]
        assert merges.fits(a, b) == want
        seen[want] += 1
    assert min(seen[True], seen[False]) > 200


def test_every_word_passes_the_transducer(merges, monkeypatch):
    fed = []
    plain = bpe.WordTransducer.feed
    monkeypatch.setattr(bpe.WordTransducer, "feed", lambda self, letters: fed.append(letters) or plain(self, letters))
    bpe.Encoder(merges).encode("a few short words " + "x" * 500)
    assert fed == ["a", "few", "short", "words", "x" * 500]


def test_windows_hold_bounded_stretches(merges, library, monkeypatch):
    """Windows join to the text, stay short where a word may end, and the ids do not depend on them."""
    rng = random.Random(12)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    for kind in (["a", "中", "。", "é", "1", "'s", "-", "한", "  "], ["中", "文", "、"], ["ab ", "c\n"]):
        text = "".join(rng.choice(kind) for _ in range(3000))
        parts = list(bpe.Encoder.windows(memoryview(text.encode())))
        assert "".join(parts) == text and max(len(p.encode()) for p in parts) <= 64 * 10
        assert np.frombuffer(bpe.Encoder(merges).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_transducer_equals_merging_with_bounded_memory(merges):
    rng = random.Random(4)
    for _ in range(60):
        kind = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "a", "thein", "😂🇺", "éèç"])
        letters = "".join(bpe.LETTERS[b] for b in "".join(rng.choice(kind) for _ in range(rng.choice([1, 2, 40, 300, 1500]))).encode())
        transducer, out, held = bpe.WordTransducer(merges), [], 0
        for c in letters:
            out += transducer.feed(c)
            held = max(held, len(transducer.text))
        assert out + transducer.close() == merges.merge(merges.symbols(letters))
        assert held <= merges.lookahead + merges.longest + 2 * transducer.check_every


def test_decoder_gives_text_back(merges):
    text = "the naïve café — 中文 😂 end"
    ids = np.frombuffer(bpe.Encoder(merges).encode(text), "<u4").tolist()
    decoder = bpe.Decoder(merges, "text")
    assert ("".join(decoder.feed([i]) for i in ids) + decoder.close()).split() == text.split()


def test_bpe_awkward_rows(spark, library):
    rows = H.awkward_rows()
    got = registry.bpe_digests(H.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted(g.n_tokens for g in got) == sizes
    assert registry.bpe_digests(H.documents(spark, [])).count() == 0


PAGES = [
    ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class=\"ad\">buy now</div><article><h1>Title</h1><p><b>One<br><p>two  &amp;\n three.</p></article><footer>&copy; x</footer>", "Title One two & three."),
    ("<body><header>site</header><div id='sidebar'>side<div>in</div></div><article class='post'><p>a<b>b</b>c</p><aside>no</aside><form><p>f</p></form><div class='comments'><p>first!</p></div><p>end</p></article>", "abc end"),
    ("<div class='cookie-notice'>We use cookies</div><main><p>Hi &lt;b&gt;</p><!-- <p>x</p> --></main><section class='comment-list'>me too</section>", "Hi <b>"),
    ("<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><p>" + "Body text goes on and on. " * 4 + "</p><p>Short.</p><p>" + "More text to the end. " * 4 + "</p><p><a href=x>next page</a></p>", " ".join((("Body text goes on and on. " * 4).strip(), "Short.", ("More text to the end. " * 4).strip()))),
    ("<article><p class=ad>Buy<p>One<figure><figcaption>Caption</figcaption></figure><ul><li class='promo'>x<li>Two</ul></article>", "One Caption Two"),
    ("<nav><a href=x>menu</a><article><p>Text</article><div class='sidebar'>never closed<p>x", "Text"),
    ("plain text only", "plain text only"), (None, ""), ("", ""), ("<p>", ""), ("<", "<"), ("<script>never closed", ""), ("<!-- never closed", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_text_outside_an_article_is_judged_by_length():
    words, tail = ("word " * 2000).strip(), "".join(f"<p>{x}</p>" for x in "uvwxyz")
    assert words in html_extract.main_text(f"<article class='teaser'>short</article><div class='content'>{words}</div>")
    assert html_extract.main_text(f"<main><h1>Title</h1></main><div>{words[:99]}</div>") == f"Title {words[:99]}"
    assert html_extract.main_text(f"<p>Our site</p><article><p>{words}</p>{tail}</article><p>Made by us</p>") == f"{words} u v w x y z"


LONG = ("Sentences of an article go on. " * 9).strip()


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div class='content no-sidebar'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='hasSidebar'><p>{LONG}</p></div>", LONG),
        (f"<form id='search'><div class='comments'><main><p>{LONG}</p></main></div></form>", LONG),
        (f"<article><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>It works.</p></section><h2 id='privacy'>Privacy</h2><p>{LONG}</p></article>", f"{LONG} Discussion It works. Privacy {LONG}"),
        (f"<article><p>{LONG}</p><p class='teaser'>{LONG}</p><div class='tags'><a href=x>one</a> <a href=y>two</a></div></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p></article><div class='comments'><p>{LONG}</p></div><div class='cookie-notice'>We use cookies to improve your visit to this site.</div>", LONG),
        (f"<div class='promo-page'><p>{LONG}</p></div><p>Made by us</p>", f"{LONG} Made by us"),
        (f"<p>{LONG} The <span class='search'>query</span> box.</p><p><span class='ad'>Buy</span></p>", f"{LONG} The query box."),
        (f"<div class='sidebar'>x<nav>never closed<div>y</div></div><p>{LONG}</p>", LONG),
        (f"<div class='comments'><p>One.<div>Two.</div></p>Three.</div><p>{LONG}</p>", LONG),
    ],
)
def test_words_only_make_an_element_suspect(page, want):
    assert html_extract.main_text(page) == want


def test_extract_text_rows(spark):
    rows = [(k, f"u{k}", p) for k, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0]), (None, None, None), (99, "u", "<p>" + "word " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    got = html_extract.extract_text(pages).collect()
    assert len(got) == len(rows)
    assert sorted(g.text for g in got if g.page_id == 0) == [PAGES[0][1]] * 2
    assert all(g.n_chars == len(g.text) for g in got)
    assert next(g for g in got if g.page_id == 99).n_chars == 60_000 * 5 - 1
    assert html_extract.extract_text(pages.where("false")).count() == 0
