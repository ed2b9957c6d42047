"""Scoring, tokenizing, scanning and extraction operators against brute force."""

import base64
import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter

import pytest

from quern.llm import bpe, decontaminate, licences, ngram_lm, toxicity, warc, wrappers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, batch int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in texts], DOCS)


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (5, "Ünïcödé 漢字 \U0001f600 x\u0000y"), (6, "a " * 70_000 + "end"), (7, "x" * 90_000), (8, "All rights reserved. CC BY. cc-by cc by General Public\nLicense")]


def test_language_model(spark):
    public = [(i, " ".join(f"w{(i * k) % 7} the" for k in range(1, 6))) for i in range(40)]
    texts = [x for x in HARD + [(i + 100, t) for i, t in public]]
    got = ngram_lm.score(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["<end>"]
    counts = Counter(w for i, t in texts if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id > 100]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert ngram_lm.score(frame(spark, [])).count() == 0


def test_interpolation_weights_follow_the_held_out_counts():
    grid = (2 * ngram_lm.BINS + 1)
    told = (5 * (ngram_lm.BINS + 1) + 1) * grid + 3  # the pair foretells the word
    silent = (6 * (ngram_lm.BINS + 1) + 0) * grid + 3  # it doesn't
    weights = ngram_lm.learn([(told, 1000), (silent, 1000)], 10_000, 500)
    assert weights[5][0] > 0.9 and weights[6][0] < 0.01
    assert abs(weights.sum(axis=1) - 1).max() < 1e-9


RANKS = {bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257, b" the": 258, b"in": 259}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def test_byte_pairs(spark, tmp_path):
    import tiktoken

    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in RANKS.items()))
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = [*HARD, (9, "the thing's   in\n\n the <|endoftext|> " * 3000), (10, " " * 40_000 + "x"), (11, "a" + " \n" * 30_000)]
    got = bpe.digests(frame(spark, texts), str(path), PATTERN).collect()
    expected = []
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        assert plain.decode_bytes(ids) == (t or "").encode()
        expected.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(expected)
    assert bpe.digests(frame(spark, []), str(path), PATTERN).count() == 0


def test_safe_pieces_join_to_the_text():
    text = ("word  two\n\nthree" * 50 + "   ") * 20
    pieces = [x for x, _ in bpe.safe_pieces(text, 100)]
    assert "".join(pieces) == text and len(pieces) > 50
    assert all(not a[-1].isspace() and b[0].isspace() for a, b in zip(pieces, pieces[1:]))


def test_long_runs_of_white_space(spark, tmp_path):
    import tiktoken

    path = tmp_path / "ranks"
    ranks = RANKS | {b"  ": 260, b"    ": 261, b"\n\n": 262, b" \n": 263}
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    # The library itself takes runs of some hundred thousand characters.
    runs = [" " * 40_000, " \n" * 20_001, "\u3000" * 33_000, "\x1c" * 33_000, " " * 32_768, "\t" * 32_767]
    texts = [a + run + b for run in runs for a, b in (("", ""), ("a", "b"), ("!", "!"), ("", " b"), ("x y\x1c!", "\n1"))]
    texts.append(" the in " * 9000 + runs[0] + "the" + runs[1] + "'s")
    got = {r.doc_id: r for r in bpe.encode(frame(spark, enumerate(texts)), str(path), PATTERN).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == b"".join(x.to_bytes(4, "little") for x in plain.encode_ordinary(text)), i
    # Beyond that the ids are those of the one match.
    long = [" " * 2_000_000 + "the", " \n" * 1_000_000]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, enumerate(long)), str(path), PATTERN).collect()}
    assert got[0].ids == b"".join(x.to_bytes(4, "little") for x in [*plain._encode_single_piece(" " * 1_999_999), 258])
    assert got[1].ids == b"".join(x.to_bytes(4, "little") for x in plain._encode_single_piece(long[1]))


def test_license_scan(spark):
    mit = licences.TEMPLATES[6][1]
    edited = mit.replace("free of charge", "entirely free of any charge").replace("sublicense, ", "")
    texts = [*HARD, (20, "intro words " * 9 + mit), (21, "x y " + edited + " z"), (22, "Permission is hereby granted"), (23, "general public\x7flicense GENERAL PUBLIC LICENSE general public"), (24, "Licensed under the Apache License, Version 2.0")]
    got = licences.scan(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    expected = []
    for i, t in texts:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in licences.PHRASES.items() for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in hits]
        expected.append((i, len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(expected)
    labels = {r.doc_id: r.labels for r in got}
    assert (labels[20], labels[21], labels[22], labels[24]) == ("mit", "mit", "", "apache-2.0")
    assert all(0 <= r.score <= 1 for r in got)
    span = next(r for r in got if r.doc_id == 20).spans[0]
    assert (span.first_word, span.last_word) == (18, 18 + len(licences.words(mit)[: licences.PART_WORDS]) - 1)
    assert licences.scan(frame(spark, [])).count() == 0


def test_toxicity(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(3, 8)))
    texts, marks = [], []
    for i in range(600):
        own = [word() for _ in range(rng.randrange(10, 60))]
        bad = i % 5 == 0
        kind = rng.randrange(3)
        for _ in range(3 * bad):
            own.insert(rng.randrange(len(own)), ["Dreck!", "vilebx" + word(), "MUCK"][kind])
        texts.append((i, " ".join(own)))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*texts, *((i and i + 1000, t) for i, t in HARD)])
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) + len(HARD)
    truth = {i: t for i, _, t in marks}
    fresh = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(fresh) > 80 and all(r.predicted == truth[r.doc_id] for r in fresh)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    for r in fresh:
        for s in r.spans:
            assert re.search("dreck|vilebx|muck", dict(texts)[r.doc_id][s.start : s.end].lower())
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_the_model_is_the_same_whatever_the_order_of_ties(spark):
    """An id with several labels has the least, one with several texts the least text."""
    rows = [(i, f"you utter {'scum' if i % 2 else 'friend'} number {i}") for i in range(80)] + [(1, "another text scum"), (1, "another text scum"), (3, None)]
    labels = [(i, i % 2) for i in range(80)] + [(1, 0), (2, 1), (2, None)]
    models = []
    for turn in (1, -1):
        docs, told = frame(spark, rows[::turn]), spark.createDataFrame(labels[::turn], "doc_id bigint, toxic int")
        models.append(toxicity.train(docs, told))
    a, b = models
    assert (a.features == b.features).all() and (a.weights == b.weights).all() and (a.layer == b.layer).all()
    assert toxicity.train(docs, told.where("toxic = 1")) is None
    assert toxicity.train(docs, told, chars=0) is None


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np
    import pyarrow as pa

    texts = pa.array(["bad words in bad company here"])
    features, places, _, _ = toxicity.word_features(texts)
    kinds = np.unique(features[[0, 4]])
    kinds = kinds[kinds != 0]
    model = toxicity.Model(kinds, np.linspace(1, 2, len(kinds)), -1.3, np.array([[0.4, -0.2], [-0.6, 0.9]]), np.zeros(3))
    emit = [model.bias + sum(model.weights[list(kinds).index(f)] for f in row if f in kinds) for row in features]
    weight = {}
    for y in itertools.product((0, 1), repeat=len(emit)):
        s, before = 0.0, 0
        for a, e in zip(y, emit):
            s += model.trans[before, a] + a * e
            before = a
        weight[y] = math.exp(s)
    total = sum(weight.values())
    [(_, _, found)] = list(toxicity.marginals(model, features, places))
    assert found
    for k, p in found:
        assert abs(p - sum(w for y, w in weight.items() if y[k]) / total) < 1e-9


def test_decontamination(spark):
    item = "The train from Berlin leaves at 14:30 and travels 120 km in two hours before it stops near a small river"
    same = item.replace("Berlin", "Madrid").replace("14:30", "9:15").replace("120", "87")
    twice = "Anna has 3 apples and gives 3 apples to her friend while Anna keeps walking along the quiet road"
    items = spark.createDataFrame([(1, item), (2, twice), (3, None), (4, ""), (5, "Berlin Paris Rome"), (6, "tiny item")], "item_id bigint, text string")
    pad = "some other words that mean nothing at all, "
    texts = [*HARD, (20, pad + item + pad), (21, pad + same), (22, twice.replace("3", "4")), (23, twice.replace("gives 3", "gives 4").replace("Anna has", "Berta has")), (24, pad * 4), (25, "here is a tiny item again"), (26, " ".join(item.split()[:6])), (27, item.replace("leaves", "slowly leaves"))]
    got = {r.doc_id: sorted(r.item_ids) for r in decontaminate.scan(frame(spark, texts), items).collect()}
    assert {i: got[i] for i in range(20, 28)} == {20: [1], 21: [1], 22: [2], 23: [], 24: [], 25: [6], 26: [], 27: [1]}
    assert decontaminate.scan(frame(spark, texts), items).count() == len(texts)
    assert decontaminate.scan(frame(spark, []), items).count() == 0
    assert {r.contaminated for r in decontaminate.scan(frame(spark, texts), items.where("item_id IS NULL")).collect()} == {False}


def leaks_of(spark, texts, items):
    found = decontaminate.scan(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
    return {r.doc_id: sorted(r.item_ids) for r in found.collect()}


def test_decontamination_in_other_case(spark):
    item = "The train from Berlin leaves at 14:30 and travels 120 km in two hours before it stops near a small river"
    names = "Anna Berta and Clara met Dora Emil and Fritz near Gotha Halle and Ilmenau with Karl Ludwig and Maria"
    fewer = "Rolf Sven and Tina saw Ute walk through the old quiet street while Vera Wim and Xaver met Yves Zoe and Alma"
    other = re.sub(r"[A-Z]\w+", lambda m: m[0][::-1].capitalize(), fewer)
    texts = [(1, item.upper()), (2, item.lower()), (3, item.upper().replace("120", "87")), (4, "so " + names.lower()), (5, names.upper()), (6, other), (7, "NOTHING OF THAT KIND " * 9)]
    assert leaks_of(spark, texts, [(1, item), (2, names), (3, fewer)]) == {1: [1], 2: [1], 3: [1], 4: [2], 5: [2], 6: [3], 7: []}


def test_decontamination_checks_every_place(spark):
    item = "Anna has 3 apples and gives 3 apples to her friend while Anna keeps walking along the quiet road"
    wrong = item.replace("gives 3", "gives 4").replace("Anna has", "Berta has")
    drill = "red 1 blue red 2 blue red 3 blue red 4 blue and then red 5 once more today"
    texts = [(1, wrong + ", but then: " + item), (2, wrong + " and " + wrong), (3, wrong + " or " + item.replace("3", "8")), (4, drill), (5, "x " * 50 + drill + " " + wrong + " " + drill)]
    assert leaks_of(spark, texts, [(1, item), (2, drill)]) == {1: [1], 2: [], 3: [1], 4: [2], 5: [2]}


def test_decontamination_of_items_with_few_literals(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "12 34 56 78 90 11 13"), (3, "Berlin Paris Rome"), (4, "120 km"), (5, "3 4 5 and 6 7 km 8 9 or 10 11 12")]
    texts = [(1, "so who wrote Hamlet? nobody"), (2, "x 12 34 56 78 90 11 13 y"), (3, "in BERLIN PARIS ROME"), (4, "after 120 km"), (5, "1 2 3 4 5 6 7"), (6, "Who wrote Faust? 121 km Berlin Rome"), (7, "3 4 5 and 6 7 km 8 9 or 10 11 12")]
    assert leaks_of(spark, texts, items) == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [], 7: [5]}
    assert leaks_of(spark, [(1, "A TINY ITEM"), (2, "tiny")], [(1, "a tiny item")]) == {1: [1], 2: []}


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><script>var a="</p><article>";</script><style>p{{}}</style></head><body>
<header class=top>Site name</header><nav><ul><li><a href=/a>Home {n}</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div class="{main}"><h1>Title  &amp; {n}</h1><p>First   paragraph<br>of {n} &#8211; caf&eacute;<p>Second <b>bold</b>, see <a href=x>link</a> {n}.<div class=promo>Buy {n}</div>
<ul><li>point one {n}<li>point two</ul><p>Share this page</p><form><p>mail {n}</p></form></div><div class="comments"><p>Nice {n}!</p></div>
<aside>Related {n}</aside><footer>&copy; {n}</footer></body></html>"""


@pytest.mark.parametrize("main", ["content", "story-body", "zzz"])
def test_wrapper_induction(spark, main):
    rows = [(n, f"https://Site.example.com/{n}", PAGE.format(n=f"x{n}", main=main)) for n in range(12)]
    rows += [(20, None, None), (21, "no url", ""), (22, "http://other.example.com/", "plain words < 3"), (23, "http://other.example.com/b", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id bigint, url string, html string, slots int, host string")
    got = {r.page_id: r for r in wrappers.extract(pages).collect()}
    assert len(got) == len(rows)
    for n in range(12):
        want = [f"Title & x{n}", f"First paragraph of x{n} – café", f"Second bold, see link x{n}.", f"point one x{n}"]
        assert got[n].text == "\n\n".join(want) and got[n].n_chars == len(got[n].text)
    assert (got[20].text, got[21].text, got[22].text, got[23].n_chars) == ("", "", "plain words < 3", 249_999)
    assert wrappers.extract(pages.where("page_id < 0")).count() == 0


def test_every_constant_text_of_a_slot_is_template(spark):
    page = "<html><body><div class=content><p>Text {n}</p><p>Share this page</p><p>All rights reserved</p></div></body></html>"
    rows = [(n, "http://a.example.com/", page.format(n=n)) for n in range(12)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {n: f"Text {n}" for n in range(12)}


@pytest.mark.parametrize("first", [None, "<html><body><h1>Error 500</h1></body></html>"])
def test_a_poor_first_page_hides_no_template(spark, first):
    page = "<html><body><div class=content><h2>Title {n}</h2><p>Text {n}</p></div><div class=content><p>Share this page</p></div></body></html>"
    rows = [(0, "http://a.example.com/", first)] + [(n, "http://a.example.com/", page.format(n=n)) for n in range(1, 5)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got if r.page_id} == {n: f"Title {n}\n\nText {n}" for n in range(1, 5)}


def test_tree_matching_is_the_largest():
    tree = lambda html: wrappers.parse(html)
    a = tree("<div><p>a</p><ul><li>b</li></ul><p>c</p></div>")
    b = tree("<div><p>a</p><h2>x</h2><ul><li>b</li><li>y</li></ul></div>")
    score, pairs = wrappers.match(a, b)
    assert score == len(pairs) == 1 + 1 + 2 + 3  # root, div, p with its text, ul with one li and its text
    assert all(x.label == y.label for x, y in pairs)


def test_warc(spark):
    big = "<p>" + "same page " * 30
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (1, "http://c/", "short"), (2, "http://c/", "short"), (7, "u", None), (8, "u", ""), (10, "ü", "é" * 100_000), (None, "n", big), (3, "http://b/", big)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest string")
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    expected = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and i != 3
        expected[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == expected
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


def test_each_member_can_be_read_alone():
    stream = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = [warc.record(i, f"http://x/{i}", b"body %d" % i, hashlib.sha256(b"body %d" % i).hexdigest(), None) for i in range(20)]
    whole = b"".join(map(stream.compress, raw)) + stream.flush()
    members, index = warc.normalise_file(whole)
    assert warc.inflate(members) == b"".join(raw) and len(index) == 20
    for (name, kind, offset, length), own in zip(index, raw):
        assert zlib.decompress(members[offset : offset + length], 31) == own and kind == "response" and name.startswith("<urn:page:")
    assert warc.normalise_file(members)[1] == index
    with pytest.raises(ValueError):
        warc.inflate(whole[:-9])


def extracted(spark, htmls, **options):
    rows = [(n, "http://a.example.com/x", h) for n, h in enumerate(htmls)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), **options).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_statistics_tell_the_article_without_marks(spark):
    """Menus, adverts and footers that vary from page to page go without a look at any tag or name."""
    body = lambda n: [f"Headline number {n}", *(f"Sentence {k} of text {n} says what happened on day {n * k} and why." for k in range(4))]
    page = lambda n: "<html><body><div><ul>" + "".join(f"<li><a href=/{k}>word{n * k}</a>" for k in range(6)) + f"</ul></div><div class=b>Buy thing {n}</div><div><h2>{body(n)[0]}</h2>" + "".join(f"<p>{x}</p>" for x in body(n)[1:]) + f"</div><div class=z>(c) {n} some words</div></body></html>"
    assert extracted(spark, map(page, range(30)), marks=False) == ["\n\n".join(body(n)) for n in range(30)]
    # A second layout on the host, which is another place for the article.
    other = lambda n: f"<html><body><table><tr><td>menu {n}</td></tr></table><section><div>" + "".join(f"<p>{x}</p>" for x in body(n)) + "</div></section></body></html>"
    both = [*map(page, range(20)), *map(other, range(20, 26))]
    assert extracted(spark, both, marks=False) == ["\n\n".join(body(n)) for n in range(26)]


def test_every_layout_of_a_host_is_in_its_wrapper(spark):
    """Twelve layouts, each with an advert and the article in elements of the same labels: only their places tell them apart."""
    body = lambda n: [f"Sentence {k} of text {n} says what happened on day {n * k} and why." for k in range(4)]
    page = lambda n: f'<html><body><section class="{"abcdefghijkl"[n % 12]}"><div><p>Buy thing {n} now</p><p>Or thing {n * 7}</p></div><div>' + "".join(f"<p>{x}</p>" for x in body(n)) + "</div></section></body></html>"
    # Pages of another kind, one of each, whose largest part is their only one.
    odd = lambda n: f'<html><body><section class="{"abcdefghijkl"[n % 12]}"><div><h2>Note {n}</h2><p>Short words of {n}</p></div></section></body></html>'
    htmls = [*map(page, range(72)), *map(odd, range(72, 132))]
    assert extracted(spark, htmls)[:72] == ["\n\n".join(body(n)) for n in range(72)]
    rows = spark.createDataFrame([("h", h) for h in htmls], "host string, html string")
    assert len({r.wrapper for k in (1, 5) for r in wrappers.wrappers(rows.repartition(k)).collect()}) == 1


def test_wrapper_is_merged_in_rounds_and_keeps_what_three_pages_have(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "MERGED", 3)
    name = lambda n: "abcdefghijklmnopqrstuvwxyz"[n // 26] + "abcdefghijklmnopqrstuvwxyz"[n % 26]
    # A label of its own on each page, one of each four pages, and items of which two pages have more than the others.
    rows = [("h", f'<div class="x{name(n)}"><p>a</p></div><div class="y{name(n // 4)}"><p>b</p></div>' + '<ol><li><p>c</p></ol><hr>' * {7: 50, 8: 40}.get(n, n % 5)) for n in range(120)]
    (got,) = wrappers.wrappers(spark.createDataFrame(rows, "host string, html string").repartition(6)).collect()
    labels = [x[0] for x in json.loads(got.wrapper)[2]]
    assert not any(x.startswith("div.x") for x in labels)
    assert sorted(x for x in labels if x.startswith("div.y")) == [f"div.y{name(n)}" for n in range(30)]
    assert labels.count("ol") == labels.count("hr") == 4  # not 49 as on one page
    few = spark.createDataFrame([("h", "<div><p>a</p></div>"), ("h", "<ul><li>b</li></ul>"), ("", "")], "host string, html string")
    assert {(r.of_host, r.wrapper) for r in wrappers.wrappers(few).collect()} == {("h", '["#root",0,[]]'), ("", '["#root",0,[]]')}


def test_copies_of_one_article_are_no_template(spark):
    page = "<html><body><div class=content><h2>Same title</h2><p>Same long text of the one article.</p><p>And more of it here.</p></div><div class=ad>{n}</div></body></html>"
    assert set(extracted(spark, [page.format(n=n) for n in range(12)])) == {"Same title\n\nSame long text of the one article.\n\nAnd more of it here."}


def test_an_article_beside_teasers_and_names_that_only_look_apart(spark):
    story = "".join(f"<p>Long paragraph number {k} of the story itself, with many words.</p>" for k in range(5))
    page = f"<body><article class=teaser><h3>Teaser</h3><p>short</p></article><div class=story-body>{story}<div class=related-work><p>Earlier work is cited here.</p></div><div class=news-notice><p>The notice was printed.</p></div></div></body>"
    text = "\n\n".join([*(f"Long paragraph number {k} of the story itself, with many words." for k in range(5)), "Earlier work is cited here.", "The notice was printed."])
    assert extracted(spark, [page]) == [text]
    parts = "<body><main><section><div class=content>{a}</div><div class=content>{a}</div></section></main></body>".format(a=story)
    assert extracted(spark, [parts])[0].count("Long paragraph") == 10


def test_broken_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "<p>inner text</p>" + "</div>" * 5000 + "<p>outer text"
    quotes = '<p>before</p>' + '<a title="x ' * 8000 + "<p>after</p>"
    wide = "".join(f"<h{k % 6 + 1}>title {k}</h{k % 6 + 1}><p>text {k}</p><ul><li>item {k}</ul>" for k in range(700))
    mixed = "<p>one<!-- never closed <p>two"
    buttons = "<p>kept</p>" + "<button>" * 5000 + "<p>also kept"
    script = "<p>start</p><script>var a = '<p>no</p>'"
    began = time.time()
    got = extracted(spark, [deep, deep.replace("inner", "other"), quotes, wide, wide[::-1], mixed, buttons, script, "<" * 50_000, "a < b <c"])
    assert time.time() - began < 60
    assert got[0] == "inner text\n\nouter text" and got[1] == "other text\n\nouter text"
    assert got[2].startswith("before") and got[2].endswith("after") and "title" not in got[2]
    assert got[3].count("\n\n") == 3 * 700 - 1
    assert (got[5], got[6], got[7], got[8], got[9]) == ("one", "kept\n\nalso kept", "start", "<" * 50_000, "a < b")


def test_archives_are_files_that_open_alone(spark, tmp_path):
    import gzip
    import json

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i} " + "x" * 3000) for i in range(40)], "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/warc"
    listed = warc.export(warc.write_archives(pages, archive_bytes=20_000), f"{folder}/streams").collect()
    files = spark.createDataFrame(listed)
    assert len(listed) >= 4 and all(r.bytes == (tmp_path / "warc/streams" / r.archive).stat().st_size for r in listed)
    done = warc.export(warc.normalise(warc.load(files, f"{folder}/streams")), f"{folder}/members").collect()
    assert sum(r.records for r in done) == 40
    for r in done:
        body = (tmp_path / "warc/members" / r.archive).read_bytes()
        assert gzip.decompress(body) == gzip.decompress((tmp_path / "warc/streams" / r.archive).read_bytes())
        for line in (tmp_path / "warc/members" / f"{r.archive}.cdxj").read_text().splitlines():
            x = json.loads(line)
            assert x["record_id"].encode() in gzip.decompress(body[x["offset"] : x["offset"] + x["length"]])
    assert {r.page_id for r in warc.read_files(spark.createDataFrame(done), f"{folder}/members").collect()} == set(range(40))
    assert not [f for f in (tmp_path / "warc/members").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_revisits_of_a_payload_that_most_pages_have(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(warc, "opens", lambda folder: broadcast > 0)
    rows = [(i, "u", "same " * 40 if i % 3 else f"page {i} " * 30) for i in range(200)] + [(i, "u", "") for i in range(200, 240)] + [(1, "u", "same " * 40)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()
    assert Counter((r.record_type, r.refers_to) for r in got) == {("response", None): 67 + 40 + 2, ("revisit", 1): 132}


def test_edited_licenses_keep_their_label(spark):
    """One word in twelve is changed, dropped or put in; templates of ten words and less must match in full."""
    import random

    rng, rows, want = random.Random(4), [], {}
    long = [(label, text.split()) for label, text in licences.TEMPLATES if len(licences.words(text)) > licences.SHORT_WORDS]
    for n in range(300):
        label, own = long[n % len(long)]
        own = list(own)
        for _ in range(max(1, len(own) // 12)):
            at = rng.randrange(1, len(own) - 1)
            own[at : at + 1] = rng.choice([["changed"], [], [own[at], "added"]])
        rows.append((n, f"Some words before it. {' '.join(own)} And more of it after."))
        want[n] = label
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(frame(spark, rows)).collect()}
    assert sum(want[n] in got[n] for n in want) >= 0.9 * len(want)
    clean = [(n, " ".join(rng.choice("this work is licensed under no such terms as the software may have".split()) for _ in range(40))) for n in range(200)]
    assert sum(bool(r.labels) for r in licences.scan(frame(spark, clean)).collect()) <= 2
