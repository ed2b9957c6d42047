"""Decontamination against a plain version on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate as d

MARK = r"[^A-Za-z0-9$%]"


def words(text):
    text = re.sub(rf"^\s*{MARK}*|{MARK}*$", "", text or "")
    return [w for w in re.split(rf"{MARK}*\s+{MARK}*", text) if w]


def template(w):
    if re.match(r"[A-Z]", w):
        return d.NAME
    if re.fullmatch(r"\$?[0-9][0-9.,:/]*(?:st|nd|rd|th)?%?", w):
        return d.NUMBER
    if not re.match(r"[0-9$]", w) and w in d.UNITS:
        return d.UNIT
    return w.lower()


SLOTS = {d.NAME, d.NUMBER, d.UNIT}
FORMS = (template, lambda w: template(w.lower()), str.lower)


def windows(own, w):
    """((form, place), words) of a text's windows."""
    return [((form, i), tuple(f(x) for x in own[i : i + w])) for form, f in enumerate(FORMS) for i in range(len(own) - w + 1)]


def said(own, w):
    """Windows of an item that say enough, by form and place."""
    out = []
    for (form, i), key in windows(own, w):
        run, least = own[i : i + w], min(w, d.MIN_LITERAL)
        same = sum(template(x) not in SLOTS for x in run) >= least
        low = sum(template(x.lower()) not in SLOTS for x in run) >= least
        if (same, low, not low)[form]:
            out.append((form, i, key))
    return out


def leaks(text, items, last):
    """Items that a text holds; ``last``: the forms in which the windows of a length are hashed."""
    own, found = words(text), set()
    for item_id, item in items:
        them = words(item)
        if not them:
            continue
        w = min(len(them), d.WINDOW)
        item_windows = said(them, w)
        told = {i for form, i, _ in item_windows if form == 0}
        total = len({i for _, i, _ in item_windows})
        lines = {}
        for (form, place), key in windows(own, w):
            if form <= last[w]:
                for _, at, other in item_windows:
                    if key == other:
                        lines.setdefault(place - at, set()).add(at)
        for diagonal in lines:
            near = [(at, abs(e - diagonal), e) for e in lines if abs(e - diagonal) <= d.DRIFT for at in lines[e]]
            places = {at for at, _, _ in near}
            share = max(len(places) / total, len(places & told) / len(told) if told else 0)
            if share < d.MIN_SHARE:
                continue
            pairs = set()
            for at in places:
                _, e = min((off, e) for a, off, e in near if a == at)
                pairs |= {(them[at + j], own[at + e + j].lower()) for j in range(w)}
            slots = {p for p in pairs if template(p[0]) in SLOTS}
            if not slots or len({a for a, _ in slots}) / len(slots) >= d.MIN_CONSISTENT:
                found.add(item_id)
    return found


def corpus(seed):
    rng = random.Random(seed)
    literal = [f"w{chr(97 + k)}" for k in range(8)]
    value = lambda: rng.choice([str(rng.randint(1, 3)), rng.choice(["Anna", "Berlin", "Carl"]), rng.choice(["km", "hours"]), f"${rng.randint(1, 3)}"])
    word = lambda: rng.choice(literal) if rng.random() < 0.65 else value()
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 14])))) for i in range(12)] + [(1, "wa wb wc wd we"), (90, None), (91, "")]
    texts = [None, "", "one", " ".join(literal)]
    for _ in range(60):
        out = []
        for _ in range(rng.randint(1, 3)):
            own = words(rng.choice(items)[1])
            if rng.random() < 0.5:  # other values
                own = [value() if template(x) in SLOTS and rng.random() < 0.5 else x for x in own]
            if own and rng.random() < 0.3:
                own.insert(rng.randrange(len(own)), word())
            if own and rng.random() < 0.3:
                del own[rng.randrange(len(own))]
            text = " ".join(own)
            out += [word() for _ in range(rng.randint(0, 3))] + [rng.choice([text, text, text.upper(), text.lower(), text + "?"])]
        texts.append(" ".join(out))
    return list(enumerate(texts)), items


@pytest.mark.parametrize("seed", range(4))
def test_leaks_are_those_of_the_plain_version(spark, seed, monkeypatch):
    texts, items = corpus(seed)
    if seed % 2:  # the benchmark is joined by a shuffle
        monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    last = {}
    for _, item in items:
        own = words(item)
        if own:
            w = min(len(own), d.WINDOW)
            last[w] = max([last.get(w, 0), *(form for form, _, _ in said(own, w))])
    # Windows that are the same in several forms count as the last of them, which only ever hashes more forms of a text.
    got = d.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: set(r.item_ids) for r in got.select("doc_id", "item_ids").collect()}
    assert got == {i: leaks(t, items, last) for i, t in texts}
    assert sum(map(bool, got.values())) > 20


def test_a_long_item_sends_no_words_with_its_windows(spark):
    item = " ".join(f"word{k} and {k}" for k in range(4000))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string").select("item_id", d.words(F.col("text")).alias("words"), F.lit(7).cast("bigint").alias("item_key"))
    assert d.item_windows(items)[5].columns == ["item_key", "place", "hash", "told", "total", "told_total", "form"]
    docs = spark.createDataFrame([(1, "so " + item), (2, item.replace(" 3 ", " 4 ")), (3, item[:200])], "doc_id bigint, text string")
    got = {r.doc_id: r.item_ids for r in d.scan(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {1: [1], 2: [1], 3: []}
