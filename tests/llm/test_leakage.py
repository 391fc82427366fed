import random

import numpy as np
import pytest

from symvane.llm import leakage as mod
from symvane.llm.leakage import fingerprints, leaks, readings, words

ITEM = "Given the maple list report which lantern comes before the amber mark and how many quiet steps remain for the tall keeper"


def settings():
    w = ITEM.split()
    part = w[3:15]
    return {
        "plain": "Look: " + " ".join(part) + ". End.", "upper": " ".join(part).upper(), "lines": "// " + "\n// ".join([" ".join(part[:5]), " ".join(part[5:])]), "markup": " ".join(f"**{x}**" if i % 2 else f"<b>{x}</b>" for i, x in enumerate(part)),
        "hidden": " ​".join(x[:2] + "­" + x[2:] for x in part), "spaces": " ".join(part), "wide": "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in " ".join(part)), "list": "\n".join(f"- {x}" for x in part), "numbered": "\n".join(f"{i + 1}. {x}" for i, x in enumerate(part)),
        "code": 'let p = "' + " ".join(part[:6]) + ' " +\n    "' + " ".join(part[6:]) + '";', "links": " ".join(f"[{x}](http://a.b/{i})" for i, x in enumerate(part)), "quote": "> " + " ".join(part[:4]) + "\n> " + " ".join(part[4:]),
        "latex": " ".join("\\emph{" + x + "}" for x in part), "notes": " ".join(f"{x}[{i}]" for i, x in enumerate(part)), "parted": "// " + " ".join(part[:5]) + " " + part[5][:3] + "-\n// " + part[5][3:] + " " + " ".join(part[6:]), "role": " ".join(f":ref:`{x}`" for x in part),
    }


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        for ws in readings(t or ""):
            grams = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
            for k, u in items:
                us = words(u or "")
                if any(tuple(us[i : i + n]) in grams for i in range(len(us) - n + 1)):
                    out.add((d, k))
    return out


def test_every_setting_is_found(spark):
    cases = settings()
    docs = spark.createDataFrame(list(enumerate(cases.values())), "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "something else " * 3)], "item_id long, text string")
    got = {r.doc_id for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == set(range(len(cases))), [list(cases)[i] for i in set(range(len(cases))) - got]


def test_eleven_words_are_too_few(spark):
    w = ITEM.split()
    docs = spark.createDataFrame([(1, " ".join(w[:11]) + " other"), (2, " ".join(w[:6]) + " x " + " ".join(w[6:12])), (3, " ".join(w[:12]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(3, 7)]


@pytest.mark.parametrize("block", [3, 10**6])
def test_equals_brute_force(spark, block):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(6)]  # few words: many ties and repeated runs
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 40)))) for i in range(12)] + [(99, None), (98, "")]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(60)) + " " + " ".join((items[i % 12][1] or "").split()[: r.randrange(20)])) for i in range(40)] + [(100, None), (101, ""), (0, "dup")]
    n = 6
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, hash string")
    k = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, around string")
    got = {tuple(x) for x in leaks(d, "doc_id", "text", k, "item_id", "text", min_words=n, gram=4, block=block).collect()}
    assert got == brute(docs, items, n)
    nameless = spark.createDataFrame([(None, docs[3][1]), (None, docs[3][1])], "doc_id long, text string")
    assert {tuple(x) for x in leaks(nameless, "doc_id", "text", k, "item_id", "text", min_words=n, gram=4, block=block).collect()} == {(None, i) for a, i in brute(docs[3:4], items, n)}
    assert leaks(d.limit(0), "doc_id", "text", k, "item_id", "text").collect() == []
    assert leaks(d, "doc_id", "text", k.limit(0), "item_id", "text").collect() == []


def test_shared_runs_share_a_fingerprint():
    r = np.random.default_rng(1)
    for _ in range(200):
        run = r.integers(0, 4, 12).astype(np.uint64)
        a = np.r_[r.integers(0, 4, 30).astype(np.uint64), run, r.integers(0, 4, 9).astype(np.uint64)]
        b = np.r_[r.integers(4, 8, 3).astype(np.uint64), run, r.integers(4, 8, 20).astype(np.uint64)]
        assert set(fingerprints(a, mod.GRAM, 4)[1]) & set(fingerprints(b, mod.GRAM, 4)[1])
