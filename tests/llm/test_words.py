"""Periodic runs, phrases and the double-array trie against brute force and on edges."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopewatch.llm import periodic, phrases, texts
from slopewatch.llm.texts import SPACE, Texts, split_words, symbol_table
from slopewatch.llm.trie import DEAD, ROOT, DoubleArray

RND = random.Random(11)


def test_words_do_not_depend_on_the_steps(monkeypatch):
    table = symbol_table(SPACE, lower=True)
    monkeypatch.setattr(texts, "SLICE_BYTES", 7)
    for _ in range(200):
        some = ["".join(RND.choice("ab  \nCü") for _ in range(RND.randint(0, 40))) for _ in range(RND.randint(0, 6))]
        whole, stepped = Texts.of(some).words(table), split_words(Texts.of(some), table)
        for a, b in zip((whole.hashes, whole.starts, whole.ends, whole.bounds), stepped, strict=True):
            assert a.tolist() == b.tolist(), some


def test_mismatches_are_exact():
    rng = np.random.default_rng(3)
    block, window = rng.integers(0, 300, (4, 8)), rng.integers(0, 300, (4, 15))
    window[2, 5:13] = block[2]
    digits = lambda v: np.stack([v & 255, v >> 8])
    want = [[int(((digits(block[i]) - digits(window[i, d : d + 8])) ** 2).sum()) for d in range(8)] for i in range(4)]
    assert periodic.mismatches(block, window, 300).tolist() == want and want[2][5] == 0


def plain_runs(ids):
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(ids[x] == ids[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, i + length, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    for _ in range(1500):
        kinds, n, ids = RND.choice([1, 2, 3, 5]), RND.randint(1, 90), []
        while len(ids) < n:
            root = [RND.randrange(kinds) for _ in range(RND.randint(1, 9))]
            ids += (root * 7)[: RND.randint(1, 7 * len(root))] if RND.random() < 0.5 else [RND.randrange(kinds)]
        ids = ids[:n]
        assert list(zip(*[x.tolist() for x in periodic.runs(np.array(ids), n)])) == plain_runs(ids), ids


@pytest.mark.parametrize(("ids", "want"), [
    (np.zeros(300_000, np.int64), [(0, 300_000, 1)]), (np.arange(200_000) % 700, [(0, 200_000, 700)]),
    (np.r_[np.tile(np.arange(40_000), 4), -np.arange(1, 9)] + 10, [(0, 160_000, 40_000)]), (np.arange(100_000), []),
])
def test_long_runs(ids, want):
    assert [(int(a), int(b), int(q)) for a, b, q in zip(*periodic.runs(ids, len(ids)), strict=True)] == want


def test_collapsed_rows(spark):
    rows = [
        (1, "a b a b a b a b c"), (1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \t\n"), (None, "x x x x x x"), (5, "x x x x x"), (6, "A a A a A a a\x0ba  a a a a"),
        (7, "ü " * 400_000 + "end"), (8, "one" * 900_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "start")})
    got = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapsed(docs).collect())
    assert got == sorted([
        (1, 9, [(0, 8, 2)], "a b c"), (1, 9, [(0, 8, 2)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (-1, 6, [(0, 6, 1)], "x"), (5, 5, [], "x x x x x"),
        (6, 12, [(5, 7, 1)], "A a A a A a"), (7, 400_001, [(0, 400_000, 1)], "ü end"), (8, 1, [], "one" * 900_000),
    ])
    assert periodic.collapsed(docs.limit(0)).count() == 0
    turned = {r["doc_id"]: r["collapsed"] for r in periodic.collapsed(docs, lambda i, n: np.arange(n)[::-1] if i == 1 else None).collect()}
    assert turned[1] == "c b a" and turned[5] == "x x x x x"


def test_trie_holds_what_was_added():
    trie = DoubleArray()
    first = trie.add(np.full(300, ROOT), np.arange(300))
    pairs = sorted({(RND.randrange(30), RND.randrange(300)) for _ in range(900)} | {(200, k) for k in range(300)} | {(k, 7) for k in range(300)})
    second = trie.add(first[[a for a, _ in pairs]], np.array([b for _, b in pairs]))
    assert len({*first.tolist(), *second.tolist()}) == 300 + len(pairs)
    everything = np.array([(a, b) for a in range(300) for b in range(-1, 301)])
    got = trie.step(trie.step(np.full(len(everything), ROOT), everything[:, 0]), everything[:, 1])
    want = dict(zip(pairs, second.tolist(), strict=True))
    assert got.tolist() == [want.get((a, b), DEAD) for a, b in everything.tolist()]
    assert trie.step(np.array([DEAD]), np.array([5])).tolist() == [DEAD]


def plain_phrases(rows, least, top):
    import re

    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in often.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(lg == lang and len(q) > len(p) and inside(q) and 100 * b >= 80 * a for (lg, q), b in often.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    told = []
    for lang in total:
        own = sorted(x for x in out if x[0] == lang)
        told += [(lang, i + 1, x[3].decode(), -x[2], x[4], x[5], total[lang], -x[1]) for i, x in enumerate(own[:top])]
    return sorted(told)


@pytest.mark.parametrize("most", [phrases.MOST_NODES, 9])
def test_phrases_equal_brute_force(spark, most):
    words = ["The", "the", "of", "End", "ü", "zz", "\x00", "a-b"]
    rows = [(RND.choice(["en", "de", None, ""]), "".join(RND.choice(words) + RND.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(RND.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), (None, ""), ("und", "of the End of the End")] + [("fr", "un deux trois quatre un deux trois quatre cinq")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({c: F.lit(1) for c in ("w1", "n", "key", "word", "id", "score", "p", "phrase")})
    for least, top in ((30, 2000), (5, 12)):
        got = phrases.collocations(docs, least, top, most).collect()
        assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == plain_phrases(rows, least, top)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "once only", "en")], "doc_id long, text string, lang string")).count() == 0
