"""Each method against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from slopewatch.llm import covertree, langid, licences, lines, neardup, packing, quality, syncmers, toxicity
from slopewatch.llm.texts import SPACE, Texts, record, stored, symbol_table
from slopewatch.llm.tokens import WordTokens

RND = random.Random(4)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 6))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_word_and_shingle_hashes():
    texts = ["a b a  b", "", "b\x0bA b", "ü x y", "a"]
    w = Texts.of(texts).words(symbol_table(SPACE, lower=True))
    split = [t.encode().lower().split() for t in texts]
    assert w.counts.tolist() == [len(s) for s in split]
    flat = [x for s in split for x in s]
    assert all((flat[i] == flat[j]) == (w.hashes[i] == w.hashes[j]) for i in range(len(flat)) for j in range(len(flat)))
    h, text = w.shingles(2)
    want = [(i, tuple(s[k : k + 2])) for i, s in enumerate(split) for k in range(max(len(s) - 1, min(len(s), 1)))]
    assert text.tolist() == [i for i, _ in want]
    assert len({*h.tolist()}) == len({s for _, s in want})


def test_code_lengths_equal_plain_partial_matching():
    texts, langs = ["abracadabra bra", "banana bandana"], ["x", "y"]
    counts = langid.gram_counts(record(lang=langid.pa.array(langs), text=langid.pa.array(texts)))
    model = langid.build(langs, np.array([langs.index(v) for v in counts.column("lang").to_pylist()]), *(counts.column(c).to_numpy() for c in ("k", "gram", "n")))

    def bits(learned, context, symbol):
        n = {}
        for i in range(len(context), len(learned)):
            if learned[i - len(context) : i] == context:
                n[learned[i]] = n.get(learned[i], 0) + 1
        total, kinds = sum(n.values()), len(n)
        if symbol in n:
            return math.log2((total + kinds) / n[symbol])
        leave = math.log2((total + kinds) / kinds) if kinds else 0.0
        return leave + (bits(learned, context[1:], symbol) if context else 8.0)

    probe = "bandabra Zq! cab"
    data, bounds = langid.folded(Texts.of([probe]))
    got = model.bits(data)[1:]
    text = bytes(data[1:])
    for j, s in enumerate(text):
        for k, t in enumerate(texts):
            assert abs(got[j, k] - bits(bytes(langid.folded(Texts.of([t]))[0][1:]), text[max(j - langid.DEPTH + 1, 0) : j], s)) < 1e-4
    assert bounds.tolist() == [0, len(text) + 1]


def test_ids_equal_the_library():
    path = public_tokenizers.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = [prose(50), "It's I'LL we've 'tis '", "ÀÉÎ ñandú straße ﬁ Ⅷ １２ é ́x", "a<|endoftext|>b <|startoftext|>", "tab\tnew\nline wide x\x1cy", "!!! *** a1b2 3.14 日本語 ΣΊΣΥΦΟΣ İ ſ K", "", "x" * 300]
    for t in texts:
        assert np.frombuffer(WordTokens.at(path).ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_is_exact_and_tight(spark):
    rows = [(i, prose(RND.choice([5, 60, 300, 900])), "s") for i in range(300)] + [(1000 + i, "same text", "s") for i in range(200)] + [(2000, prose(9000), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.sequences(docs, keep_ids=True).collect()
    path, texts = public_tokenizers.path(packing.VOCABULARY), {r[0]: r[1] for r in rows}
    pieces, bins = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {i: WordTokens.at(path).ids(t) + packing.END for i, t in texts.items()}
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / packing.CAPACITY + 1


def test_plans_use_every_piece():
    for seed, m in ((1, 1), (2, 40), (3, 5000)):
        rnd = random.Random(seed)
        histogram = {rnd.randint(1, 2048): rnd.randint(1, m) for _ in range(60)}
        plan, used = packing.packed(histogram), {}
        for pattern, times in plan:
            assert sum(n * k for n, k in pattern) <= 2048
            for n, k in pattern:
                used[n] = used.get(n, 0) + k * times
        assert used == histogram


def test_closed_syncmers_by_definition():
    data = prose(60).encode()
    got = syncmers.anchors(Texts.of([data.decode()]))[0]
    value = symbol_table(b"", lower=False)
    k, s = syncmers.INNER + syncmers.WINDOW - 1, syncmers.INNER

    def h(part):
        p = sum(int(value[b]) * pow(syncmers.mix.__globals__["_P"], i, 1 << 64) for i, b in enumerate(part)) % (1 << 64)
        return int(syncmers.mix(np.array([p], np.uint64))[0])

    places = set()
    for i in range(len(data) - k + 1):
        inner = [h(data[i + j : i + j + s]) for j in range(syncmers.WINDOW)]
        if min(inner) in (inner[0], inner[-1]):
            places.add(i)
    assert set(got["place"].tolist()) <= places and len(got) == min(len(places), syncmers.ANCHORS)
    # context-free: the same passage elsewhere has the same anchors
    other = syncmers.anchors(Texts.of([prose(3) + " " + data.decode()]))[0]
    assert syncmers.likeness(got, other) > 0.7 and syncmers.likeness(got, got) == 1.0


def test_fingerprints_follow_the_order_of_ids(spark):
    rows = [(i * 7 % 501, prose(RND.randint(0, 80))) for i in range(501)]
    got = {r["doc_id"]: r for r in syncmers.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    texts = dict(rows)
    for i in range(501):
        e = syncmers.edited(texts[i], texts[(i + 1) % 501])
        assert got[i]["edited_sha256"] == syncmers.hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(texts[i])
        assert got[i]["near_edited"] >= got[i]["near_next"] or len(texts[i]) < 40


def test_lines_against_all_pairs(spark):
    rnd = random.Random(8)
    pool = [[rnd.choice(WORDS) for _ in range(rnd.randint(3, 9))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 5)):
            w = list(rnd.choice(pool))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + [rnd.choice(WORDS)] + w[at:], w[:at] + ["x"] + w[at + 1 :]]) or w
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in lines.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = [((i, n), tuple(t.split())) for i, text in rows for n, t in enumerate(text.split("\n")) if t.split()]
    first = {}
    for key, w in every:
        first.setdefault(w, key)

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, p = [i, *d[1:]], d
            for j, y in enumerate(b, 1):
                d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
        return d[-1]

    for key, w in every:
        near = len(w) >= lines.MIN_WORDS and any(len(v) >= lines.MIN_WORDS and k < first[w] and distance(v, w) <= 1 for v, k in first.items())
        assert got[key] == (first[w] == key and not near), (key, w)


def test_copies_with_short_lines_vanish(spark):
    text = "one two three four five six\nthing.\n\nseven eight nine ten eleven\nHaanth."
    rows = [(1, text), (2, text), (3, "Thing.\na line of its own here\nhaanth."), (4, "another thing.")]
    got = {r["doc_id"]: r["text"] for r in lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 3: "a line of its own here", 4: "another thing."}


def test_short_boilerplate_is_kept_once(spark):
    rows = [(i, f"{prose(8)}\nAll rights reserved.\n{i}\nall  rights reserved.") for i in range(30)]
    kept = {r["doc_id"]: r["text"].split("\n") for r in lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept[0][1:] == ["All rights reserved.", "0"] and all(kept[i][1:] == [str(i)] for i in range(1, 30))


def test_quality_on_held_out_rows(spark):
    rows = [(i, prose(80) + "." if i % 3 else " ".join(w + "!!" for w in prose(60).upper().split()), i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 900, 2)], "doc_id long, quality int")
    got = quality.scored(docs, quality.learned(docs, labels)).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] % 2)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    terms, n = 40, 700
    rows = [np.unique(rng.integers(0, terms, rng.integers(1, 9))) for _ in range(n)]
    example, term = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    count, idf = rng.integers(1, 4, len(term)), rng.uniform(1, 6, terms * toxicity.LEVELS)
    index = toxicity.Index.of(toxicity.Vocabulary.of(np.arange(terms, dtype=np.uint64)), idf, np.arange(n), np.zeros(n), np.ones(n), example, term, count, 0.1)
    w = toxicity.unit(example, term, count, idf)
    dense = np.zeros((n, terms))
    dense[example, term] = w
    for i in range(0, n, 35):
        near, cosine = index.nearest(rows[i], dense[i, rows[i]])
        want = np.sort(dense @ dense[i])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(np.sort(cosine)[::-1], want)
        assert np.allclose(dense[index.doc_id[near]] @ dense[i], cosine)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * rng.choice([0.0, 0.1, 0.25, 0.5], 1500)[:, None], rng.normal(size=(300, 16))]).astype(np.float32)
    label = np.where(np.arange(1800) % 4 == 0, 1, 0)
    got = {r["vec_id"]: r for r in covertree.grouped(spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(1800)], "vec_id long, embedding array<float>, label int")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= covertree.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    component = np.arange(1800)
    while True:
        low = np.minimum(component, np.where(link, component[None, :], 1 << 30).min(axis=1))
        if (low == component).all():
            break
        component = low
    assert [got[i]["n_links"] for i in range(1800)] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(1800)] == component.tolist()


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for g in range(12):  # chains: each copy edits the one before, so ends of a group are not alike themselves
        w = [rnd.choice(WORDS) for _ in range(rnd.choice([4, 40, 150]))]
        for _ in range(rnd.choice([1, 3, 25])):
            rows.append((len(rows) * 3 % 1000, " ".join(w)))
            w = [v if rnd.random() > 0.03 else rnd.choice(WORDS) for v in w]
    rows += [(5000 + i, "the very same words " * 5) for i in range(50)]
    got = {r["doc_id"]: r for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(max(len(t.split()) - 1, 1))} for i, t in rows}
    component = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(60):
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (component[i] == i) for i, r in got.items())


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    rows = [
        (1, f"{prose(30)} {mit} {prose(10)}"), (2, "CC BY cc-by All rights\nreserved; all rights"), (3, prose(40)), (4, "mit license"), (10, f"{prose(20)} cc by 4 0 {prose(20)}"),
        (5, "Licensed under the Apache License, Version 2.0."), (6, "apache version license the under licensed"), (7, "This work is licensed under the GNU General Public License, version 3."),
        (8, "// SPDX-License-Identifier: Apache-2.0"), (9, "apache license version 2 0 foo"),
    ]
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["notices"][0]["first_word"] == 30 and got[1]["n_base"] == 0
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 0, 4, "cc-by,reserved")
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0 and got[3]["first_word"] is None
    assert got[5]["labels"] == "apache-2.0" and got[6]["labels"] == "" and got[7]["labels"] == "gpl,gpl-3.0" and got[8]["labels"] == "apache-2.0"
    assert got[10]["base_labels"] == "cc-by"
    # what stands in other files or other batches changes nothing
    idf = licences.frequencies(spark.createDataFrame(rows, "doc_id long, text string"))
    for n in (1, 7):
        again = licences.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), idf).collect()
        assert {r["doc_id"]: r for r in again} == got


def test_whole_notices_and_edits(spark):
    rnd, rows, want = random.Random(3), [], {}
    for k, (label, notice, keys) in enumerate(licences.TEMPLATES):
        rows.append((k, f"{prose(12)}\n * {notice}\n{prose(9)}"))
        want[k] = label
        words = notice.split()
        if len(words) > 25:  # some words lost and added, not in a key phrase
            held = {w for key in keys for w in key.split()}
            free = [i for i, w in enumerate(words) if held.isdisjoint("".join(c if c.isalnum() else " " for c in w.lower()).split())]
            for i in sorted(rnd.sample(free, 4), reverse=True):
                words[i : i + 1] = [] if i % 2 else [words[i], "indeed"]
            rows.append((1000 + k, " ".join(words)))
            want[1000 + k] = label
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        assert label in got[k]["labels"].split(","), (k, label, got[k]["labels"])
        place = {n["label"]: n for n in got[k]["notices"]}[label]
        assert (k >= 1000 or (place["first_word"] == 12 and place["score"] == 1.0)) and place["score"] > 0.8


def test_base_phrases_by_brute_force(spark):
    import re

    rnd = random.Random(5)
    parts = ["CC", "by", "cc-BY", "General", "public", "LICENSE", "all", "rights", "reserved", "ü", "x1", ".", "\n", "\x00"]
    rows = [(k, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in rows[r["doc_id"]][1])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for label, phrase in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        first, last = (min(at)[0], max(at)[0]) if at else (None, None)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), first, last, ",".join(sorted({x for _, x in at})))


def test_one_file_with_every_notice(spark):
    file = "\n".join(f"{prose(12)}\n{notice}." for _, notice, _ in licences.TEMPLATES)
    got = licences.scanned(spark.createDataFrame([(1, file), (2, prose(300))], "doc_id long, text string")).filter("doc_id = 1").first()
    assert {x["label"] for x in got["notices"]} == {label for label, _, _ in licences.TEMPLATES}
    assert all(x["score"] == 1.0 for x in got["notices"])



def test_a_stored_step_leaves_no_shuffle_files(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    rows = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count()
    before = held()
    got = stored(rows, "sums")
    assert held() <= before
    assert {r["k"]: r["count"] for r in got.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
