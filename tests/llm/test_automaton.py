"""The tokenization automaton against plain merging, the library and round trips."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slopewatch.llm import automaton
from slopewatch.llm.automaton import Automaton

RND = random.Random(12)
PATH = public_tokenizers.path(automaton.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def merged(word, merges):
    """Merging by definition: each rule in turn, everywhere, from the left."""
    parts = list(word)
    for a, b in merges:
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_any_merges_give_an_automaton_of_their_sequences():
    for _ in range(150):
        letters = "abc"[: RND.randint(1, 3)]
        tokens, merges = list(letters), []
        for _ in range(RND.randint(0, 12)):
            a, b = RND.choice(tokens), RND.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        numbers = {t: i for i, t in enumerate(tokens)}
        own = Automaton(numbers, merges)
        words = ["".join(RND.choice(letters) for _ in range(RND.randint(1, 14))) for _ in range(80)]
        got = [np.frombuffer(x, "<u4").tolist() for x in own.paths([w.encode() for w in words])]
        assert got == [[numbers[t] for t in merged(w, merges)] for w in words], merges
        assert got == [np.frombuffer(own.path(w.encode()), "<u4").tolist() for w in words]
        # arcs are exactly the pairs of neighbours that merging can leave
        for x in range(len(tokens)):
            for y in range(len(tokens)):
                stays = merged(tokens[x], merges) == [tokens[x]] and merged(tokens[y], merges) == [tokens[y]] and merged(tokens[x] + tokens[y], merges) == [tokens[x], tokens[y]]
                if merged(tokens[x], merges) == [tokens[x]] and merged(tokens[y], merges) == [tokens[y]]:
                    assert bool(own.follows(own.target[[x]], np.array([y]))[0]) == stays, (merges, tokens[x], tokens[y])


def library(texts):
    ids = [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return ids, [LIBRARY.decode(i, skip_special_tokens=False) for i in ids]


def test_ids_and_texts_equal_the_library():
    own = Automaton.read(PATH)
    signs = "abcdefghiklmnoprstuvwyz'' \n\t ABC019.,!-éßñž²½ªµ\xa0\x1c\x85日本語кирил😀́ "
    texts = ["".join(RND.choice(signs) for _ in range(RND.randint(0, 60))) for _ in range(3000)]
    texts += [t + "<|endoftext|>" + t for t in texts[:50]] + ["<|endoftext|>" * 3, "<|endoftext", "it's I'LL we've 's 'd", "a" * 300 + " " + "b" * 64, "ab" * 900, " " * 500, "\n" * 300, "日本語" * 200]
    ids, told = library(texts)
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids
    assert [own.decode(x) for x in got] == told
    odd = [[RND.randrange(50_257) for _ in range(RND.randint(0, 20))] for _ in range(500)] + [[60_000, 72]]
    assert [own.decode(np.array(x, "<u4").tobytes()) for x in odd] == [LIBRARY.decode(x, skip_special_tokens=False) for x in odd]


def test_segments_and_forgetting_change_nothing(monkeypatch):
    monkeypatch.setattr(automaton, "SEGMENT", 9)
    monkeypatch.setattr(automaton, "KEPT", 5)
    monkeypatch.setattr(automaton, "WIDE", 4)
    own = Automaton.read(PATH)
    texts = ["".join(RND.choice(["word", " ", "  ", "it's", "\n", "x1", "!?", "é"]) for _ in range(RND.randint(0, 60))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library(texts)[0]


def test_rows(spark):
    rows = [(1, "same text"), (1, "same text"), (2, None), (3, ""), (None, "it's <|endoftext|> x"), (4, "word " * 300_000), (5, "z" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumns({c: F.lit(1) for c in ("ids", "decoded", "n_tokens")})
    got = automaton.encoded(docs, spelled=True)
    ids, told = library([t for _, t in rows])
    want = sorted((i or -1, x, t) for (i, _), x, t in zip(rows, ids, told, strict=True))
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got.collect()) == want
    assert sorted((r["doc_id"] or -1, r["text"]) for r in automaton.decoded(got).collect()) == sorted((i, t) for i, _, t in want)
    assert automaton.encoded(docs.limit(0)).count() == 0 and automaton.decoded(got.limit(0)).count() == 0
    assert automaton.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()[0]["text"] == ""
