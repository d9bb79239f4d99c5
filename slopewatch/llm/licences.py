"""Licence scan: positional index of licence words, looked up by each file's rarest of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import Texts, Words, map_texts, record, symbol_table

#: Phrases whose every place counts, by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NO_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Identifiers of the public licence list, as they stand after "SPDX-License-Identifier:".
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "Unlicense", "Zlib")
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

#: Notices as they stand in files, with the phrases that must be there: (label, notice, key phrases).
TEMPLATES = (
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "licensed under the MIT license", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "any person obtaining a copy")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge", "deal in the software without restriction", "substantial portions of the software")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted", "appear in all copies")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("bsd-2-clause", _BSD, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    ("bsd-3-clause", _BSD + _NO_NAMES, ("redistribution and use in source and binary forms", "endorse or promote products derived from this software")),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance with the license")),
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("gpl-2.0", _GRANT.format(name="GNU General Public License", version="2"), ("gnu general public license as published", "either version 2 of the license")),
    ("gpl-3.0", _GRANT.format(name="GNU General Public License", version="3"), ("gnu general public license as published", "either version 3 of the license")),
    ("lgpl-2.1", _GRANT.format(name="GNU Lesser General Public License", version="2.1"), ("gnu lesser general public license as published", "either version 2 1 of the license")),
    ("lgpl-3.0", _GRANT.format(name="GNU Lesser General Public License", version="3"), ("gnu lesser general public license as published", "either version 3 of the license")),
    ("agpl-3.0", _GRANT.format(name="GNU Affero General Public License", version="3"), ("gnu affero general public license as published", "either version 3 of the license")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    *((f"cc-{k}-4.0", f"licensed under CC {k} 4.0", (f"cc {k.replace('-', ' ')} 4 0",)) for k in _CC),
    *((f"cc-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", (f"creative commons {name.replace('-', ' ').lower()} 4 0",)) for k, name in _CC.items()),
    *((i.lower(), f"SPDX-License-Identifier: {i}", (f"spdx license identifier {i.lower().replace('-', ' ').replace('.', ' ')}",)) for i in _SPDX),
)
RARE = 8  # words of a notice that are looked up: the rarest that the file has
LEAST = 0.6  # share of a notice's weight that must be in place
DRIFT = 3  # words that may be missing or added before a word of a notice, and one more for every STRETCH words
STRETCH = 15

_SYMBOLS = symbol_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def _hashes(phrase: str) -> np.ndarray:
    return Texts.of([phrase]).words(_SYMBOLS).hashes


_WORDS = [_hashes(t) for _, t, _ in TEMPLATES]
VOCABULARY = np.unique(np.concatenate(_WORDS))
_TERMS = [np.searchsorted(VOCABULARY, w) for w in _WORDS]
#: Key phrases of each template with their positions in it.
_KEYS = [[(p := _hashes(key), next(q for q in range(len(words)) if np.array_equal(words[q : q + len(p)], p))) for key in keys] for words, (_, _, keys) in zip(_WORDS, TEMPLATES, strict=True)]
_KEY_TERMS = [np.searchsorted(VOCABULARY, np.unique(np.concatenate([p for p, _ in keys]))) for keys in _KEYS]
#: Postings: for every licence word the templates and positions it stands at.
POSTINGS: dict[int, list[tuple[int, int]]] = {}
for _t, _terms in enumerate(_TERMS):
    for _q, _w in enumerate(_terms.tolist()):
        POSTINGS.setdefault(_w, []).append((_t, _q))


def places(h: np.ndarray, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word numbers where the words of a phrase stand one after the other in one text."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for j, word in enumerate(phrase[1:], 1):
        at = at[h[at + j] == word]
    return at[text[at] == text[at + len(phrase) - 1]]


def _known(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers that are in the vocabulary, and their vocabulary numbers."""
    term = np.minimum(np.searchsorted(VOCABULARY, h), len(VOCABULARY) - 1)
    at = np.flatnonzero(VOCABULARY[term] == h)
    return at, term[at]


def frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of the licence words over all of ``docs``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Texts.of_column(batch.column("text")).words(_SYMBOLS)
        at, term = _known(words.hashes)
        found = np.bincount(np.unique(words.text_of[at] * len(VOCABULARY) + term) % len(VOCABULARY), minlength=len(VOCABULARY))
        return record(term=np.flatnonzero(found), n=found[found > 0])

    df = np.zeros(len(VOCABULARY))
    for r in map_texts(docs.select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return np.log((docs.count() + 1) / (df + 1)) + 1


def _starts(where: np.ndarray, term: np.ndarray, t: int, idf: np.ndarray) -> list[int]:
    """Where template ``t`` may start among the licence words of one file, by the votes of the rarest.

    The file's rarest words of the template are looked up in the postings; each of
    their places, less the position in the template, votes for a start. Starts
    that lie within the drift of each other are one, if half of the words looked up agree, two at least.
    """
    mine = np.unique(term[np.isin(term, _TERMS[t])])
    rare = mine[np.argsort(-idf[mine], kind="stable")][:RARE]
    votes = sorted((int(p) - q, int(w)) for w in rare.tolist() for p in where[term == w] for u, q in POSTINGS[w] if u == t)
    need, slack = max(2, -(-len(rare) // 2)), DRIFT + len(_WORDS[t]) // STRETCH
    out: list[int] = []
    at = 0
    while at < len(votes):
        to = at
        while to < len(votes) and votes[to][0] <= votes[at][0] + slack:
            to += 1
        group = votes[at:to]
        if len({w for _, w in group}) >= need:
            starts = [v for v, _ in group]
            out.append(max(sorted(set(starts)), key=starts.count))
            at = to
        else:
            at += 1
    return out


def verified(h: np.ndarray, t: int, start: int, idf: np.ndarray) -> float:
    """Share of the template's weight in place around ``start`` in one file's words, 0 without its key phrases.

    A word is in place within the drift that its position allows; nothing outside the file is read.
    """
    words = _WORDS[t]
    for phrase, offset in _KEYS[t]:
        slack = DRIFT + offset // STRETCH
        lo, hi = max(start + offset - slack, 0), min(start + offset + slack + 1, len(h) - len(phrase) + 1)
        if not any(np.array_equal(h[p : p + len(phrase)], phrase) for p in range(lo, hi)):
            return 0.0
    position = np.arange(len(words))
    most = DRIFT + len(words) // STRETCH
    reach = np.arange(-most, most + 1)
    at = start + position[:, None] + reach
    inside = (at >= 0) & (at < len(h)) & (np.abs(reach) <= DRIFT + position[:, None] // STRETCH)
    there = (inside & (h[np.clip(at, 0, max(len(h) - 1, 0))] == words[:, None])).any(axis=1)
    weight = idf[_TERMS[t]]
    return float(weight[there].sum() / weight.sum())


def aligned(words: Words, idf: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(text, template, word number of its start in the text, score) of every verified notice.

    Only templates all of whose key words a file has can be in it, so only their
    words are looked up.
    """
    at, term = _known(words.hashes)
    text = words.text_of[at]
    has = np.zeros((len(words.bounds) - 1, len(VOCABULARY)), bool)
    has[text, term] = True
    found: list[tuple[int, int, int, float]] = []
    bounds = np.searchsorted(text, np.arange(len(words.bounds)))
    for t, needed in enumerate(_KEY_TERMS):
        for i in np.flatnonzero(has[:, needed].all(axis=1)).tolist():
            own = slice(bounds[i], bounds[i + 1])
            h = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            for start in _starts(at[own] - words.bounds[i], term[own], t, idf):
                score = verified(h, t, start, idf)
                if score >= LEAST:
                    found.append((i, t, start, score))
    return found


def scanned(docs: DataFrame, idf: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``docs``: counts and places of the base phrases, labels and the notices found.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    notices): ``notices`` lists (label, first_word, score) of the verified
    templates; the score is 1 for a base phrase, else that of the best notice,
    else 0. Null or empty text: no words, empty labels. Ties between starts of one
    notice go to the best score, then the first. Null doc_id and repeated rows are kept;
    extra columns are ignored; empty input gives no rows.
    """
    weights = frequencies(docs) if idf is None else idf

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Texts.of_column(batch.column("text")).words(_SYMBOLS)
        h, text, rows = words.hashes, words.text_of, len(batch)
        n_base, first, last = np.zeros(rows, np.int64), np.full(rows, 1 << 60), np.full(rows, -1)
        base: list[set[str]] = [set() for _ in range(rows)]
        for label, phrase in PHRASES.items():
            at = places(h, text, _hashes(phrase))
            start = at - words.bounds[text[at]]
            np.add.at(n_base, text[at], 1)
            np.minimum.at(first, text[at], start)
            np.maximum.at(last, text[at], start)
            for i in np.unique(text[at]):
                base[i].add(label)
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for i, t, start, score in aligned(words, weights):
            key, value = (i, TEMPLATES[t][0]), (score, -max(start, 0))
            best[key] = max(best.get(key, value), value)
        notices: list[list[dict]] = [[] for _ in range(rows)]
        for (i, label), (score, start) in sorted(best.items()):
            notices[i].append({"label": label, "first_word": -start, "score": score})
        none = n_base == 0
        return record(
            doc_id=batch.column("doc_id"), n_words=words.counts.astype(np.int64), n_base=n_base,
            first_word=pa.array(first, pa.int64(), mask=none), last_word=pa.array(last, pa.int64(), mask=none),
            base_labels=pa.array([",".join(sorted(b)) for b in base]),
            labels=pa.array([",".join(sorted(b | {x["label"] for x in m})) for b, m in zip(base, notices, strict=True)]),
            score=np.array([1.0 if b else max((x["score"] for x in m), default=0.0) for b, m in zip(base, notices, strict=True)]),
            notices=pa.array(notices, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("score", pa.float64())]))),
        )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label: string, first_word: long, score: double>>"
    return map_texts(docs.select("doc_id", "text"), work, schema)
