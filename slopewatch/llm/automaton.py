"""Byte-pair encoding as a deterministic automaton over tokens, compiled merge by merge, and decoding by its arc labels."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType
from tokenizers import pre_tokenizers

from slopewatch.llm.texts import map_texts, record
from slopewatch.llm.tokens import byte_letters
from slopewatch.llm.trie import DEAD, ROOT, DoubleArray

VOCABULARY = "byte_bpe_50k.json"
KEPT = 200_000  # pieces of text whose ids a process remembers
WIDE = 64  # bytes of a piece that is encoded together with others
TOGETHER = 20_000  # pieces encoded at once
SEGMENT = 1 << 20  # characters of a text that are split at once

_LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
#: Text whose letters, digits and spaces are plain; other text is split by the library's own rule.
_ODD = re.compile(r"[^\t\n\r -~À-ž]")
#: Fixed value: the public splitting rule of byte-level vocabularies, for plain text.
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_CUT = re.compile(r"[!-~](?= )")  # no piece goes on from a mark or letter into white space


class Automaton:
    """Accepts exactly the token sequences that byte-pair encoding yields, and spells their bytes.

    It starts as one state with a loop for every byte. The gadget of the merge
    (u, v) gives u a state of its own, a copy of the one that u led to without
    the arc for v, and lets the new token uv go wherever u and then v led. All
    arcs of a label lead to one state at any time, so ``target`` holds the arcs'
    ends, and a state is what its ancestor allows without the arcs removed since.
    Removing v from a state also keeps from it whatever is built on v at its left
    later on. With tokens numbered in the order of their left halves, latest first,
    that is one interval of numbers; the intervals of all states, in one sorted
    table, are the transition table.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], special: Iterable[tuple[str, int]] = ()) -> None:
        self.special = {t: int(i).to_bytes(4, "little") for t, i in special}
        shown = {chr(c): b for b, c in byte_letters().items()}
        n = max([*vocabulary.values(), *(i for _, i in special)], default=-1) + 1
        labels = [b""] * n
        for token, i in vocabulary.items():
            labels[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        for token, i in special:
            labels[i] = token.encode()
        self.labels = np.frombuffer(b"".join(labels), np.uint8)
        self.offsets = np.r_[0, np.cumsum([len(x) for x in labels])].astype(np.int64)

        target = np.zeros(n, np.int64)
        above, without, built = [-1], [-1], [-1]  # of every state: its ancestor, the arc removed, the merge that did it
        made = np.full(n, -1)  # merge that made the token
        left: dict[int, int] = {}
        real = [vocabulary[c] for c in shown if c in vocabulary]
        for m, (a, b) in enumerate(merges):
            u, v, x = vocabulary[a], vocabulary[b], vocabulary[a + b]
            was = int(target[u])
            beginnings, z, upto = {}, v, m  # what v starts with, and the merge that built on it
            while z is not None:
                beginnings[z], z, upto = upto, left.get(z), int(made[z])
            s, barred = was, False
            while s > 0 and not barred:
                barred = built[s] <= beginnings.get(without[s], -1)
                s = above[s]
            if barred or x in left:
                continue  # v never follows u, or the token has been made: no path to shorten
            target[x] = target[v] if u != v else was
            target[u] = len(above)
            above.append(was), without.append(v), built.append(m)
            made[x], left[x] = m, u
            real.append(x)

        later: dict[int, list[int]] = {}
        for x in real:
            later.setdefault(left.get(x, -1), []).append(x)
        number, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        stack, at = [(x, False) for x in later.get(-1, [])], 0
        while stack:
            x, done = stack.pop()
            if done:
                end[x] = at
                continue
            number[x], at = at, at + 1
            stack.append((x, True))
            stack.extend((y, False) for y in sorted(later.get(x, []), key=lambda y: made[y]))
        self.number, self.n = number, n

        final, self.target = np.unique(np.r_[0, target], return_inverse=True)
        self.target = self.target[1:].astype(np.int64)
        rows = []
        for k, s in enumerate(final.tolist()):
            while s > 0:
                z, since = without[s], built[s]
                below = [y for y in later.get(z, []) if made[y] < since]  # these were made before and stay
                rows.append((k * n + number[z], k * n + (min(number[y] for y in below) if below else end[z])))
                s = above[s]
        rows.sort()
        starts, ends = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
        self.starts, self.ends = starts, np.maximum.accumulate(ends) if len(ends) else ends

        self.bytes = DoubleArray()
        token_at: dict[bytes, int] = {labels[x]: x for x in real}
        words, places = sorted(token_at), {b"": ROOT}
        for length in range(1, max(map(len, words), default=0) + 1):
            level = sorted({w[:length] for w in words if len(w) >= length})
            slots = self.bytes.add(np.array([places[w[:-1]] for w in level]), np.array([w[-1] for w in level]))
            places.update(zip(level, slots.tolist(), strict=True))
        self.token = np.full(len(self.bytes.base), -1, np.int64)
        for w, x in token_at.items():
            self.token[places[w]] = x
        self.longest = max(map(len, words), default=0)
        self._known: dict[str, bytes] = {}
        self._lists: tuple[list, ...] | None = None

    @classmethod
    def read(cls, path: str) -> Automaton:
        """From a public vocabulary file of byte-level pairs; other rules are an error."""
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        rule, model = told["pre_tokenizer"], told["model"]
        added = told["added_tokens"]
        plain = rule == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not told["normalizer"] and model["type"] == "BPE"
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added) or model["dropout"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, [(t["content"], t["id"]) for t in added])

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}, "_lists": None}

    def follows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Does the state have an arc for the token?"""
        key = state * self.n + self.number[token]
        at = np.searchsorted(self.starts, key, side="right") - 1
        return (at < 0) | (self.ends[at] <= key) if len(self.starts) else np.ones(len(key), bool)

    def paths(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as little-endian unsigned 32-bit integers.

        A word has one accepting path and so has each of its beginnings. From every
        boundary that a path reaches, the trie is walked along the bytes; where it
        spells a token that the boundary's state has an arc for, the path goes on.
        All words move together.
        """
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order])
        width = int(sizes[0])
        data = np.zeros((len(words), width), np.int32)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        state, came = np.zeros((len(words), width + 1), np.int64), np.full((len(words), width + 1), -1, np.int32)
        for j in range(width):
            row = np.arange(np.searchsorted(-sizes, -j, side="left"))  # words of more than j bytes
            node = np.full(len(row), ROOT, np.int32)
            for to in range(j + 1, min(width, j + self.longest) + 1):
                long = sizes[row] >= to
                row = row[long]
                node = self.bytes.step(node[long], data[row, to - 1])
                live = node != DEAD
                row, node = row[live], node[live]
                if not len(row):
                    break
                token = self.token[node]
                ends = token >= 0
                at, token = row[ends], token[ends]
                if j:
                    free = self.follows(state[at, j], token)
                    at, token = at[free], token[free]
                state[at, to], came[at, to] = self.target[token], token
        on_path, at = np.zeros(came.shape, bool), sizes.copy()
        row = np.flatnonzero(at > 0)
        while len(row):
            on_path[row, at[row]] = True
            token = came[row, at[row]]
            at[row] -= self.offsets[token + 1] - self.offsets[token]
            row = row[at[row] > 0]
        ids, bounds = came[on_path].astype("<u4").tobytes(), np.r_[0, np.cumsum(on_path.sum(axis=1))] * 4
        out = [b""] * len(words)
        for k, i in enumerate(order):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    def path(self, word: bytes) -> bytes:
        """``paths`` of one long word, a byte at a time."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.bytes.base, self.bytes.check, self.token, self.number, self.target, self.starts, self.ends))
        base, check, token, number, target, starts, ends = self._lists
        state, came, n = [0] * (len(word) + 1), [-1] * (len(word) + 1), len(base)
        for j in range(len(word)):
            node = ROOT
            for to in range(j, len(word)):
                place = base[node] + word[to]
                if not 0 <= place < n or check[place] != node:
                    break
                node = place
                x = token[node]
                if x >= 0:
                    key = state[j] * self.n + number[x]
                    at = bisect_right(starts, key) - 1
                    if at < 0 or ends[at] <= key:
                        state[to + 1], came[to + 1] = target[x], x
        ids, at = [], len(word)
        while at:
            ids.append(came[at])
            at -= int(self.offsets[came[at] + 1] - self.offsets[came[at]])
        return np.array(ids[::-1], "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text[a:b] for _, (a, b) in _library_split().pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def _segments(self, text: str) -> Iterator[str | bytes]:
        """Parts of a text that are split on their own, and the ids of special tokens."""
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + SEGMENT) if len(part) > at + SEGMENT else None
                to = cut.end() if cut else len(part)
                yield part[at:to]
                at = to

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of whole texts. Special tokens' strings are their ids; the rest is split and each piece follows its path.

        Pieces that are not remembered are encoded together, for about ``SEGMENT`` characters of text at once.
        """
        out: list[list[bytes]] = []
        waiting: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def settle() -> None:
            if len(self._known) > KEPT:
                self._known.clear()
            self._learn(set().union(*(part for _, part in waiting if isinstance(part, list))).difference(self._known))
            for i, part in waiting:
                out[i].append(part if isinstance(part, bytes) else b"".join(map(self._known.__getitem__, part)))
            waiting.clear()

        for i, text in enumerate(texts):
            out.append([])
            for part in self._segments(text or ""):
                waiting.append((i, part if isinstance(part, bytes) else self._pieces(part)))
                size += len(part)
                if size >= SEGMENT:
                    settle()
                    size = 0
        settle()
        return [b"".join(parts) for parts in out]

    def _learn(self, pieces: set[str]) -> None:
        raw = {p: p.encode() for p in pieces}
        short = [p for p, b in raw.items() if len(b) <= WIDE]
        self._known.update((p, self.path(b)) for p, b in raw.items() if len(b) > WIDE)
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            self._known.update(zip(some, self.paths([raw[p] for p in some]), strict=True))

    def spell(self, ids: np.ndarray) -> bytes:
        """Labels of the arcs one after the other; numbers that are no token have none."""
        ids = ids[ids < self.n].astype(np.int64)
        out = []
        for k in range(0, len(ids), SEGMENT):
            part = ids[k : k + SEGMENT]
            size = self.offsets[part + 1] - self.offsets[part]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append(self.labels[np.repeat(self.offsets[part], size) + within].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Text of the ids; bytes that are not UTF-8 become replacement characters."""
        return self.spell(np.frombuffer(ids or b"", "<u4")).decode("utf-8", errors="replace")


_SPLITTER: list = []


def _library_split():
    if not _SPLITTER:
        _SPLITTER.append(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True))
    return _SPLITTER[0]


def compiled(spark: SparkSession, path: str | None = None):
    """The automaton of a vocabulary, read and compiled on the driver and broadcast; its size is the vocabulary's."""
    return spark.sparkContext.broadcast(Automaton.read(path or public_tokenizers.path(VOCABULARY)))


def _key(rows: DataFrame) -> StructField:
    return rows.schema["doc_id"]


def encoded(docs: DataFrame, path: str | None = None, spelled: bool = False) -> DataFrame:
    """(doc_id, ids) of every row's whole text, with ``spelled`` also ``decoded``, the text of the ids.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts have
    no ids. Null doc_id and repeated rows are kept, extra columns ignored; empty
    input gives no rows. Long texts are split in segments, a piece without any
    white space is encoded whole.
    """
    shared = compiled(docs.sparkSession, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value
        ids = automaton.encode(batch.column("text").to_pylist())
        out = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())}
        return record(**out, **({"decoded": pa.array([automaton.decode(i) for i in ids], pa.string())} if spelled else {}))

    schema = StructType([_key(docs)]).add("ids", "binary")
    return map_texts(docs.select("doc_id", "text"), work, schema.add("decoded", "string") if spelled else schema)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row's ``ids``, little-endian unsigned 32-bit integers; null ids are an empty text."""
    shared = compiled(rows.sparkSession, path)

    def work(batches):
        for batch in batches:
            yield record(doc_id=batch.column("doc_id"), text=pa.array([shared.value.decode(i) for i in batch.column("ids").to_pylist()], pa.string()))

    return rows.select("doc_id", "ids").mapInArrow(work, StructType([_key(rows)]).add("text", "string"))
