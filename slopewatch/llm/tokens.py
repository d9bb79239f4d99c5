"""Token ids of whole texts under a public word-BPE vocabulary, by way of its library."""

from __future__ import annotations

import array
import re

from tokenizers import Tokenizer

KEPT = 200_000  # pieces of text whose ids a process remembers
_LATIN = "a-zß-öø-ÿ"
#: Text that the vocabulary's rules split into runs of letters, single digits and runs of marks, without contractions.
_PLAIN = re.compile(rf"[{_LATIN}À-ÖØ-Þ0-9!-&(-/:-@\[-`{{-~]+")
_PARTS = re.compile(rf"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


def byte_letters() -> dict[int, int]:
    """Public rule of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: b if b in shown else next(hidden) for b in range(256)}


class WordTokens:
    """Ids as little-endian unsigned 32-bit integers, equal to the library's for the whole text.

    The vocabulary lower-cases, drops white space and never joins across it, so a
    text's ids are those of its pieces between white space. Each piece is encoded
    once and remembered. A text that may hold a special token goes to the library whole.
    """

    _loaded: dict[str, WordTokens] = {}

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordTokens:
        """One instance per process and path."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if part not in self.parts:
            shown = part.encode().decode("latin-1").translate(self.letters)
            self.parts[part] = array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return self.parts[part]

    def _piece(self, raw: bytes) -> bytes:
        text = raw.decode()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self._part, _PARTS.findall(text.lower())))
        return self._whole(text)

    def ids(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        if b"<|" in raw:
            return self._whole(text)
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        if len(self.parts) > KEPT:
            self.parts.clear()
        known = self.pieces
        words = raw.lower().split()
        for word in words:
            if word not in known:
                known[word] = self._piece(word)
        return b"".join([known[word] for word in words])
