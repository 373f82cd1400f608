"""Byte-level BPE ids of whole texts, through the ``tokenizers`` library.

The library needs microseconds per word, and most words of a corpus repeat. A
text is therefore cut before every space that a non-space follows, which is
where the pre-tokenizer of a byte-level BPE always starts a new token, and each
worker remembers the ids of the pieces it has met. Only new pieces reach the
library; those with line ends inside are put together from their lines, as a
line end between two visible characters is a token of its own. The memory of a
worker holds two generations of ``MEMORY`` pieces and forgets the older one; it
changes the speed and never the ids.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np

from graphlens.llm.common import held

ID_BYTES = 4
MEMORY = 250_000
#: Longer pieces, such as texts without spaces, are not kept.
LONGEST_KEPT = 64
#: White space that str.split(" ") would cut in the wrong place: a space that no visible character follows.
_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: Characters of a long text that are encoded at a time.
SEGMENT = 1_000_000
_BOUNDARY = re.compile(r" (?=\S)")


def _segments(text: str):
    """Parts of a text that are cut before a space that a non-space follows, where a new token begins anyway."""
    begin = 0
    while len(text) - begin > SEGMENT:
        at = _BOUNDARY.search(text, begin + SEGMENT)
        if not at:
            break
        yield text[begin : at.start()]
        begin = at.start()
    yield text[begin:]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers in a bytes object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: The library's own cache of words costs more than it saves: pieces met before never reach it.
        resize = getattr(self.library.model, "_resize_cache", None)
        if resize:
            resize(0)
        #: Tokens that begin with the byte of a space.
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        for token, number in self.library.get_vocab().items():
            self.opens[number] = token.startswith("Ġ")
        #: The token of a line end, and ids of words that follow one.
        self.line = self.library.token_to_id("Ċ")
        self.lines: dict[str, bytes] = {}
        #: Pieces of the texts at hand that were put together; they seldom repeat and are not kept.
        self.joined: list[str] = []
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space, from one call on all of them in a row.

        Every piece but its first character is free of spaces, so its ids begin
        at the tokens that begin with a space.
        """
        known = {p: self.old[p] for p in pieces if p in self.old}
        fresh = [p for p in pieces if p not in known]
        parts = {}
        if self.line is not None:
            for p in fresh:
                if "\n" in p and len(p) <= LONGEST_KEPT:
                    words = p.split("\n")
                    if words == p.split():
                        parts[p] = words
        self.joined = [*parts]
        heads = {words[0] for words in parts.values()} - known.keys()
        for p in heads:
            ids = self.young.get(p) or self.old.get(p)
            if ids:
                known[p] = ids
        fresh = [p for p in {*fresh, *heads} if p not in known and p not in parts]
        self._follow([p for p in fresh if p and " " not in p and not p[0].isspace()], " ", self.opens, known)
        for p in fresh:
            if p not in known:
                known[p] = self._direct(" " + p)
        if parts:
            if len(self.lines) > MEMORY:
                self.lines = {}
            wanted = {w for words in parts.values() for w in words[1:]} - self.lines.keys()
            self._follow([*wanted], "\n", self.line, self.lines)
            for p, words in parts.items():
                known[p] = b"".join((known[words[0]], *(self.lines[w] for w in words[1:])))
        return known

    def _follow(self, words: list[str], before: str, opens, known: dict[str, bytes]) -> None:
        """Put the ids of ``words``, each with the character ``before`` it, into ``known``; ``opens`` tells or is the token that begins one."""
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            ids = self._ids(before + before.join(part))
            first = np.flatnonzero(opens[ids] if isinstance(opens, np.ndarray) else ids == opens)
            if len(first) != len(part):
                known |= {p: self._direct(before + p) for p in part}
                continue
            data, bounds = ids.tobytes(), (np.append(first, len(ids)) * ID_BYTES).tolist()
            known |= {p: data[a:b] for p, a, b in zip(part, bounds, bounds[1:])}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object per text; a missing text counts as empty. A long text is encoded in parts."""
        if any(len(t or "") > SEGMENT for t in texts):
            return [b"".join(self._encode([s])[0] for s in _segments(t or "")) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = []
        for text in texts:
            text = text or ""
            if "<|" in text:  # special strings are left to the library
                cut.append((self._direct(text), []))
            elif _ODD.search(text) or text[:1].isspace():
                first, *rest = _CUT.split(text)
                if not first and rest:
                    first, *rest = rest
                cut.append((self._direct(first), [p[1:] for p in rest]))
            else:
                first, *rest = text.split(" ")
                cut.append((self._direct(first), rest))
        met: set[str] = set().union(*(pieces for _, pieces in cut))
        learnt = self._learn(met - self.young.keys())
        if len(self.young) + len(learnt) - len(self.joined) > MEMORY:
            self.old, self.young = self.young, {p: self.young[p] for p in met if p in self.young}
        large = {p: ids for p, ids in learnt.items() if len(p) > LONGEST_KEPT}
        self.young.update((p, ids) for p, ids in learnt.items() if p not in large)
        if large:
            found = [b"".join((first, *(large[p] if p in large else self.young[p] for p in pieces))) for first, pieces in cut]
        else:
            get = self.young.__getitem__
            found = [b"".join((first, *map(get, pieces))) for first, pieces in cut]
        for p in self.joined:
            self.young.pop(p, None)
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder; it stays until a task that encodes nothing runs in the worker."""
    return Encoder(path)


held(encoder.cache_clear, "packing", "token_counts")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def portions(texts: list[str | None], most: int = 2_000_000):
    """Ranges of a batch with at most about ``most`` characters, so that memory follows the longest text and no batch."""
    begin = held = 0
    for at, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > most:
            yield begin, at
            begin, held = at, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)
