"""Token ids of the word-level BPE file, by a bounded cache of white-space separated chunks.

Pre-tokenisation of that file never crosses white space, so the ids of a text are those of its
chunks one after the other; each distinct chunk goes through the tokenizer library once per
cache generation.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

from cinderloom.llm.common import cache_of, claim

#: Distinct chunks kept by a worker; two generations are alive at most.
CACHE = 250_000
# Python splits on these too, but they are no white space to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Letters on which the two libraries' Unicode tables can't differ.
LETTERS = frozenset(c for c in map(chr, range(0x180)) if c.isalpha() and len(c.lower()) == 1)



def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class _Chunks(dict):
    """Chunk to little-endian unsigned 32-bit ids."""

    def __init__(self, library):
        super().__init__()
        self.encode, self.merge = library.encode, library.model.tokenize
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            # Letters and a closing mark are tokens apart, and case is dropped: the plain word serves its other forms.
            if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2] in LETTERS:
                ids = self[chunk[:-1]] + self[chunk[-1]]
            elif LETTERS.issuperset(chunk):
                ids = array("I", [t.id for t in self.merge(chunk.lower().encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            else:
                ids = array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = _Chunks(self.library)

    def forget(self) -> None:
        self.cache = _Chunks(self.library)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if any(c in text for c in SEPARATORS):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.cache) >= CACHE:
            new = _Chunks(self.library)
            new.old, self.cache = dict(self.cache), new
        return b"".join(map(self.cache.__getitem__, text.split()))


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    out = ChunkEncoder(path)
    cache_of("words", out.forget)
    return out


def encoder(path: str) -> ChunkEncoder:
    claim("words")
    return _encoder(path)
