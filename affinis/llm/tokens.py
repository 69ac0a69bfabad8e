"""Token ids of whole texts by the tokenizers library, with a bounded cache of what pre-tokenization parts.

Where a text has only ASCII and Latin letters, one pattern parts it just as byte-level pre-tokenization does; each part is
looked up, and what was not met before goes to the library's model. Other texts are cut at spaces before such characters
(byte-level BPE never joins across these), and what holds any other character goes through the library as it is, as does a
whole text in which an added token is spelt out. The ids are those of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

WORDS, LONGEST = 300_000, 64  # entries of a generation; when full, the one before goes and what is asked for again stays
SPACE = re.compile(r" (?=[!-~À-ɏ])")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = re.compile(r"[^ \t\n!-~À-ɏ]").search
# Fixed value: the pre-tokenization pattern of byte-level BPE, over the characters above
PARTS = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+").findall


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: its own where printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """part of a text -> its ids as bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        size = self.dtype.itemsize
        self.as_bytes = [i.to_bytes(size, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            ids = self.as_bytes
            if OTHER(part):
                found = b"".join([ids[i] for i in self.tokenizer.encode(part, add_special_tokens=False).ids])
            else:
                found = b"".join([ids[t.id] for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        if len(part) <= LONGEST:
            self[part] = found
        return found

    def parts(self, text: str) -> list[str]:
        """What can be encoded one by one."""
        if not OTHER(text):
            return PARTS(text)
        first, *rest = SPACE.split(text)
        pieces = chain([first] if first else [], (f" {p}" for p in rest))
        return [w for p in pieces for w in ([p] if OTHER(p) else PARTS(p))]

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text; none for an empty one or null."""
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, self.parts(text))), dtype=self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This Python worker's encoder, kept from task to task."""
    return Encoder(path)
