"""Encoding whole texts with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Words whose ids a worker remembers; beyond that the memory is emptied.
REMEMBERED = 1_000_000
#: What the word pattern of the vocabulary file finds in lower-case text of the plain characters below.
WORDS = re.compile(r"[a-zß-öø-ÿĀ-ž]+|'s|'t|'re|'ve|'m|'ll|'d|\d|[^\s\w]+(?:_+[^\s\w]*)*|_+[^\s\w]*(?:_+[^\s\w]*)*")
#: Text in which Python and the library agree on classes, case and composition: ASCII without odd controls, Latin letters, dashes, quotes and the like.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įĲ-ž‐-‧‰-⁞€]*")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's encode(text, add_special_tokens=False).

    The vocabulary splits lower-case text into words and encodes each by itself, so a word is encoded by the library
    once and then remembered. Texts with characters outside PLAIN or with special tokens go to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.library.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)

    def separately(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call: the last id of a word, and no other, stands for a piece that ends one."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return [self.whole(w) for w in words]
        stops *= 4
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return self.whole(text)
        words = WORDS.findall(unicodedata.normalize("NFC", text).lower())
        known = self.words
        if new := set(words).difference(known):
            if len(known) > REMEMBERED:
                known.clear()
                new = set(words)
            new = list(new)
            for at in range(0, len(new), 4096):
                known.update(zip(part := new[at : at + 4096], self.separately(part), strict=True))
        return b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def texts(column: pa.Array):
    """The column's texts one by one; null is the empty text."""
    for x in column:
        yield x.as_py() or ""
