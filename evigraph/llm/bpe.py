"""Whole-text tokenisation that asks the tokenizers library once per distinct pre-token.

A byte-pair tokeniser encodes each pre-token on its own, so the ids of a text are the ids of its pre-tokens in a row.
Texts of ASCII and Latin-1 letters are cut by the tokeniser's own pattern, written out for that alphabet; any other
text goes through the library whole, and so does a text with an added token such as <|endoftext|>, which the library takes out before it cuts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

CACHE_PIECES = 600_000
LETTER, DIGIT, SPACE = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9", " \t\n\x0b\x0c\r"
OTHER_ALPHABET = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
# The pre-token patterns of the two tokenisers; words first, since no contraction begins as they do.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PATTERN = re.compile(
    f" ?[{LETTER}]+| ?[{DIGIT}]+|{CONTRACTIONS}| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PATTERN = re.compile(f"[{LETTER}]+|[{DIGIT}]|{CONTRACTIONS}|[^{SPACE}{LETTER}{DIGIT}]+")


class Known(dict):
    """Ids of pre-tokens as bytes; the library is asked for one that is not there."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        code = self[piece] = self.encode(piece)
        return code


class Encoder:
    """Ids of texts by the tokeniser file `name` of the public tokenisers; ids fit four bytes, two where they can."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.lower = self.library.normalizer is not None
        self.pattern = WORD_PATTERN if self.lower else BYTE_PATTERN
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        bare = Tokenizer.from_file(public_tokenizers.path(name))
        if self.lower:
            bare.normalizer = None  # pre-tokens of this alphabet are in lower case, composed and without white space already
        self.known = Known(lambda piece: self._code(bare.encode(piece, add_special_tokens=False).ids))

    def _code(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self._code(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if the library must see it whole."""
        if not text.isascii() and OTHER_ALPHABET.search(text):
            return None
        if self.lower:
            text = text.lower()
        return None if any(token in text for token in self.added) else self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, equal to the library's for the whole text."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        get = self.known.__getitem__
        for text in texts:
            pieces = self.pieces(text)
            yield np.frombuffer(self.whole(text) if pieces is None else b"".join(map(get, pieces)), dtype=self.dtype)
            if len(self.known) > CACHE_PIECES:
                self.known.clear()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder per Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
