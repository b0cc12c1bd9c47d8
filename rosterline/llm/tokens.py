"""Token ids of whole texts, encoded piece by piece with a cache.

A text is cut before every space that a visible character follows. Both tokenizer families used
here begin a new token at such a place, whatever stands around it, so the ids of the text are the
ids of the pieces in order. Pieces repeat, so most of them are looked up. A piece keeps its leading
space, which byte-level vocabularies encode.
"""

from __future__ import annotations

import os
import re
from array import array

CUT = re.compile(r" (?=\S)")
LOOSE = re.compile(r" (?:\s|$)")
#: A Latin word and ASCII signs or digits after it; both vocabularies begin a new token between.
WORD_AND_SIGNS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)((?:[!-@\\[-`{-~].*)?)", re.DOTALL)
#: Longer pieces are encoded but not kept; a generation of the cache holds so many pieces.
CACHED_CHARS, CACHE_PIECES = 64, 450_000


def _byte_symbols() -> dict[int, str]:
    """Symbols of byte-level vocabularies for the bytes that do not show themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_SYMBOLS = _byte_symbols()
_encoders: dict[tuple[str, int], Encoder] = {}


class Pieces(dict):
    """Piece (without its leading space) -> its ids as unsigned 32-bit bytes.

    A missing piece is encoded when it is asked for. There are two generations: a full one becomes
    the old one, and pieces still in use move up.
    """

    def __init__(self, tokenizer) -> None:  # noqa: ANN001
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        #: The same for signs that follow a word without a space.
        self.signs: dict[str, bytes] = {}
        #: Symbol of the leading space, and whether the library lower-cases; checked on samples.
        self.fold = tokenizer.normalizer is not None
        self.lead = "" if self.fold else BYTE_SYMBOLS.get(ord(" "), " ")
        samples = ["the", "Words", "\u00c9t\u00e9", "stra\u00dfe", "XYZZY", "\u00f1\u00e0\u00ff"]
        self.direct = all(self.word(word) == self.whole(" " + word) for word in samples)

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library's whole pipeline."""
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array("I", encoded[0].ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a Latin word after a space, straight from the library's merge model."""
        symbols = word.lower() if self.fold else word
        if not symbols.isascii():
            symbols = symbols.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return array("I", [token.id for token in self.tokenize(self.lead + symbols)]).tobytes()

    def sign(self, sign: str) -> bytes:
        raw = self.signs.get(sign)
        if raw is None:
            raw = self.whole(sign)
            if len(sign) <= CACHED_CHARS:
                if len(self.signs) >= CACHE_PIECES:
                    self.signs.clear()
                self.signs[sign] = raw
        return raw

    def __missing__(self, piece: str) -> bytes:
        raw = self.old.get(piece)
        if raw is None:
            cut = WORD_AND_SIGNS.fullmatch(piece) if self.direct else None
            if cut is None:
                raw = self.whole(" " + piece)
            elif cut[2]:
                raw = self[cut[1]] + self.sign(cut[2])
            else:
                raw = self.word(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = raw
        return raw


class Encoder:
    """Encodes texts with one vocabulary file, and appends ``end_id`` to each."""

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = array("I", [end_id]).tobytes()
        self.pieces = Pieces(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as unsigned 32-bit integers."""
        out = []
        for text in texts:
            # Without a space before white space or the end, every space is a cut.
            head, *rest = CUT.split(text) if LOOSE.search(text) else text.split(" ")
            ids = map(self.pieces.__getitem__, rest)
            out.append(b"".join((self.pieces.whole(head), *ids, self.end)))
        return out


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker process, vocabulary and end id."""
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]
