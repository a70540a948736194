"""Token ids of texts by the tokenizers library, remembered per word.

Byte-level BPE works on pre-tokens, each by itself, and no pre-token reaches
across a space that stands between two characters that are not white space.
Texts whose only white space is single spaces and line ends (not side by side)
are therefore cut at spaces; a word of familiar characters is cut into its
pre-tokens, and the library's model encodes each distinct one once per worker.
Any other word or text goes to the library whole. All ways give the library's
ids for the text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from quillgate.llm.worker import only

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Words and pre-tokens that a worker remembers before it starts anew.
WORDS_KEPT, PIECES_KEPT = 700_000, 200_000
ODD_SPACE = re.compile(r"[^\S \n]")
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
#: Characters that are letters, digits or other signs in every Unicode version.
FAMILIAR = re.compile(rf"[\n\x20-\x7E{LETTER}]*")
#: The pre-token pattern of the vocabulary (a fixed value of its format), for familiar characters.
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, int]:
    """The vocabulary's letter for each byte (a fixed rule of byte-level BPE): visible Latin-1 signs stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Pieces(dict):
    """pre-token -> ids; the library's model encodes those not met before."""

    def __init__(self, model) -> None:
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def ids(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():
            spelled = "Ġ" + piece[1:] if piece[0] == " " else piece
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES_KEPT:
            self.clear()
        value = self[piece] = self.ids(piece)
        return value


class _Words(dict):
    """word -> ids of a space and the word."""

    def __init__(self, pieces: _Pieces, library) -> None:
        self.piece, self.ids, self.library = pieces.__getitem__, pieces.ids, library

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        if word.isalpha() and max(word) <= "ſ":
            value = self.ids(" " + word)
        elif word[-1:] in (",", ".") and word[:-1].isalpha() and max(word) <= "ſ":
            value = self[word[:-1]] + self.piece(word[-1])
        elif FAMILIAR.fullmatch(word):
            value = b"".join(map(self.piece, PIECES.findall(" " + word)))
        else:
            value = self.library([" " + word])[0]
        self[word] = value
        return value


class Encoder:
    """ids as little-endian unsigned 32-bit bytes, for whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(_Pieces(self.tokenizer.model), self._library)
        probe = "ab é1'll «x»,\nY"
        self.splits = b"".join(map(self.words.piece, PIECES.findall(probe))) == self._library([probe])[0]  # else another kind of vocabulary

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> bool:
        if not self.splits or "  " in text or " \n" in text or "\n " in text or any(s in text for s in self.specials):
            return False
        return not any(c in text for c in ODD_ASCII) if text.isascii() else not ODD_SPACE.search(text)

    def encode(self, texts: list[str | None], end: int | None = END_ID) -> list[bytes]:
        """The ids of each text (null: empty), with ``end`` after them."""
        tail = b"" if end is None else end.to_bytes(4, "little")
        word, out = self.words.__getitem__, []
        for text in texts:
            text = text or ""
            if self._cut(text):
                first, *rest = text.split(" ")
                head = b"".join(map(self.words.piece, PIECES.findall(first))) if FAMILIAR.fullmatch(first) else self._library([first])[0]
                out.append(b"".join([head, *map(word, rest), tail]))
            else:
                out.append(self._library([text])[0] + tail)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    only("tokenizing", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
