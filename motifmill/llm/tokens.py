"""Token ids by the tokenizers library, each distinct chunk of a text encoded once.

A chunk is a run of blanks with what follows it: letters only, ASCII marks only, or anything else up to the next blank. The pre-tokenizers
in use never join a character with a blank after it, nor a letter with a mark that isn't an apostrophe, and normalizers don't look across
either border. So the ids of a text are those of its chunks, one after the other; texts for which this could fail are chunks as a whole.
A chunk of letters or marks is one piece to the library's model, which then gets it without the steps before.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

_BLANK, _LETTER, _MARK = r"\x20\x09-\x0D", r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF", r"!-&(-/:-@\[-`{-~"
_REST = f"(?![^{_BLANK}{_LETTER}{_MARK}])"
_CHUNK = re.compile(f"[{_BLANK}]*+(?:[{_LETTER}]++{_REST}|[{_MARK}]++{_REST}|[^{_BLANK}]++)|[{_BLANK}]++")
_PIECE = re.compile(f"([{_BLANK}]*)([{_LETTER}]+|[{_MARK}]+)")
#: Blanks to the library that end no chunk here.
_OTHER_BLANKS = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: Chunks remembered by a worker at a time, and characters of one that is.
KNOWN = 1 << 19
KNOWN_CHARS = 32


def _byte_chars() -> dict[int, str]:
    """The character of each byte in a byte-level vocabulary: printable ones stand for themselves, the others for those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_CHARS = _byte_chars()


def byte_piece(blanks: str, rest: str) -> str | None:
    """What a byte-level model takes a chunk of letters or marks for: it keeps one blank before it, other blanks are pieces of their own."""
    return blanks + rest if blanks in ("", " ") else None


def word_piece(blanks: str, rest: str) -> str | None:
    """The same for a model of lower-cased pieces without blanks."""
    return rest.lower()


class Encoder(dict):
    """A tokenizer file, without special tokens added; a special token's string in a text is that token. Holds the ids of known chunks."""

    def __init__(self, path: str, piece: Callable[[str, str], str | None], known: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.file = Tokenizer.from_file(path)
        self.model = self.file.model
        self.piece = piece
        self.known = known
        self.special = [t.content for t in self.file.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> bytes:
        m = _PIECE.fullmatch(chunk) if len(chunk) <= KNOWN_CHARS else None
        piece = self.piece(m[1], m[2]) if m else None
        if piece is None:
            ids = self.file.encode(chunk, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_CHARS))]
        out = np.array(ids, "<u4").tobytes()
        if len(chunk) <= KNOWN_CHARS:
            if len(self) >= (self.known or KNOWN):
                self.clear()
            self[chunk] = out
        return out

    def uncut(self, text: str) -> bool:
        """Whether chunks could fail for the text. Searches for fixed strings take a small part of a pattern's time."""
        return any(map(text.__contains__, self.special)) or not text.isascii() and any(map(text.__contains__, _OTHER_BLANKS))

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        chunks = [text] if self.uncut(text) else _CHUNK.findall(text)
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)), "<u4")


_open: dict[str, Encoder] = {}


def opened(path: str, piece: Callable[[str, str], str | None], known: int | None = None) -> Encoder:
    """One for each worker process, which remembers ``known`` chunks at a time (KNOWN without it)."""
    if path not in _open:
        _open[path] = Encoder(path, piece, known)
    _open[path].known = known
    return _open[path]
