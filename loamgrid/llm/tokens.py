"""Fast exact tokenization: ids of whitespace-delimited pieces are remembered."""

from __future__ import annotations

import os
import re
import struct
import sys
import types

import numpy as np

#: Letters of Latin-1 and at most one run of marks after them: one or two pre-tokens, known without the tokenizer.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z").match
#: Entries of the dictionary for pieces that no longer fit into the lasting one.
_RECENT = 100_000


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """Encodes UTF-8 texts to ids exactly as the tokenizer itself does.

    Holds for tokenizers that drop white space and never join across it, as
    `word_bpe_49k.json` does (NFC, lower case, words and marks apart, byte
    letters; its added tokens hold no white space).  Ids of pieces are kept in a
    dictionary of at most `limit` entries that lives as long as the worker
    process.  A new piece of plain letters goes straight to the BPE model, any
    other through the whole tokenizer.  Tests compare it with whole-text
    encoding.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.recent: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> PieceEncoder:
        """One per worker process and file, kept outside this module, which is shipped by value."""
        kept = sys.modules.setdefault("_loamgrid_encoders", types.ModuleType("_loamgrid_encoders"))
        if path not in vars(kept):
            setattr(kept, path, cls(path))
        return vars(kept)[path]

    @staticmethod
    def release() -> None:
        """Drop the encoders of this worker process."""
        sys.modules.pop("_loamgrid_encoders", None)

    def _new(self, piece: bytes) -> bytes:
        found = self.known.get(piece) or self.recent.get(piece)  # met before in the same text, or lately
        if found is not None:
            return found
        text = piece.decode("utf-8", "replace")
        simple = _SIMPLE(text)
        if simple:
            word, marks = simple.groups()
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(word)]
            if marks:
                ids += [t.id for t in self.model.tokenize(marks)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(self.known) < self.limit:
            self.known[piece] = found
        else:
            if len(self.recent) >= _RECENT:
                self.recent.clear()
            self.recent[piece] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """Ids of a text, as the bytes of little-endian integers of `dtype`."""
        pieces = text.split()
        ids = list(map(self.known.get, pieces))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = self._new(pieces[i])
        return b"".join(ids)
