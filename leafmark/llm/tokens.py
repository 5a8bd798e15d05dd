"""Token ids of whole texts with the tokenizers library, as used inside tasks.

Byte-level pre-tokenisation never joins characters across the start of a space-led word, so a text is cut there, equal
pieces are encoded once and remembered; plain words go to the tokenizer's merges at once. Texts with runs of white space in
which a cut could change the result, and texts that spell one of the vocabulary's added tokens, are encoded whole.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from operator import attrgetter

import numpy as np

_SPACE = r"[\s\x1c-\x1f\x85\xa0]"
_UNSAFE = re.compile(rf" (?<={_SPACE} )(?:{_SPACE}|\Z)")
_HAS_SPACE = re.compile(_SPACE)
#: Punctuation that never belongs to the word before it; the apostrophe may.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from 256 on.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SAME} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_SAME))}
_LEAD = chr(_BYTES[32])
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
_ID = attrgetter("id")


#: Pieces of text that a generation of a worker's memory holds, some 250 bytes each.
ENTRIES = 400_000


def _plain(word: str) -> bool:
    """All Latin letters, which the pre-tokeniser keeps together."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class _Memory(dict):
    """Ids by piece; what is missing is taken from the generation before or made, and kept."""

    def __init__(self, make, old: dict):
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        self[piece] = ids = self.make(piece) if ids is None else ids
        return ids


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes. The memory holds at most 2 x entries pieces."""

    def __init__(self, path: str, entries: int = ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.merge = self.tokenizer.model.tokenize
        self.entries, self.tails, self.young = entries, {}, _Memory(self._after_space, {})
        self.newline = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, lead: str, word: str) -> bytes:
        """A plain word is one pre-token, so it goes to the merges at once."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        ids = list(map(_ID, self.merge(lead + word)))
        return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, lead: str, piece: str) -> bytes:
        """Ids of a piece without white space, after a space (lead) or at the start of a line."""
        if _plain(piece):
            return self._word(lead, piece)
        core = piece.rstrip(_TAIL)
        if core and core != piece and _plain(core):
            tail = piece[len(core) :]
            if (ids := self.tails.get(tail)) is None:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                ids = self.tails[tail] = self._whole([tail])[0]
            known = self.young[core] if lead else self._word(lead, core)
            return known + ids
        return self._whole([" " + piece if lead else piece])[0]

    def _after_space(self, piece: str) -> bytes:
        """Ids of a piece that a space comes before."""
        if _plain(piece):
            return self._word(_LEAD, piece)
        if piece and not _HAS_SPACE.search(piece):
            return self._piece(_LEAD, piece)
        left, _, right = piece.partition("\n")
        # one line end between two words is a token of its own
        if left and right and not _HAS_SPACE.search(left) and not _HAS_SPACE.search(right):
            return self.young[left] + self.newline + self._piece("", right)
        return self._whole([" " + piece])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if _UNSAFE.search(t) or self.added and self.added.search(t)]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        cut = [(i, t.split(" ")) for i, t in enumerate(texts) if out[i] is None]
        ids_of = self.young.__getitem__
        for (i, pieces), first in zip(cut, self._whole([pieces[0] for _, pieces in cut])):
            out[i] = first + b"".join(map(ids_of, pieces[1:]))
        if len(self.young) > self.entries:
            self.young.old = {}
            self.young = _Memory(self._after_space, self.young)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, entries: int = ENTRIES) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, entries)
