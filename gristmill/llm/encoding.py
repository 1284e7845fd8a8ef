"""Token ids of whole texts, as the tokenizers library gives them.

A library call on a whole text costs most of its time on words that were met
before. Texts are therefore cut at places where the tokenizer itself always
cuts, and each distinct piece is encoded once a worker process, which keeps its
encoder from task to task. Two layouts are known:

* lower-cased words (NFC, white space dropped, lower case, then pieces);
* byte-level pieces that carry their leading space.

A text of plain letters, digits, ASCII punctuation and white space is cut into
the very pieces of the pre-tokenizer. Any other text (special strings, other
scripts, odd white space) goes to the library itself, in slices that end at a
single space between two ASCII letters or digits, where no piece and no special
string can straddle. So results equal the library's on every text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ODD = re.compile(rf"[^\t-\r -~{LETTERS[6:]}]")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LOWER_PIECES = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
BYTE_PIECES = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Long texts are encoded in parts of about this many characters.
PART_CHARS = 50_000
#: Most pieces a worker process remembers; those met later are encoded each time.
MOST_PIECES = 400_000


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write byte b as its own character if printable, else as the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(own)))
    return {c: "".join(table[b] for b in chr(c).encode()) for c in range(256)}


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` cut before single spaces between ASCII letters or digits; joined, the parts give the text."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class _Ids(dict):
    """piece -> its ids as bytes; unknown pieces are encoded by the tokenizer's own model."""

    def __init__(self, model, most: int):
        self.model, self.most, self.table = model, most, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(piece.translate(self.table))], "<u4").tobytes()
        if len(self) < self.most:
            self[piece] = ids
        return ids


class Encoder:
    """Ids or counts of whole texts by a tokenizer file."""

    def __init__(self, path: str, most_pieces: int = MOST_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        split, norm = layout.get("pre_tokenizer") or {}, layout.get("normalizer") or {}
        self.lower = [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        known = self.lower and [x.get("type") for x in split.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        known |= not norm and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.pieces = (LOWER_PIECES if self.lower else BYTE_PIECES) if known else None
        special = [re.escape(x["content"]) for x in layout.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        self.ids_of = _Ids(self.tokenizer.model, most_pieces)
        self.length_of: dict[str, int] = {}
        #: The narrowest integers that hold every id.
        self.id_type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.most = most_pieces

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Encoder:
        """The encoder that this process keeps for ``path``."""
        return Encoder(path)

    def plain(self, text: str) -> list[str] | None:
        """The pieces of a plain text, or None if the library has to see the text."""
        if self.pieces is None or ODD.search(text) or (self.special and self.special.search(text)):
            return None
        return self.pieces.findall(text.lower() if self.lower else text)

    def _library(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in parts(text):
            pieces = self.plain(part)
            out.append(np.array(self._library([part])[0].ids, "<u4").tobytes() if pieces is None else b"".join(map(self.ids_of.__getitem__, pieces)))
        return b"".join(out)

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of ids of a batch of texts; pieces not met before go to the library as one batch."""
        cut = [(i, p) for i, t in enumerate(texts) for p in parts(t)]
        pieces = [self.plain(p) for _, p in cut]
        known = self.length_of
        if len(known) > self.most:
            known.clear()
        new = list({x for x in chain.from_iterable(p for p in pieces if p) if x not in known})
        known.update(zip(new, map(len, self._library(new)), strict=True))
        out = [0] * len(texts)
        for (i, part), found in zip(cut, pieces, strict=True):
            out[i] += len(self._library([part])[0]) if found is None else sum(map(known.__getitem__, found))
        return out
