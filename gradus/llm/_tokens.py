"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once per worker."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gradus.llm._memory import held
from gradus.llm._words import HashIndex, Ragged, pieces, prefix_hash, slices, span_hash, strings

MOST_PIECES = 800_000
#: Letters below this are the same in every Unicode version.
_OLD = "ɐ"


class Encoder:
    """Ids of texts by a tokenizer file; pieces seen before come from a table (bounded, then emptied)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower = any(n.get("type") == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.plain = spec["normalizer"] is None
        keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        moved = iter(range(0x100, 0x200))
        self.visible = {b: b if b in keep else next(moved) for b in range(256)}
        self.reset()

    def reset(self) -> None:
        self.index, self.ids = HashIndex(), Ragged(np.uint32)

    def _letters(self, piece: str) -> str | None:
        """The model's input for a piece that is one word of letters, else None."""
        word = piece[1:] if piece[:1] == " " else piece
        if not word.isalpha() or not (word.isascii() or max(word) < _OLD and "İ" not in word):
            return None
        if self.plain:
            return piece.encode().decode("latin-1").translate(self.visible)
        return word.lower().encode().decode("latin-1").translate(self.visible) if self.lower else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out, rest, at = [], [], []
        tokenize = self.tokenizer.model.tokenize
        for i, piece in enumerate(texts):
            word = self._letters(piece)
            if word is None:
                out.append(None)
                rest.append(piece)
                at.append(i)
            else:
                out.append([t.id for t in tokenize(word)])
        for i, e in zip(at, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[i] = e.ids
        return out

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the n + 1 places where each text's begin."""
        start, end, first = pieces(buf, offsets)
        h = span_hash(prefix_hash(buf), start, end)
        which = self.index.lookup(h)
        if (new := np.flatnonzero(which < 0)).size:
            _, one = np.unique(h[new], return_index=True)
            new = new[one]
            if self.index.n + len(new) > MOST_PIECES:
                self.reset()
                _, new = np.unique(h, return_index=True)
            raw = buf.tobytes()
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                self.index.insert(h[part])
                self.ids.extend(self.encode([raw[start[i] : end[i]].decode("utf-8", "replace") for i in part]))
            which = self.index.lookup(h)
        ids, begin = self.ids.gather(which)
        return ids, begin[first]


def encoder(path: str) -> Encoder:
    return held(path, lambda: Encoder(path))


def encoded(batch: pa.RecordBatch, text: str, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text of a batch."""
    buf, offsets = strings(batch, text)
    tokens = encoder(path)
    special = [s.encode() for s in tokens.special]
    for lo, hi in slices(offsets):
        part, own = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if any(s in part.tobytes() for s in special):  # a special token's own text may hold a cut
            raw = part.tobytes()
            for i in range(hi - lo):
                text_ = raw[own[i] : own[i + 1]].decode("utf-8", "replace")
                yield lo + i, np.array(tokens.tokenizer.encode(text_, add_special_tokens=False).ids, np.uint32)
            continue
        ids, begin = tokens.texts(part, own)
        for i in range(hi - lo):
            yield lo + i, ids[begin[i] : begin[i + 1]]
