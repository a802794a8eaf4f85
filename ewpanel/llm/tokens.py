"""Token ids of whole texts by a public tokenizer, with a cache of short chunks."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from ewpanel.llm.common import utf8_parts

#: Chunks that a worker remembers (about 200 bytes each); then it starts anew.
CACHE_ENTRIES = 900_000
_encoders: dict[str, "ChunkEncoder"] = {}


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> "ChunkEncoder":
    """One encoder for each vocabulary and Python worker."""
    if name not in _encoders:
        _encoders[name] = ChunkEncoder(name)
    return _encoders[name]


class ChunkEncoder:
    """Encodes texts exactly as ``tokenizers`` does on the whole text.

    The pre-tokenizers of these vocabularies never join a character that is not
    white space to a space after it, and look ahead over white space only; nor do
    they join an ASCII letter to ASCII punctuation after it, the apostrophe apart.
    A text may thus be cut at these places. Each different chunk is encoded once
    and its ids are kept, so repeated words cost a lookup. Where the character
    before a space could be white space outside ASCII no cut is made, which is
    always right.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else vocabulary_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text's own characters only
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32) and the number of ids of each text."""
        data, offsets = utf8_parts(texts)
        n = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cut = self._cuts(data)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        edges = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        entry = self._entries(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        length = self.size[entry]
        ends = np.cumsum(length)
        place = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.first[entry] - (ends - length), length)
        before = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return self.table[place], np.diff(before)

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        kind = _KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
        at = np.flatnonzero(kind == _SPACE)
        at = at[at > 0]
        last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        odd = (second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3) & (second >= 0x80) & (second < 0xC0))
        cut[at] = np.where(last < 128, (_KIND[last] != _SPACE) & (_KIND[last] != _BLANK), ~odd)
        return cut

    def _entries(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of each chunk stand; encodes those not met before."""
        if len(self.known) + len(chunks) > CACHE_ENTRIES:
            self._forget()
        known = self.known
        new = [c for c, k in zip(chunks, map(known.get, chunks)) if k is None]
        if new:
            ids = [e.ids for a in range(0, len(new), 10_000) for e in self.tokenizer.encode_batch_fast(new[a : a + 10_000], add_special_tokens=False)]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first = np.concatenate([self.first, len(self.table) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))


_OTHER, _LETTER, _MARK, _SPACE, _BLANK = range(5)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
_KIND[9:14] = _BLANK
_KIND[32] = _SPACE
