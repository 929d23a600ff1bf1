"""Tokenising whole texts inside tasks with a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import PrefixHash, byte_table, mixed, text_slices

#: The tokenizer file that the registered queries name; operators take any path.
TOKENIZER = "word_bpe_49k.json"


def public_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(path: str, plain_specials: bool = False) -> WordTokenizer:
    """One for each worker process and kind, so that what it has learnt is used again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokenizer(path, plain_specials)


def _classes() -> np.ndarray:
    """0 blank, 1 ASCII letter, 2 ASCII mark, 3 anything else."""
    kind = np.full(256, 3, np.uint8)
    kind[33:127] = 2
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[48:58] = 3
    kind[65:91] = kind[97:123] = 1
    return kind


class WordTokenizer:
    """Ids of whole texts, for a lower-casing tokenizer that drops white space and
    splits letters from marks: a text's ids are then those of its chunks, cut at blanks
    and between an ASCII letter and a following ASCII mark. Each distinct chunk is
    encoded once and kept under a 64-bit hash of its lower-cased bytes, max_kept chunks
    at most (the store then starts anew, which changes speed only)."""

    KINDS = _classes()
    MARK = "\x01"

    def __init__(self, path: str, plain_specials: bool = False, max_kept: int = 600_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if plain_specials:
            self.model.encode_special_tokens = True
        self.mark_id = self.model.encode(self.MARK, add_special_tokens=False).ids
        assert len(self.mark_id) == 1, "the tokenizer has no single token for the mark"
        self.max_kept = max_kept
        self.tables = {True: byte_table(True), False: mixed(byte_table())}
        self._clear()

    def _clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, n, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for held, at, size in self.levels:
            if len(held):
                k = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[k] == keys
                begin[hit], n[hit] = at[k[hit]], size[k[hit]]
                known |= hit
        return begin, n, known

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has: chunks are encoded many at a time, a mark after each."""
        odd = [self.MARK in c for c in chunks]
        joined = [f" {self.MARK} ".join("" if o else c for c, o in zip(chunks[k : k + 128], odd[k : k + 128], strict=True)) + f" {self.MARK}" for k in range(0, len(chunks), 128)]
        # A few at a time: the library's own results are many times the size of the ids.
        ids = np.concatenate([np.array(e.ids, np.uint32) for k in range(0, len(joined), 8) for e in self.model.encode_batch_fast(joined[k : k + 8], add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark_id[0])
        sizes = np.diff(marks, prepend=-1) - 1
        if any(odd):
            parts = np.split(np.delete(ids, marks), np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.model.encode(chunks[k], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return np.delete(ids, marks), sizes

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        if sum(len(x[0]) for x in self.levels) + len(keys) > self.max_kept or self._find(keys)[2].any():
            self._clear()
        ids, sizes = self._encode(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        main, recent = self.levels
        recent = self._joined(recent, (keys, begin, sizes))
        if len(recent[0]) > max(50_000, len(main[0]) // 8):
            main, recent = self._joined(main, recent), tuple(x[:0] for x in recent)
        self.levels = [main, recent]

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = b"\n".join(texts) + b"\n"
        data = np.frombuffer(buf, np.uint8)
        fine = b"<|" not in buf  # else a special token's string might be cut or folded
        kind = self.KINDS[data]
        blank, after_blank = kind == 0, np.empty(len(data), bool)
        after_blank[0], after_blank[1:] = True, kind[:-1] == 0
        start = ~blank & after_blank
        if fine:
            cut = np.zeros(len(data), bool)
            cut[1:] = (kind[:-1] == 1) & (kind[1:] == 2)
            start |= cut
        starts, ends = np.flatnonzero(start), np.flatnonzero((blank | start) & ~after_blank)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        chunk_ends = np.searchsorted(starts, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        keys = mixed(PrefixHash(data, self.tables[fine]).hash(starts, ends) + (ends - starts).astype(np.uint64))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        begin, n, known = self._find(distinct)
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], [buf[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            begin, n, known = self._find(distinct)
            if not known.all():  # the store was started anew meanwhile: all of this slice again
                self._learn(distinct, [buf[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
                begin, n, known = self._find(distinct)
        begin, n = begin[which], n[which]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(stop[-1]) + np.repeat(begin - stop + n, n)]
        return ids, np.diff(np.append(0, stop)[chunk_ends], prepend=0)

    def documents(self, texts: pa.Array, limit: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of each text in turn, worked out about limit bytes at a time."""
        for raw in text_slices(texts, limit):
            ids, sizes = self._slice(raw)
            at = 0
            for n in sizes.tolist():
                yield ids[at : at + n]
                at += n
