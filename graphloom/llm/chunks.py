"""Token ids of whole texts by way of their chunks, so that each distinct chunk is encoded once per worker.

A chunk is a piece of a text whose ids do not depend on what surrounds it. A bounded cache
keeps the ids of chunks in arrays; the ids of a block of texts are one gather.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from graphloom.llm.common import MASK, word_hashes, words

CACHE_CHUNKS = 500_000
CACHE_IDS = 6_000_000
# New chunks given to the library as one text.
_JOINED = 128


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    small = total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31)
    kind = np.int32 if small else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def _first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of every chunk and its length, folded together."""
    lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    lengths = ends - starts
    return (lanes[starts] & MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Chunks:
    """Ids by chunk. ``encode`` gives all ids of new chunks and how many each has, -1 where one is not independent.

    Chunks are known by a 64-bit hash, in an open table of arrays, and by their length and first bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self._empty()

    def _empty(self) -> None:
        self._hashes, self._checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._starts, self._lengths, self._uses = (np.zeros(0, np.int64) for _ in range(3))
        self._ids = np.zeros(0, np.uint32)
        size = 1 << max(4 * CACHE_CHUNKS - 1, 1).bit_length()
        self._keys, self._at = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self._last = np.uint64(size - 1)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash, -1 if unknown, and the table slot where it is or would be."""
        slot = (h & self._last).astype(np.int64)
        number, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        while len(todo):
            at = slot[todo]
            key = self._keys[at]
            hit = key == h[todo]
            number[todo[hit]] = self._at[at[hit]]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) & int(self._last)
        return number, slot

    def _enter(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Put distinct unknown hashes into the table."""
        while len(h):
            _, slot = self._find(h)
            # Of hashes that want the same slot one gets it, the others look on.
            slots, first = np.unique(slot, return_index=True)
            self._keys[slots], self._at[slots] = h[first], numbers[first]
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, numbers = h[rest], numbers[rest]

    def _shrink(self) -> None:
        """Keep the chunks seen again since the last time; none if these are the most."""
        keep = self._uses > 1
        if 2 * keep.sum() > CACHE_CHUNKS or 2 * self._lengths[keep].clip(0).sum() > CACHE_IDS:
            keep[:] = False
        hashes, checks, lengths = self._hashes[keep], self._checks[keep], self._lengths[keep]
        ids = self._ids[gather(self._starts[keep], lengths.clip(0))]
        self._empty()
        self._hashes, self._checks, self._lengths, self._ids = hashes, checks, lengths, ids
        self._starts = np.cumsum(lengths.clip(0)) - lengths.clip(0)
        self._uses = np.zeros(len(hashes), np.int64)
        self._enter(hashes, np.arange(len(hashes), dtype=np.int32))

    def _learn(self, h: np.ndarray, checks: np.ndarray, new: list[bytes]) -> None:
        ids, lengths = self._encode(new)
        size = lengths.clip(0)
        self._enter(h, np.arange(len(self._hashes), len(self._hashes) + len(h), dtype=np.int32))
        self._starts = np.append(self._starts, len(self._ids) + np.cumsum(size) - size)
        self._lengths, self._ids = np.append(self._lengths, lengths), np.append(self._ids, ids.astype(np.uint32))
        self._hashes, self._checks = np.append(self._hashes, h), np.append(self._checks, checks)
        self._uses = np.append(self._uses, np.zeros(len(h), np.int64))

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> tuple:
        """Ids of the chunks of ``n`` texts in a row, the length of each text, and which texts hold a chunk
        that is not independent."""
        if len(self._hashes) > CACHE_CHUNKS or len(self._ids) > CACHE_IDS:
            self._shrink()
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        h = np.maximum(word_hashes(data, starts, ends, 0x3C6EF3), np.uint64(1))
        checks = _first_bytes(padded, starts, ends)
        at, _ = self._find(h)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            first, raw = unknown[first], data.tobytes()
            chunks = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self._learn(new, checks[first], chunks)
            at[unknown], _ = self._find(h[unknown])
        self._uses += np.bincount(at, minlength=len(self._uses))
        lengths = self._lengths[at]
        odd = np.zeros(n, bool)
        odd[rows[(lengths < 0) | (self._checks[at] != checks)]] = True
        lengths = lengths.clip(0)
        total = np.bincount(rows, weights=lengths, minlength=n).astype(np.int64)
        return self._ids[gather(self._starts[at], lengths)], total, odd


def led_chunks(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple:
    """Words with the white space before them, and what is left at the end of each row, in order."""
    before = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    begin = np.where(first, offsets[rows], before)
    last = offsets[:-1].copy()
    last[rows] = ends  # the last word of a row is written last
    tail = np.flatnonzero(last < offsets[1:])
    all_starts, all_ends = np.concatenate([begin, last[tail]]), np.concatenate([ends, offsets[1:][tail]])
    all_rows = np.concatenate([rows, tail])
    order = np.argsort(all_starts, kind="stable")
    return all_starts[order], all_ends[order], all_rows[order]


# White space that is not ASCII; next to ASCII white space it ties two chunks together.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class Library:
    """Whole texts through the tokenizers library, ``add_special_tokens=False``.

    ``led``: chunks take the white space before them with them, for vocabularies that encode it;
    else white space only separates.
    """

    def __init__(self, path: str, led: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._led = led
        self._chunks = Chunks(self._new)
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        # A special token cuts a text in two parts encoded apart, so it can stand between chunks.
        added = sorted(self._tokenizer.get_added_tokens_decoder().items())
        plain = [(i, t.content) for i, t in added if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self._between = plain[0] if plain else None
        self._added = [t.content.encode() for _, t in added]

    def _run(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self._between is None or any(a in b"\0".join(chunks) for a in self._added):
            found = self._run([c.decode("utf-8") for c in chunks])
            lengths = np.array([len(x) for x in found], np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        else:
            cut, name = self._between
            texts = [name.join([c.decode("utf-8") for c in chunks[i : i + _JOINED]]) + name for i in range(0, len(chunks), _JOINED)]
            ids = np.concatenate([np.array(x, np.uint32) for x in self._run(texts)])
            cuts = np.flatnonzero(ids == cut)
            lengths = np.diff(cuts, prepend=-1) - 1
            ids = np.delete(ids, cuts)
        if self._led:
            odd = np.array([not c.isascii() and _ODD.search(c.decode("utf-8")) is not None for c in chunks], bool)
            ids, lengths = ids[np.repeat(~odd, lengths)], np.where(odd, -1, lengths)
        return ids, lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and how many each has."""
        found = words(data, offsets)
        if self._led:
            found = led_chunks(offsets, *found)
        ids, lengths, odd = self._chunks.ids(data, *found, len(offsets) - 1)
        if odd.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array(self._run([data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")])[0], np.uint32)
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths


@lru_cache(maxsize=2)
def library(path: str, led: bool) -> Library:
    """One per worker and vocabulary."""
    return Library(path, led)
