"""BPE encoding by speculation and verification, and decoding.

A word's tokens are proposed by greedy longest match in the vocabulary, all new words of a
block at once along a trie. A sequence of tokens is what merging would give exactly if each
neighbouring pair is: taking a pair's merges back, latest first, no merge across the seam may
have come before the merge taken back. All pairs of the block are tested at once. Only
words with a failing pair are merged step by step.

The vocabulary file is the tokenizers library's, with byte-level symbols, a word-end suffix
and merges in the order of their ids; normalising and cutting text into words is the library's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from graphloom.llm.chunks import Chunks
from graphloom.llm.common import steps, utf8, words

_FAR = 1 << 40
CACHE_WORDS = 200_000
# Words of ASCII text, as the file's pattern cuts them.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._suffix = model["end_of_word_suffix"] or ""
        if not self._suffix or spec["decoder"] is not None:
            raise ValueError("a vocabulary with a word-end suffix and no decoder is needed")
        vocab: dict[str, int] = model["vocab"]
        self._bytes = byte_symbols()
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self._special.items()}
        self._names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self._vocab = vocab
        self.rank: dict[tuple[int, int], int] = {}
        self._left = np.arange(len(self._names))
        self._right = np.arange(len(self._names))
        for a, b in model["merges"]:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = whole
            self._left[whole], self._right[whole] = left, right
        self._halves = {whole: pair for pair, whole in self.rank.items()}
        symbol = {b: c for c, b in self._bytes.items()}
        self._alone = [vocab[symbol[b]] for b in range(256)]
        self._last = [vocab[symbol[b] + self._suffix] for b in range(256)]
        order = [vocab[a + b] for a, b in model["merges"]]
        if order != sorted(order) or len(set(order)) != len(order):
            raise ValueError("merges are not in the order of their ids")
        pairs = sorted(self.rank.items())
        self._pairs = np.array([a << 32 | b for (a, b), _ in pairs], np.int64)
        self._made = np.array([whole for _, whole in pairs], np.int64)
        self._grow_trie()
        self._words: dict[bytes, list[int]] = {}
        self._chunks = Chunks(self._new)

    # --- proposing ----------------------------------------------------------

    def _grow_trie(self) -> None:
        """Edges (node, byte) to node, and each node's token inside and at the end of a word."""
        edges: dict[tuple[int, int], int] = {}
        inside, ending = [-1], [-1]
        for name, i in self._vocab.items():
            last = name.endswith(self._suffix) and len(name) > len(self._suffix)
            node = 0
            for c in name[: -len(self._suffix)] if last else name:
                node = edges.setdefault((node, self._bytes[c]), len(inside))
                if node == len(inside):
                    inside.append(-1)
                    ending.append(-1)
            (ending if last else inside)[node] = i
        keys = sorted(edges)
        self._edges = np.array([n << 8 | b for n, b in keys], np.int64)
        self._nodes = np.array([edges[k] for k in keys], np.int64)
        self._inside, self._ending = np.array(inside), np.array(ending)

    def _propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest matches, words in order, tokens in order."""
        at, words, tokens = starts.copy(), [], []
        todo = np.flatnonzero(at < ends)
        while len(todo):
            node, token, size = np.zeros(len(todo), np.int64), np.full(len(todo), -1), np.zeros(len(todo), np.int64)
            live, depth = np.arange(len(todo)), 0
            while len(live):
                key = node[live] << 8 | data[at[todo[live]] + depth]
                edge = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
                hit = self._edges[edge] == key
                live, node_at = live[hit], self._nodes[edge[hit]]
                node[live] = node_at
                depth += 1
                done = at[todo[live]] + depth == ends[todo[live]]
                here = np.where(done, self._ending[node_at], self._inside[node_at])
                some = here >= 0
                token[live[some]], size[live[some]] = here[some], depth
                live = live[~done]
            words.append(todo)
            tokens.append(token)
            at[todo] += size
            todo = todo[at[todo] < ends[todo]]
        words, tokens = np.concatenate([*words, np.zeros(0, np.int64)]), np.concatenate([*tokens, np.zeros(0, np.int64)])
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    # --- verifying ----------------------------------------------------------

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left + right ends in exactly these two tokens, for many pairs."""
        out = np.ones(len(left), bool)
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), _FAR)
        todo = np.arange(len(left))
        while len(todo):
            a, b = left[todo], right[todo]
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            across = np.where(self._pairs[place] == key, self._made[place], _FAR)
            bad = across < limit[todo]
            out[todo[bad]] = False
            # Take the later merge back; of equal ones the right one came later.
            can_a, can_b = self._left[a] != a, self._left[b] != b
            take_a = can_a & (~can_b | (a > b))
            limit[todo] = np.where(take_a, a, b + 1)
            left[todo] = np.where(take_a, self._right[a], a)
            right[todo] = np.where(~take_a & can_b, self._left[b], b)
            todo = todo[~bad & (can_a | can_b)]
        return out

    # --- exact merging ------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, merge by merge."""
        ids = [*map(self._alone.__getitem__, word[:-1]), self._last[word[-1]]]
        rank, none = self.rank.get, repeat(_FAR)
        while len(ids) > 1:
            best = min(map(rank, zip(ids, ids[1:], strict=False), none))
            if best == _FAR:
                break
            (a, b), out, i = self._halves[best], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(best)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        of, tokens = self._propose(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), ends - lengths, ends)
        seam = of[1:] == of[:-1]
        failed = np.zeros(len(words), bool)
        at = np.flatnonzero(seam)
        failed[of[at[~self.compatible(tokens[at], tokens[at + 1])]]] = True
        bounds = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        tokens = tokens.tolist()
        out = [tokens[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(failed).tolist():
            out[i] = self.merge(words[i])
        return out

    # --- texts ----------------------------------------------------------------

    def _cut_words(self, text: str) -> list[bytes]:
        if text.isascii():
            return [w.encode() for w in _ASCII_WORDS.findall(text.lower())]
        text = self._library.normalizer.normalize_str(text)
        return [bytes(self._bytes[c] for c in w) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cut: list[list[bytes | int]] = []
        for chunk in chunks:
            parts = self._cut.split(chunk.decode("utf-8"))
            found: list[bytes | int] = []
            for i, part in enumerate(parts):
                found += [self._special[part]] if i % 2 else self._cut_words(part)
            cut.append(found)
        if len(self._words) > CACHE_WORDS:
            self._words = {}
        known = self._words
        new = sorted({w for found in cut for w in found if not isinstance(w, int) and w not in known})
        known.update(zip(new, self.words(new), strict=True))
        ids: list[int] = []
        ends = []
        for found in cut:
            for w in found:
                ids += [w] if isinstance(w, int) else known[w]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends, prepend=0)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and how many each has."""
        ids, lengths, odd = self._chunks.ids(data, *words(data, offsets), len(offsets) - 1)
        if odd.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i], _ = self._new(data[offsets[i] : offsets[i + 1]].tobytes().split())
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids: without a decoder, their names with a space between."""
        return b" ".join(map(self._names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    """One per worker and vocabulary."""
    return Bpe(path)


def _encode(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in steps(offsets):
                part = offsets[low : high + 1]
                ids, lengths = bpe.encode(data[part[0] : part[-1]], part - part[0])
                parts = np.split(ids, np.cumsum(lengths)[:-1])
                out = {name: batch.column(name).slice(low, high - low) for name in names}
                yield pa.record_batch(out | {
                    "ids": pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids.astype(np.int32))),
                    "decoded": pa.array([bpe.decode(p) for p in parts], pa.binary()).cast(pa.string()),
                })

    return run


def _digests(path: str):
    encoded = _encode(path, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoded(batches):
            ids = batch.column("ids")
            bounds = np.asarray(ids.offsets).tolist()
            flat = np.asarray(ids.values).astype("<u4")
            texts, offsets = utf8(batch.column("decoded"))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "ids_sha256": [sha256(flat[s:e]).hexdigest() for s, e in pairwise(bounds)],
                "decoded_sha256": [sha256(texts[s:e]).hexdigest() for s, e in pairwise(offsets.tolist())],
            })

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (text string, any others) with ``ids`` (array of int) and ``decoded``, the text of these ids.

    As the tokenizers library encodes with the file at ``path``, no special tokens added;
    those that stand in a text are matched as the library does. Null and empty texts have
    no ids and decode to the empty text. Columns of these two names are replaced; repeated
    rows are encoded each; an empty table gives an empty one.
    """
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([
        *docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(_encode(path, docs.columns), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` gives, taken where it is made."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(_digests(path), schema)
