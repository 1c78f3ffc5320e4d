"""Language ID with a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

The kernel of two texts is the number of character 1- to 3-grams present in both, lower-cased,
anything but letters as a space, divided by the root of the two texts' own numbers of
grams. Some labelled texts are landmarks; a text is described by its kernel values with them (grams
that no landmark has cannot change those, so lengths count the landmarks' grams). One ridge
machine per language, against the rest, is fitted in the Nystroem space. Whole texts are
scored by two matrix products per block of rows.

Every letter of the landmarks has a code of its own, and grams are numbers in that base; a letter that no
landmark has cannot be part of a gram they know.

A text is foreign to all learned languages if too few of its 3-grams are known to the landmarks. How
few is taken from the landmarks themselves, each against the others: half way from what nearly all have in
common with the rest to what they have in common with other languages only; a short text is given three
dependent draws' doubled standard error.

The model is fitted on a bounded sample of every language: ``PER_LANG`` labelled texts each, fewer if there are
so many languages that it would exceed ``SAMPLE_ROWS``, chosen by a hash of doc_id; of a text longer than
``MAX_CHARS`` characters a window of as many, at a place that the hash chooses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from graphloom.llm.common import steps, utf8

ORDERS = 3
PER_LANG = 400
MAX_CHARS = 20_000
SAMPLE_ROWS = 25_600
SAMPLE_CHARS = 1 << 26
LANDMARKS = 160
# Landmarks for each language, up to a bound; one at least.
PER_LANDMARK = 4
MOST_LANDMARKS = 1024
RIDGE = 1e-2
# Of the landmarks' shares of known grams, the quantile that stands for texts of their languages.
LOW = 0.01
UNKNOWN = "und"
_ROWS = 256
# Grams are looked up in a table of at most so many numbers, else by binary search.
_TABLE = 1 << 22
# Cells of a dense block.
_CELLS = 1 << 23


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4)
def _codes(alphabet: str) -> np.ndarray:
    """Code of every character: 0 no letter, then the alphabet, then any other letter."""
    place = {c: i + 1 for i, c in enumerate(alphabet)}
    out = np.zeros(0x110000, np.int32)
    for i in np.flatnonzero(_letters()).tolist():
        out[i] = place.get(chr(i).lower()[0], len(alphabet) + 1)
    return out


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the row of each."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, np.repeat(np.arange(len(offsets) - 1), np.diff(before[offsets]))


@lru_cache(maxsize=2)
def _table(grams: bytes, total: int) -> np.ndarray:
    out = np.full(total, -1, np.int32)
    known = np.frombuffer(grams, np.int64)
    out[known] = np.arange(len(known))
    return out


def _places(numbers: np.ndarray, grams: np.ndarray, alphabet: str) -> np.ndarray:
    """Where each number is in the sorted ``grams``; -1 if it is not."""
    total = sum((len(alphabet) + 2) ** k for k in range(1, ORDERS + 1))
    if total <= _TABLE:
        return _table(grams.tobytes(), total)[numbers]
    at = np.minimum(np.searchsorted(grams, numbers), len(grams) - 1)
    return np.where(grams[at] == numbers, at, -1)


@dataclass(frozen=True)
class Landmarks:
    """Alphabet, grams (sorted numbers), one bit per gram and landmark, and the landmarks' numbers of grams."""

    alphabet: str
    grams: np.ndarray
    bits: np.ndarray
    sizes: np.ndarray

    def longest(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of all grams of the highest order that hold a letter; place -1 if not known."""
        row, numbers = found[-1]
        letters = numbers > sum((len(self.alphabet) + 2) ** k for k in range(1, ORDERS))
        return row[letters], _places(numbers[letters], self.grams, self.alphabet)

    def kernel(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Normalised presence kernel of ``n`` texts' grams; a text without known grams is orthogonal to all.

        Only the grams that occur in these texts are unpacked, a block of them at a time.
        """
        rows, places = [], []
        for row, numbers in found:
            place = _places(numbers, self.grams, self.alphabet)
            rows.append(row[place >= 0])
            places.append(place[place >= 0])
        row, place = np.concatenate(rows), np.concatenate(places)
        used = np.zeros(len(self.grams), bool)
        used[place] = True
        columns = np.flatnonzero(used)
        at = (np.cumsum(used) - 1)[place]
        x = np.zeros(n * len(columns), np.float32)
        x[row * len(columns) + at] = 1
        x = x.reshape(n, len(columns))
        out = np.zeros((n, len(self.sizes)), np.float32)
        step = max(1, _CELLS // len(self.sizes))
        for low in range(0, len(columns), step):
            marks = np.unpackbits(self.bits[columns[low : low + step]], axis=1, count=len(self.sizes))
            out += x[:, low : low + step] @ marks.astype(np.float32)
        return out / (np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) * np.sqrt(np.maximum(self.sizes, 1)))


def _columns(texts: list[str], alphabet: str) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = utf8(pa.array(texts, pa.string()))
    return _gram_numbers(*_characters(data, offsets), alphabet)


def landmarks_of(texts: list[str]) -> Landmarks:
    alphabet = "".join(sorted({c.lower()[0] for t in texts for c in set(t) if c.isalpha()}))
    # One text at a time: a pair of numbers for each of its distinct grams.
    each = [np.unique(np.concatenate([numbers for _, numbers in _columns([t], alphabet)])) for t in texts]
    grams = np.unique(np.concatenate(each))
    bits = np.zeros((len(grams), -(-len(texts) // 8)), np.uint8)
    for k, found in enumerate(each):
        bits[np.searchsorted(grams, found), k >> 3] |= np.uint8(128 >> (k & 7))
    return Landmarks(alphabet, grams, bits, np.array([len(x) for x in each], np.float32))


@dataclass(frozen=True)
class Model:
    """Languages, the landmarks, machines, the share of 3-grams known in texts of these languages."""

    langs: list[str]
    landmarks: Landmarks
    weights: np.ndarray
    bias: np.ndarray
    floor: float

    @property
    def rows(self) -> int:
        """Texts to score at a time."""
        return max(1, min(_ROWS, _CELLS // len(self.landmarks.grams)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Machine outputs (row x language), which rows hold a letter, and which are foreign to all languages."""
        points, rows = _characters(data, offsets)
        n = len(offsets) - 1
        found = _gram_numbers(points, rows, self.landmarks.alphabet)
        lettered = np.zeros(n, bool)
        lettered[rows[_letters()[points]]] = True
        row, place = self.landmarks.longest(found)
        total = np.maximum(np.bincount(row, minlength=n), 1)
        known = np.bincount(row[place >= 0], minlength=n)
        slack = 2 * np.sqrt(ORDERS * self.floor * (1 - self.floor) / total)
        foreign = (np.bincount(row, minlength=n) > 0) & (known / total < self.floor - slack)
        return self.landmarks.kernel(found, n) @ self.weights + self.bias, lettered, foreign


def _gram_numbers(points: np.ndarray, rows: np.ndarray, alphabet: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, number) of all grams of each order; numbers of different orders do not meet."""
    size = len(alphabet) + 2
    codes = _codes(alphabet)[points].astype(np.int64)
    out, number, base = [], codes, 0
    for order in range(1, ORDERS + 1):
        if order > 1:
            number = number[:-1] * size + codes[order - 1 :]
        n = len(number)
        inside = rows[:n] == rows[len(rows) - n :]
        out.append((rows[:n][inside], number[inside] + base))
        base += size**order
    return out


def known_share(marks: Landmarks, texts: list[str], langs: list[str]) -> float:
    """The least share of known 3-grams expected of a text in one of the landmarks' languages."""
    places = [marks.longest(_columns([t], marks.alphabet))[1] for t in texts]
    sets = [np.unique(p) for p in places]
    held = np.zeros(len(marks.grams), np.int64)
    for found in sets:
        held[found] += 1
    same, other = [], []
    for lang in set(langs):
        own = np.zeros(len(held), np.int64)
        mine = [k for k, x in enumerate(langs) if x == lang and len(places[k])]
        for k in mine:
            own[sets[k]] += 1
        same += [(held[places[k]] > 1).mean() for k in mine]
        other += [(held[places[k]] > own[places[k]]).mean() for k in mine]
    if not same:
        return 0.0
    low = float(np.quantile(same, LOW))
    return min(low, (low + float(np.median(other))) / 2)


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Model of labelled (text, lang) rows; None if there are none with a letter."""
    rows = sorted({(t, lang) for t, lang in rows if t and lang and any(map(str.isalpha, t))})
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    order = np.random.default_rng(7).permutation(len(rows))
    rows = [rows[i] for i in order]
    picked: list[tuple[str, str]] = []
    by_lang: dict[str, list[tuple[str, str]]] = {lang: [] for lang in langs}
    for row in rows:
        by_lang[row[1]].append(row)
    for k in range(max(map(len, by_lang.values()))):
        picked += [by_lang[lang][k] for lang in langs if k < len(by_lang[lang])]
    picked = picked[: max(landmarks, len(langs), min(PER_LANDMARK * len(langs), MOST_LANDMARKS))]
    chosen = [t for t, _ in picked]
    marks = landmarks_of(chosen)
    floor = known_share(marks, chosen, [lang for _, lang in picked])
    step = max(1, min(_ROWS, _CELLS // len(marks.grams)))

    def described(texts: list[str]) -> np.ndarray:
        parts = [texts[low : low + step] for low in range(0, len(texts), step)]
        return np.vstack([marks.kernel(_columns(part, marks.alphabet), len(part)) for part in parts])

    values, vectors = np.linalg.eigh(described(chosen).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([described([t for t, _ in rows]) @ root, np.ones((len(rows), 1))])
    target = np.where(np.array([lang for _, lang in rows])[:, None] == np.array(langs), 1.0, -1.0)
    gram = phi.T @ phi + ridge * len(rows) / 100 * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, phi.T @ target)
    return Model(langs, marks, (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32), floor)


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Model of a bounded sample of each language's labelled documents outside the held-out quarter."""
    labelled = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // max(languages, 1)))
    # A hash thins each language to a few times the sample before its rows are ranked, however many it has.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # One row per language, as the model has: labelled rows stay where they are.
    drawn = labelled.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(draw * F.col("n").cast("double") <= float(4 * per_lang << 30))
    order = Window.partitionBy("lang").orderBy(draw, "doc_id")
    ranked = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("doc_id").distinct()
    # With many languages windows are shorter, so that what is collected has at most SAMPLE_CHARS characters.
    most = max(1, min(MAX_CHARS, SAMPLE_CHARS // max(per_lang * languages, 1)))
    start = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int")
    window = F.substring("text", start, most).alias("text")
    chosen = labelled.join(F.broadcast(ranked), "doc_id").select(window, "lang")
    return fit([(r["text"], r["lang"]) for r in chosen.collect()])


def _predict(model: Model | None, names: list[str], foreign: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs, scores, strange = [], [], []
            for low, high in steps(offsets, rows=model.rows if model else None):
                if model is None:
                    langs += [UNKNOWN] * (high - low)
                    scores += [0.0] * (high - low)
                    strange += [False] * (high - low)
                    continue
                part = offsets[low : high + 1]
                out, lettered, unknown = model.scores(data[part[0] : part[-1]], part - part[0])
                best = out.argmax(1)
                sure = np.where(lettered, np.clip((out.max(1).astype(np.float64) + 1) / 2, 0, 1), 0.0)
                langs += [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += sure.tolist()
                strange += unknown.tolist()
            out = {name: batch.column(name) for name in names}
            out |= {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.record_batch(out | ({"foreign": pa.array(strange, pa.bool_())} if foreign else {}))

    return run


def identify(docs: DataFrame, model: Model | None = None, foreign: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, lang, any others) with held_out, lang_pred and score.

    lang_pred is the language whose machine answers highest, of ties the first by name; score
    its answer, -1 to 1, moved to 0 to 1: below 0.5 no machine claims the text. Null,
    empty and letterless texts are ``und`` with score 0, as is everything if no labelled row can be
    learned from. ``foreign`` adds a column of that name: whether the text is in none of the
    learned languages, by the share of its 3-grams that the landmarks know. Only text is looked at. Columns of these three names are replaced;
    repeated rows are judged each; an empty table gives an empty one.
    """
    model = train(docs) if model is None else model
    docs = docs.drop("held_out", "lang_pred", "score", *["foreign"] * foreign).withColumn("held_out", held_out(F.col("doc_id")))
    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        *[T.StructField("foreign", T.BooleanType())] * foreign])
    return docs.mapInArrow(_predict(model, docs.columns, foreign), schema)
