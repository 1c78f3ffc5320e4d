"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import re
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_dedup import plain_repeats
from test_llm_text import plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import language
from graphloom.llm.common import stage
from graphloom.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def inputs(spark):
    """The documents, with rows no stage may stumble over, and what each stage made of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456", "en", "s", 7), (None, "no id, but letters", "en", "s", 18)],
        docs.schema)
    frames = [stage(docs.union(odd))]
    for _, step in corpus_pipeline.STAGES:
        frames.append(stage(step(spark, frames[-1], SF)))
    return frames


def test_names_and_columns(inputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_removal", "packed"]
    assert all(f.columns == COLUMNS for f in inputs[1:-1])


def test_language_id(inputs):
    """Kept are the texts that have a letter and are not foreign to all languages, marked with their language."""
    found = language.identify(inputs[0], language.train(inputs[0]), foreign=True)
    want = found.where((F.col("lang_pred") != "und") & ~F.col("foreign")).withColumn("lang", F.col("lang_pred"))
    assert rows_of(inputs[1]) == rows_of(want)
    texts = [t for _, t, *_ in rows_of(inputs[1])]
    assert all(any(map(str.isalpha, t)) for t in texts)
    lettered = sum(any(map(str.isalpha, t or "")) for _, t, *_ in rows_of(inputs[0]))
    assert len(texts) >= 0.99 * lettered


def test_foreign_texts_go(spark):
    """Planted texts of unlearned languages and gibberish go, short clean ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS)
    foreign = [
        "Tämä on suomenkielinen teksti, joka kertoo talvesta ja lumesta pohjoisessa kylässä.",
        "W Polsce zima jest bardzo mroźna, a dzieci chętnie bawią się na śniegu przez cały dzień.",
        "Это русский текст о зиме и снеге.", "qxzv kjwq zzxk vbnq xkcd pqzt wvxz", "asdf qwer zxcv hjkl uiop"]
    clean = [r["text"] for r in docs.where(language.held_out(F.col("doc_id"))).collect() if any(map(str.isalpha, r["text"] or ""))]
    clean += [" ".join(t.split()[:n]) for t in clean for n in (3, 8) if sum(map(str.isalpha, t[:30])) > 20]
    rows = [(10**6 + i, t, None, "planted", len(t)) for i, t in enumerate(foreign + clean)]
    found = corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF)
    kept = {r["doc_id"] - 10**6 for r in found.where("source = 'planted'").collect()}
    assert not kept & set(range(len(foreign)))
    assert len(kept) >= 0.995 * len(clean) and len(clean) > 500


def plain_one_of_each(rows):
    """Rows that stay, by the five-word Jaccard similarity of all pairs of rows."""
    sets = []
    for row in rows:
        words = (row[1] or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if None not in (rows[i][0], rows[j][0]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            group[top(j)] = top(i)
    first = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            first.setdefault(top(i), []).append(row[0])
    return [(None if row[0] is None else top(i), row, row[0] is None or row[0] == min(first[top(i)])) for i, row in enumerate(rows)]


def test_near_dedup(inputs):
    rows = rows_of(inputs[1])
    assert rows_of(inputs[2]) == [row for _, row, stays in plain_one_of_each(rows) if stays]


def test_near_dedup_judges_rows(spark):
    """Repeated ids with several texts, repeated rows: one row of every component stays, no text goes for another's sake."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(9, a), (10, a), (10, b), (11, a), (12, b + " more"), (12, b + " more"), (13, ""), (14, None), (14, None), (None, a), (None, a), (15, "lone")]
    rows = [(d, t, "en", "s", i) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = corpus_pipeline.near_dedup(spark, stage(spark.createDataFrame(rows, schema)), SF)
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted([(9, a), (10, b), (13, ""), (None, a), (None, a), (15, "lone")], key=repr)
    again = stage(spark.createDataFrame([(5, a, "en", "s", 1)] * 4 + [(5, a + " z", "en", "s", 1)] * 3 + [(7, a, "en", "s", 1)], schema))
    assert corpus_pipeline.near_dedup(spark, again, SF).count() == 1


def test_near_dedup_of_a_common_line(spark):
    """One line in most documents, a large group of near copies, a large group of copies."""
    rng = np.random.default_rng(8)
    line = " ".join(f"common{i}" for i in range(15))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 12)) + " " + line) for i in range(150)]
    base = [f"near{i}" for i in range(60)]
    for i in range(80):
        rows.append((1000 + i, " ".join(w if k != i % 60 else f"x{i}" for k, w in enumerate(base))))
    rows += [(2000 + i, "copy of one text that many have") for i in range(100)]
    rows = [(d, t, "en", "s", 1) for d, t in rows]
    got = corpus_pipeline.near_dedup(spark, stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), SF)
    assert sorted(r[0] for r in got.collect()) == sorted(row[0] for _, row, stays in plain_one_of_each(rows) if stays)


def test_substring_dedup(inputs):
    rows = rows_of(inputs[2])
    plain = {d: (removed, kept) for d, _, removed, kept in plain_repeats([r[:2] for r in rows])}
    want = [(d, plain[d][1], lang, source, len(plain[d][1])) if plain[d][0] else (d, t, lang, source, n) for d, t, lang, source, n in rows]
    assert rows_of(inputs[3]) == sorted(want, key=repr)


def test_secret_removal(inputs):
    before, after = ({r[0]: r for r in rows_of(f)} for f in inputs[3:5])
    assert before.keys() == after.keys()
    for d, row in before.items():
        spans, text, out, at = plain_spans(row[1]), row[1], "", 0
        for s in spans:
            start, end = map(int, s.split(":")[1:])
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        out += text[at:]
        if "[SECRET]" not in re.sub(r"\[SECRET\]", "", after[d][1], count=out.count("[SECRET]")):
            assert after[d][1] == out
        assert after[d][4] == (len(out) if spans else row[4])


def test_packed(inputs):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = inputs[5].collect()
    held = {}
    for r in rows:
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for d, text, *_ in rows_of(inputs[4]):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(held[d])
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    ends = {}
    for sequence, offset, length in spans:
        assert ends.get(sequence, 0) == offset and offset + length <= 2048
        ends[sequence] = offset + length


def test_run(spark, inputs):
    assert corpus_pipeline.run(spark, SF).columns == inputs[5].columns
