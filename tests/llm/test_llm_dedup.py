"""SimHash near-dedup and substring dedup against brute force."""

from collections import defaultdict
from itertools import combinations
from random import Random

import numpy as np
import pytest
import xxhash

from graphloom.llm import jaccard, repeats, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            group[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)] += [d] if d is not None else []
    return sorted(
        ((d, f"{p:016x}", min(least[top(i)], default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def plain_repeats(rows, n=13):
    first = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - n + 1):
            if d is not None:
                first[tuple(w[i : i + n])] = min(d, first.get(tuple(w[i : i + n]), d))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_groups_cover_every_three_bytes():
    assert len(simhash.GROUPS) == 14
    for three in combinations(range(8), 3):
        assert any(not set(three) & set(g) for g in simhash.GROUPS)


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    got = sorted(map(tuple, simhash.near_duplicates(documents).collect()), key=repr)
    assert got == plain_components([(d, t) for d, t, _ in odd_rows])


def test_no_link_is_lost(spark):
    """Fingerprints a few flipped bits apart, all in one chain of groups."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    near = {b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 3, 4, 5)}
    prints = sorted(near | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {frozenset(map(int, r)) for r in simhash.links(nodes).collect()}
    want = {frozenset((signed[i], signed[j])) for i, j in combinations(range(len(prints)), 2)
            if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want and simhash.links(nodes).count() == len(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "low long, high long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_remove_repeats_of_odd_rows(documents, odd_rows):
    found = repeats.remove_repeats(documents)
    assert found.columns == [*[c for c in documents.columns if c not in ("n_words", "kept")], "n_words", "n_removed", "kept"]
    got = sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    assert got == plain_repeats([(d, t) for d, t, _ in odd_rows])


def test_remove_repeats_where_paths_branch(spark):
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(30)]
    texts, pool = [], []
    for d in range(60):
        text = list(rng.choice(words, int(rng.integers(0, 60))))
        for _ in range(int(rng.integers(0, 4))):
            if pool and rng.random() < 0.8:
                source = pool[int(rng.integers(len(pool)))]
                at = int(rng.integers(0, max(len(source) - 5, 1)))
                text += source[at : at + int(rng.integers(5, 40))]
        pool.append(text)
        texts.append((int(rng.permutation(1000)[d % 1000]), " ".join(text)))
    texts += [(2000 + i, "again " * n) for i, n in enumerate((5, 13, 14, 40, 200))]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, repeats.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)
    assert got == plain_repeats(texts)


@pytest.mark.parametrize("window, gram", [(13, 6), (5, 3), (8, 8)])
def test_remove_repeats_on_documents(spark, window, gram):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = repeats.remove_repeats(docs, window, gram).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, found.collect()), key=repr) == plain_repeats(rows, window)


def plain_similar(rows):
    """(doc_id, smallest doc_id of its component): five-word shingles, Jaccard similarity of 0.8 or more."""
    cut = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in cut]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, least[top(i)]) for i, (d, _) in enumerate(rows))


def test_similar_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_similar(rows)
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == want
    # Near copies that the fingerprints of op5 leave apart.
    assert {d for d, c in want if d != c} > {d for d, _, c in plain_components(rows) if d != c}


def test_similar_odd_rows(documents, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows if d is not None]
    assert sorted(map(tuple, jaccard.near_duplicates(documents).collect())) == plain_similar(rows)


@pytest.mark.parametrize("sample", [0, 2048])
def test_similar_edited_copies(spark, sample):
    """Copies of copies with more and more words changed, a passage that all share, texts of a few words."""
    rng = np.random.default_rng(5)
    shared = [f"line{i}" for i in range(30)]
    texts = []
    for base in range(12):
        text = [f"b{base}w{i}" for i in range(int(rng.integers(3, 120)))]
        for n in range(8):
            text = [w if rng.random() > 0.01 * n else f"{w}x{n}" for w in text]
            texts.append(" ".join(text + (shared if base % 2 else [])))
    rows = [(int(d), t) for d, t in zip(rng.permutation(1000), texts, strict=False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.near_duplicates(frame, sample=sample).collect())) == plain_similar(rows)


def test_similar_by_fingerprint(spark, monkeypatch):
    """Near fingerprints are met through their index and checked on the sets: it gives no dissimilar pair and decides nothing alone."""
    rng = Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(w if k != 7 * i else "x" for k, w in enumerate(base))) for i in range(1, 9)]
    rows += [(100 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    met, join = [], jaccard._by_fingerprint
    monkeypatch.setattr(jaccard, "_by_fingerprint", lambda texts: met.append(join(texts)) or met[0])
    monkeypatch.setattr(jaccard, "discard", lambda *_: None)
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect())) == plain_similar(rows)
    assert met[0].count() > 0


def test_pairs_of_a_list_come_once(spark, monkeypatch):
    """Texts that share much and are not alike: each pair is a candidate once, however many members they share."""
    rng = Random(5)
    rows = []
    for i in range(12):
        base = [f"w{k}" for k in range(1000)]
        for k in rng.sample(range(0, 1000, 5), 15):
            base[k] = f"x{i}_{k}"
        rows.append((i, " ".join(base)))
    asked, settled = [], jaccard._settled
    monkeypatch.setattr(jaccard, "_settled", lambda pairs, *rest: asked.append((pairs.count(), pairs.distinct().count())) or settled(pairs, *rest))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(frame).collect())) == plain_similar(rows)
    assert asked[-1][0] == asked[-1][1] > 0


def test_no_similar_documents(no_documents):
    assert jaccard.near_duplicates(no_documents).collect() == []


def test_empty_tables(no_documents):
    assert simhash.near_duplicates(no_documents).collect() == []
    assert repeats.remove_repeats(no_documents).collect() == []


def test_sketches_drop_only_what_is_apart():
    """Pairs of sets of many sizes: none that is 4/5 alike is dropped, few of those far apart stay."""
    rng = np.random.default_rng(3)
    stay = far = 0
    for size in [0, 1, 2, 5, 40, 300, 2000, 20_000]:
        for share in [0.0, 0.3, 0.6, 0.7, 0.78, 0.8, 0.82, 0.9, 1.0]:
            for other in {size, int(size * 0.85), int(size * 1.2)}:
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 63, max(other - int(len(a) * share), 0)).astype(np.uint64)]))
                kept = jaccard.possible(jaccard.sketch(a), jaccard.sketch(b), len(a) + len(b))
                assert kept or not jaccard.similar(a, b)
                if size >= 300 and len(np.intersect1d(a, b)) < 0.65 * len(np.union1d(a, b)):
                    far, stay = far + 1, stay + kept
    assert far > 20 and stay == 0
