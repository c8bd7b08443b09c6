"""The pipeline's near-dedup against brute force on sets of five-word shingles."""

import os
import random
from itertools import combinations

import pytest

import corpus_pipeline
from attesta.llm import simhash
from attesta.operators import overlap

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """Keys of the first row of each group linked by Jaccard 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or 10 * len(a & b) >= 8 * len(a | b) > 0:
            x, y = label[i], label[j]
            label = [min(x, y) if g in (x, y) else g for g in label]
    return sorted(min(k for (k, _), h in zip(rows, label, strict=True) if h == g) for g in set(label))


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10**9)}"
    return " ".join(words)


def corpus():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 260))] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [edited(rnd, b, n) for b in base for n in (0, 1, 2, 3, 4, 6)]
    texts += [edited(rnd, base[0], rnd.randrange(1, 5)) for _ in range(60)] + ["the same first line of all pages " + " ".join(rnd.choice(vocabulary) for _ in range(40)) for _ in range(60)]
    texts += [None, "", " \n", "one two", "One  Two", "a b c d", "a b c d e", "a b c d e f", " ".join(base[1] * 3), texts[1].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent, common, listed, rounds", [(50_000, 32, 200_000, 2), (3, 1, 0, 0), (3, 1, 200_000, 1)])
def test_groups(spark, monkeypatch, frequent, common, listed, rounds):
    monkeypatch.setattr(overlap, "LISTED", listed)
    monkeypatch.setattr(overlap, "FREQUENT", frequent)
    monkeypatch.setattr(overlap, "COMMON", common)
    monkeypatch.setattr(overlap, "ROUNDS", rounds)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_rows_of_one_key(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "A b c d e f"), (None, "g h i j k l")]
    got = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(map(str, got.collect())) == sorted(map(str, [spark.createDataFrame(rows[1:2], "doc_id long, text string").first(), spark.createDataFrame(rows[3:], "doc_id long, text string").first()]))
    assert simhash.drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_table(spark):
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == kept(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
@pytest.mark.parametrize("held", [2, 100])
def test_runs(monkeypatch, size, held):
    import pyarrow as pa

    monkeypatch.setattr(overlap, "HELD", held)
    h = [1, 2, 2, 3, 4, 4, 4, 4, 4, 5, 6, 6, 7, 7, *[8] * 12, 9]
    n = [10] * len(h)
    n[-2 - 12] = 99  # the second 7 is too large for the first
    batches = [pa.record_batch({"h": h[i : i + size], "id": list(range(i, min(i + size, len(h)))), "n": n[i : i + size], "p": [0] * len(h[i : i + size])}) for i in range(0, len(h), size)]
    got = [x for b in overlap.runs(iter(batches), 0.8) for x in b.column("id").to_pylist()]
    assert got == [i for i, x in enumerate(h) if h.count(x) > 1 and x != 7]


def test_sketch_bound():
    """Sketches never differ in more bits than the sets in elements."""
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 900, rng.integers(0, 400)) * 0x9E3779B97F4A7C1) for _ in range(40)]
    made = overlap.sketch(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i, j in combinations(range(len(sets)), 2):
        assert np.bitwise_count(made[i].view(np.uint64) ^ made[j].view(np.uint64)).sum() <= len(np.setxor1d(sets[i], sets[j]))
    assert (made[0] == overlap.sketch(sets[0], np.array([len(sets[0])]))).all()
