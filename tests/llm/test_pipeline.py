"""The pipeline against brute-force versions of its stages, each on what the stage before it kept."""

import os
import re

import pytest

import corpus_pipeline
from attesta.llm import quality, secrets
from attesta.llm.queries import ORACLE_SQL, QUERIES

from . import helpers as brute
from .test_similar import kept as similar_kept

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            got = {r.doc_id: r.text for r in docs.collect()}
        if i == 0:
            assert got == {k: t for k, t in rows.items() if quality.measure(t)[6]}
            assert all(not brute.quality(t)[5] for t in got.values())
        elif i == 1:
            assert sorted(got) == similar_kept(sorted(rows.items()))
        elif i == 2:
            want = {k: kept.decode("utf-8", "ignore") for k, (*_, kept) in zip(rows, brute.repeats(list(rows.values())), strict=True)}
            assert got == want
        elif i == 3:
            live = {k for k, t in rows.items() if brute.base_spans(t)}
            assert set(got) == set(rows) and all((got[k] == rows[k]) or "[SECRET]" in got[k] for k in rows)
            assert all(not re.search(r"AKIA[A-Z0-9]{16,}", got[k]) for k in live)
        if i < 4:
            rows = got
    assert docs.groupBy("doc_id").count().count() == len(rows)
    assert secrets.EXAMPLE_OWNERS > 1


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
