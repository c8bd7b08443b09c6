"""Quality rules with repetition coverage.

Words and lines of a text are hashed; rolling hashes of several n-gram lengths, worked out in numpy, tell which
characters lie inside duplicated n-grams, and duplicated lines are measured the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = b"#*$%&|<>"
#: Largest kept share of word characters inside n-grams that occur twice or more, by n.
NGRAM_LIMITS = ((5, 0.25), (8, 0.20), (13, 0.20))
#: Largest kept share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"dup_chars_{n} long" for n, _ in NGRAM_LIMITS) + ", dup_line_chars long"


def repeated(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more, its first occurrence included."""
    words = len(hashes)
    covered = np.zeros(words, dtype=bool)
    if words <= n:
        return covered
    rolling = np.zeros(words - n + 1, dtype=np.uint64)
    for i in range(n):
        rolling = rolling * BASE + hashes[i : words - n + 1 + i]
    order = np.argsort(rolling, kind="stable")
    same = rolling[order[1:]] == rolling[order[:-1]]
    if not same.any():
        return covered
    starts = np.zeros(words + 1, dtype=np.int64)
    for at in (order[1:][same], order[:-1][same]):
        hit = np.zeros(words - n + 1, dtype=bool)
        hit[at] = True
        starts[: words - n + 1] |= hit
    edges = np.zeros(words + n + 1, dtype=np.int64)
    edges[:words] += starts[:words]
    edges[n : n + words] -= starts[:words]
    return np.cumsum(edges)[:words] > 0


def measure(text: str | None) -> tuple:
    """Base figures and repetition coverage of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space: \x20 and \x09-\x0D
    n_words = len(words)
    letters = len(text or "") - sum(raw.count(c) for c in b"\x20\x09\x0a\x0b\x0c\x0d")
    symbols = sum(raw.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w) for w in line.split())
            else:
                seen.add(line)
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n_words).view(np.uint64)
    repeat_words = 0
    dup_chars = [0] * len(NGRAM_LIMITS)
    if n_words > 5 and (covered := repeated(hashes, 5)).any():
        repeat_words = int(covered.sum())
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
        dup_chars = [int(sizes[covered if n == 5 else repeated(hashes, n)].sum()) for n, _ in NGRAM_LIMITS]
    failed = n_words < 10 or 100 * repeat_words > 20 * n_words
    total = sum(map(len, words))
    kept = not failed and dup_line_chars <= LINE_LIMIT * total and all(c <= limit * total for c, (_, limit) in zip(dup_chars, NGRAM_LIMITS, strict=True))
    return (n_words, letters, symbols, dup_lines, repeat_words, failed, kept, *dup_chars, dup_line_chars)


def quality(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """SCHEMA, one row for each row of ``df``; dup_* count UTF-8 bytes of words.

    A null text has no words and fails the base rules; so does a text of white space. Repeated rows give repeated
    rows; a null key stays null; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            if b.num_rows:
                columns = zip(*[measure(t) for t in b.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c) for c in columns)], names=names)

    return df.select(df[key].alias("doc_id"), df[text].alias("text")).mapInArrow(task, SCHEMA)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose texts the rules keep, with all their columns as they are."""
    at = df.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([measure(t)[6] for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(task, df.schema)
