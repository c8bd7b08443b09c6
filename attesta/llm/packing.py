"""Hierarchical multi-length packing.

Documents are routed by token count to tiers of window sizes. The longest tier is packed first; what
a window has left is filled from shorter documents (whole ones first, then the head of one that
is cut). Windows come out full, so padding is left only in each task's last window. Windows go to step
groups of equal token budgets, those of one tier together; windows that are left when a task ends fill no group of their tier, so they are
dealt, largest first, to the least filled of as few groups as hold them.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Encoded, WordEncoder, as_letters, one_by_one, slices

#: Window sizes in tokens, powers of two; the largest is the model's context.
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group: so many of every tier's windows make one.
STEP_TOKENS = 16_384
#: Tokens that a task holds before it packs them; bounds memory.
POOL_TOKENS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens long, step_group long"

_LOADED: dict[str, tuple[WordEncoder, dict[str, int]]] = {}


def loaded(path: str) -> tuple[WordEncoder, dict[str, int]]:
    """The library's model, called once for each distinct pre-split word that a worker's cache lacks, and the special tokens."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        model = t.model
        _LOADED[path] = one_by_one(lambda w: [x.id for x in model.tokenize(as_letters(w))]), {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    return _LOADED[path]


class Packer:
    """Pool of pieces by length; ``windows`` takes full windows from it. A piece is (doc, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.top = tiers, tiers[-1]
        self.by_length: list[deque] = [deque() for _ in range(self.top + 1)]
        self.mask, self.tokens = 0, 0

    def put(self, piece: tuple[int, int, int]) -> None:
        n = piece[2]
        self.by_length[n].append(piece)
        self.mask |= 1 << n
        self.tokens += n

    def take(self, n: int) -> tuple[int, int, int]:
        queue = self.by_length[n]
        piece = queue.popleft()
        if not queue:
            self.mask &= ~(1 << n)
        self.tokens -= n
        return piece

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list]]:
        """Route a document; full windows of one that is longer than the context come out at once."""
        start = 0
        while n - start >= self.top:
            yield self.top, [(doc, start, self.top)]
            start += self.top
        if n > start:
            self.put((doc, start, n - start))

    def window(self, size: int) -> list:
        """A full window; the pool must hold ``size`` tokens."""
        out, gap = [], size
        while gap:
            fitting = self.mask & ((1 << (gap + 1)) - 1)
            if fitting:
                piece = self.take(fitting.bit_length() - 1)
            else:
                above = self.mask >> (gap + 1)
                doc, start, n = self.take(gap + (above & -above).bit_length())
                self.put((doc, start + gap, n - gap))
                piece = (doc, start, gap)
            out.append(piece)
            gap -= piece[2]
        return out

    def longest(self) -> int:
        return self.mask.bit_length() - 1

    def windows(self, last: bool) -> Iterator[tuple[int, list]]:
        """Pack the tiers from the longest down: a tier's windows as long as documents routed to it remain.
        ``last``: also what is left at the end, in windows of falling size and one that isn't full."""
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while self.longest() > below and self.tokens >= tier:
                yield tier, self.window(tier)
        while last and self.tokens:
            size = next((t for t in self.tiers[::-1] if t <= self.tokens), self.tokens)
            yield next(t for t in self.tiers if t >= size), self.window(size)


def even_groups(windows: list, step_tokens: int) -> list[list]:
    """Windows (size, ...), largest first, in as few groups of ``step_tokens`` as hold them, each to the least filled one. Sizes are powers of two
    that divide ``step_tokens``, so no group overflows and two differ by the largest window at most."""
    heap = [(0, g, []) for g in range(-(-sum(w[0] for w in windows) // step_tokens))]
    for w in windows:
        load, g, mine = heap[0]
        mine.append(w)
        heapq.heapreplace(heap, (load + w[0], g, mine))
    return [mine for _, _, mine in heap]


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each piece of a document's ids (SCHEMA).

    Each task packs its own partition, without a shuffle. A null or empty text is the one id ``end_id``. Repeated rows are packed as often as they stand;
    a null key stays null; an empty table gives no rows; other columns are not read. A very long text is encoded whole, by itself, and cut into full windows. ``tier`` is the window size, ``sequence_tokens`` its
    ids without padding, ``step_group`` numbers groups of windows that hold at most ``step_tokens`` ids: full groups of one tier, and what is left
    of a task's in groups as even as can be.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (encoder, special), base = loaded(path), TaskContext.get().partitionId() << 33
        packer = Packer(tiers)
        docs: dict[int, list] = {}  # doc -> [key, ids, tokens not yet placed]
        count = 0
        open_group: dict[int, list] = {}  # tier -> windows that wait for a full group
        groups = 0
        rows: list[tuple] = []

        def close(windows: list) -> None:
            nonlocal groups
            rows.extend((*piece, base + groups) for _, pieces in windows for piece in pieces)
            groups += 1

        def place(tier: int, pieces: list) -> None:
            nonlocal count
            total, offset, made = sum(p[2] for p in pieces), 0, []
            for doc, start, n in pieces:
                held = docs[doc]
                made.append((held[0], start, n, zlib.crc32(held[1][start : start + n]), len(held[1]), base + count, offset, tier, total))
                offset += n
                held[2] -= n
                if not held[2]:
                    del docs[doc]
            count += 1
            waiting = open_group.setdefault(tier, [])
            waiting.append((tier, made))
            if len(waiting) * tier >= step_tokens:
                close(open_group.pop(tier))

        def settle() -> None:
            for windows in even_groups([w for tier in tiers[::-1] for w in open_group.get(tier, [])], step_tokens):
                close(windows)

        def out() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
            rows.clear()
            return made

        number = 0
        for b in batches:
            for lo, hi in slices(b.column(1)):
                e = Encoded(b.column(1).slice(lo, hi - lo), encoder, special)
                for i, k in enumerate(b.column(0).slice(lo, hi - lo).to_pylist()):
                    ids = np.append(e.ids[e.offsets[i] : e.offsets[i + 1]], np.array(end_id, dtype="<u4"))
                    docs[number] = [k, ids, len(ids)]
                    for w in packer.add(number, len(ids)):
                        place(*w)
                    number += 1
                    if packer.tokens >= pool_tokens:
                        for w in packer.windows(False):
                            place(*w)
                if len(rows) >= 20_000:
                    yield out()
        for w in packer.windows(True):
            place(*w)
        settle()
        if rows:
            yield out()

    return df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(task, SCHEMA)
