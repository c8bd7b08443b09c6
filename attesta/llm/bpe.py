"""BPE encoding and decoding by an automaton that is compiled merge by merge.

The automaton reads tokens (*arcs*). It starts with one state, in which every single symbol leads back to that state, and applies one
gadget for each merge ``u v -> w`` in order of rank. Where arc ``u`` leads to is one and the same state from wherever it is taken, so a gadget

* copies the state that ``u`` leads to, takes the arc ``v`` out of the copy, and lets ``u`` lead to the copy from then on;
* adds the arc ``w`` to every state that has ``u``; it leads to where ``v`` leads at that rank.

The result accepts the one tokenisation of each word and nothing else. Its table has a row for each state and a column for each arc, some 2.4e9 cells for a
vocabulary of 49k, and is kept compressed as the gadgets make it: a row is the row it was copied from but for one cell; a column is the column of ``u`` for all older states.
``MergeAutomaton.allowed`` reads a cell by going back through these copies, for whole arrays of cells at once, and keeps what it read in a table of fixed size.

A word is read byte by byte through a second table that names the arcs that can end at each byte (longest first); the transition
from the state before such an arc decides which one does. Exactly one does. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import LETTERS, Encoded, WordEncoder, slices

END = "</w>"
NEVER = 1 << 60
#: Cells that are kept once read; a later one takes the place of an earlier one with the same slot.
CELLS = 1 << 20
#: Words of more bytes are read one by one, shorter ones together.
LONG = 64
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Marks:
    """Rank by (u, v) of all merges: tables without chains, each for the pairs that collided in the one before."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.levels, bits = [], 18
        while len(keys):
            slot = self.slots(keys, bits)
            first = np.unique(slot, return_index=True)[1]
            table, rank = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
            table[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.levels.append((bits, table, rank))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], bits - 1

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The rank, NEVER for a pair that no merge joins."""
        out = np.full(len(keys), NEVER, dtype=np.int64)
        for bits, table, rank in self.levels:
            slot = self.slots(keys, bits)
            hit = np.flatnonzero(table[slot] == keys)
            out[hit] = rank[slot[hit]]
        return out


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.width = 1 + max(vocab.values())
        self.birth, self.left, self.right = [-1] * self.width, [-1] * self.width, [-1] * self.width
        self.marks: dict[int, int] = {}
        self.dead: set[int] = set()
        for rank, (u, v) in enumerate(merges):
            self.gadget(vocab[u], vocab[v], vocab[u + v], rank)
        self.births, self.lefts, self.rights = (np.array(x, dtype=np.int64) for x in (self.birth, self.left, self.right))
        self.ranks = Marks(np.fromiter(self.marks, dtype=np.int64, count=len(self.marks)), np.fromiter(self.marks.values(), dtype=np.int64, count=len(self.marks)))
        self.cells = np.full(CELLS, -2, dtype=np.int64)  # 2 * cell + allowed
        self.read_arcs({t: i for t, i in vocab.items() if i not in self.dead})

    def gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if u in self.dead or v in self.dead or not self.has(u, v, rank):
            self.dead.add(w)  # no word's tokenisation takes this arc
        self.birth[w], self.left[w], self.right[w] = rank, u, v
        self.marks.setdefault(u * self.width + v, rank)

    def has(self, x: int, y: int, before: int = NEVER) -> bool:
        """Whether the state that arc ``x`` led to before a rank has the arc ``y``."""
        birth = self.birth
        while True:
            if self.marks.get(x * self.width + y, NEVER) < before:
                return False
            if birth[x] > birth[y]:  # the state was there before the arc x: it is where the right part led then
                before = min(before, birth[x])
                x = self.right[x]
            elif birth[y] >= 0:  # the arc y came later: the state has it if it had the left part then
                before = min(before, birth[y] + 1)
                y = self.left[y]
            else:
                return True

    def has_all(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``has`` for arrays."""
        out, live = np.ones(len(x), dtype=bool), np.arange(len(x))
        before = np.full(len(x), NEVER, dtype=np.int64)
        while len(live):
            gone = self.ranks(x * self.width + y) < before
            bx, by = self.births[x], self.births[y]
            back = bx > by
            out[live[gone]] = False
            go = ~gone & (back | (by >= 0))
            x, y, before = np.where(back, self.rights[x], x)[go], np.where(back, y, self.lefts[y])[go], np.minimum(before, np.where(back, bx, by + 1))[go]
            live = live[go]
        return out

    def allowed(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """Whether the states that these arcs led to have the other arcs."""
        cell = state * self.width + arc
        slot = ((cell.astype(np.uint64) * SPREAD) >> np.uint64(44)).astype(np.int64) & (CELLS - 1)
        known = self.cells[slot]
        new = np.flatnonzero(known >> 1 != cell)
        if len(new):
            known[new] = 2 * cell[new] + self.has_all(state[new], arc[new])
            self.cells[slot[new]] = known[new]
        return (known & 1).astype(bool)

    def read_arcs(self, vocab: dict[str, int]) -> None:
        """The byte table: nodes are beginnings of arcs; ``goto`` leads to the longest one that ends with the byte just read."""
        byte = {letter: b for b, letter in enumerate(LETTERS)}
        child: dict[int, int] = {}
        inner, at_end, depth = [-1], [-1], [0]  # by node: the arc that ends here within a word, and at its end
        self.size = np.zeros(self.width, dtype=np.int64)
        node_of = np.zeros(self.width, dtype=np.int64)
        for token, i in vocab.items():
            stem, node = token.removesuffix(END), 0
            for letter in stem:
                key = node << 8 | byte[letter]
                node = child.get(key, 0)
                if not node:
                    node = child[key] = len(depth)
                    inner.append(-1), at_end.append(-1), depth.append(depth[key >> 8] + 1)
            (at_end if token.endswith(END) and stem else inner)[node] = i
            self.size[i], node_of[i] = len(stem), node
        nodes, keys = np.fromiter(child.values(), dtype=np.int64), np.fromiter(child, dtype=np.int64)
        parent, letter, deep = keys >> 8, keys & 255, np.array(depth)[np.fromiter(child.values(), dtype=np.int64)]
        self.row = np.zeros(len(depth), dtype=np.int64)  # a node that nothing goes on from has the row of its longest proper ending
        some = np.unique(parent)
        own = np.full(len(depth), -1, dtype=np.int64)
        own[some] = np.arange(len(some))
        self.goto = np.zeros((len(some), 256), dtype=np.int32)
        self.inner, self.at_end = np.array(inner), np.array(at_end)
        fail = np.zeros(len(depth), dtype=np.int64)
        shorter_inner, shorter_end = np.full(len(depth), -1, dtype=np.int64), np.full(len(depth), -1, dtype=np.int64)
        self.goto[0, letter[parent == 0]] = nodes[parent == 0]
        for d in range(1, max(depth) + 1):
            mine = np.flatnonzero(deep == d)
            here = nodes[mine]
            if d > 1:
                fail[here] = self.goto[self.row[fail[parent[mine]]], letter[mine]]
            self.row[here] = np.where(own[here] >= 0, own[here], self.row[fail[here]])
            full = here[own[here] >= 0]
            self.goto[own[full]] = self.goto[self.row[fail[full]]]
            below = np.isin(parent, full)
            self.goto[own[parent[below]], letter[below]] = nodes[below]
            shorter_inner[here], shorter_end[here] = self.inner[fail[here]], self.at_end[fail[here]]
            self.inner[here] = np.where(self.inner[here] >= 0, self.inner[here], shorter_inner[here])
            self.at_end[here] = np.where(self.at_end[here] >= 0, self.at_end[here], shorter_end[here])
        self.shorter = np.full(self.width, -1, dtype=np.int64)
        ends = np.array([i for t, i in vocab.items() if t.endswith(END) and t != END], dtype=np.int64)
        plain = np.array([i for t, i in vocab.items() if not (t.endswith(END) and t != END)], dtype=np.int64)
        self.shorter[ends], self.shorter[plain] = shorter_end[node_of[ends]], shorter_inner[node_of[plain]]

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        node, n = 0, len(word)
        states = [-1] * (n + 1)
        size, shorter, has = self.size, self.shorter, self.has
        for j, b in enumerate(word, 1):
            node = self.goto[self.row[node], b]
            arc = int(self.inner[node] if j < n else self.at_end[node])
            while (i := j - int(size[arc])) and not has(states[i], arc):
                arc = int(shorter[arc])
            states[j] = arc
        out = []
        while n:
            out.append(states[n])
            n -= int(size[states[n]])
        return out[::-1]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-split words (large_binary), flat, and the number of ids of each. All words take their j-th byte together."""
        edges = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, dtype=np.uint8)
        sizes = np.diff(edges)
        count = np.zeros(len(words), dtype=np.int64)
        alone = {int(k): self.encode(words[int(k)].as_py()) for k in np.flatnonzero(sizes > LONG)}
        short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        order = short[np.argsort(-sizes[short], kind="stable")]
        n, begin = sizes[order], edges[:-1][order]
        base = np.cumsum(n + 1) - (n + 1)  # where a word's states stand: one before each byte and one at the end
        states, taken = np.full(int((n + 1).sum()), -1, dtype=np.int64), np.zeros(int((n + 1).sum()), dtype=np.int32)
        node = np.zeros(len(order), dtype=np.int64)
        for j in range(1, int(n[0]) + 1 if len(n) else 0):
            live = int(np.searchsorted(-n, -j, side="right"))  # words of j bytes or more
            more = int(np.searchsorted(-n, -j, side="left"))  # words of more than j
            node = self.goto[self.row[node[:live]], raw[begin[:live] + (j - 1)]]
            arc = np.concatenate([self.inner[node[:more]], self.at_end[node[more:]]])
            at = base[:live]
            while len(at):
                from_ = at + j - self.size[arc]
                state = states[from_]
                ok = state < 0  # from_ is the word's beginning
                inside = np.flatnonzero(~ok)
                ok[inside] = self.allowed(state[inside], arc[inside])
                states[at[ok] + j] = arc[ok]
                taken[at[ok] + j] = taken[from_[ok]] + 1
                at, arc = at[~ok], self.shorter[arc[~ok]]
        at = base + n
        count[order] = taken[at]
        for k, ids in alone.items():
            count[k] = len(ids)
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), dtype="<u4")
        slot, low = (start + count - 1)[order], base
        while len(at):
            arc = states[at]
            out[slot] = arc
            at, slot = at - self.size[arc], slot - 1
            left = at > low
            at, slot, low = at[left], slot[left], low[left]
        for k, ids in alone.items():
            out[start[k] : start[k] + count[k]] = ids
        return out, count


def load(path: str) -> tuple[MergeAutomaton, list[str], dict[str, int]]:
    """Automaton, labels by id and special tokens of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    vocab = t["model"]["vocab"]
    special = {a["content"]: a["id"] for a in t["added_tokens"]}
    labels = [""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in [*vocab.items(), *special.items()]:
        labels[i] = token
    plain = {token: i for token, i in vocab.items() if token not in special}
    return MergeAutomaton(plain, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in t["model"]["merges"]]), labels, special


_LOADED: dict[str, tuple] = {}


def loaded(path: str) -> tuple[WordEncoder, list[str], dict[str, int]]:
    """Encoder, labels and special tokens, compiled once in each worker."""
    if path not in _LOADED:
        automaton, labels, special = load(path)
        _LOADED[path] = automaton.encode_words, labels, special
    return _LOADED[path]


def decode(ids, labels: list[str]) -> str:
    """Arc labels joined by a space, as the vocabulary file names no decoder."""
    return " ".join([labels[i] for i in ids])


def joined(names: pa.Array, e: Encoded) -> pa.Array:
    """For each text, its ids' names joined by a space."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(e.offsets, pa.int64()), names.take(pa.array(e.ids))), pa.scalar(" ", pa.large_string()))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token count and digests of the ids and of the decoded text, one row for each row of ``df``.

    A null or empty text has no ids: 0 and the digests of the empty string. Repeated rows give repeated rows; a null key
    stays null; an empty table gives no rows; other columns are not read. A very long text is worked on whole, by itself: some 60
    bytes of memory for each of its bytes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, labels, special = loaded(path)
        digest = lambda strings: pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in strings])
        numbers, names = pa.array(map(str, range(len(labels))), pa.large_string()), pa.array(labels, pa.large_string())
        for b in batches:
            for lo, hi in slices(b.column(1)):
                e = Encoded(b.column(1).slice(lo, hi - lo), encoder, special)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(e.offsets)), digest(joined(numbers, e)), digest(joined(names, e))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[key].alias("doc_id"), df[text].alias("text")).mapInArrow(task, SCHEMA)


def ids_frame(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ids themselves and the decoded text, for use beyond digests: doc_id, ids, decoded.

    A null or empty text has no ids and an empty decoded text; a null key stays null; repeated rows give repeated rows; an empty table gives none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, labels, special = loaded(path)
        names = pa.array(labels, pa.large_string())
        for b in batches:
            for lo, hi in slices(b.column(1)):
                e = Encoded(b.column(1).slice(lo, hi - lo), encoder, special)
                ids = [e.ids[x:y].tolist() for x, y in zip(e.offsets[:-1], e.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), joined(names, e).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return df.select(df[key].alias("doc_id"), df[text].alias("text")).mapInArrow(task, "doc_id long, ids array<int>, decoded string")
