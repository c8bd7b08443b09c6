"""Encoding of many texts through their distinct words, in arrays.

A chunk is a run without ASCII white space. The tokenizer drops white space and joins nothing across it, so
a text's ids are those of its chunks in order. The distinct chunks of a slice of texts are split into words, and each distinct
word is encoded once; then ids are laid out by gathering.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: The vocabulary file's splitting pattern; its ``\s`` is the Unicode property White_Space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: The same, with the ends of lines, which stand between chunks.
LINED_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|\n|[^\p{White_Space}\p{L}\p{N}]+")
#: Bytes of text in a slice; bounds the memory of a worker, not the result.
SLICE_BYTES = 2 << 20
#: Words kept in each of two generations of a worker's cache; only speed depends on it.
CACHE = 100_000

#: (words as large_binary) -> their ids, flat, and the number of ids of each.
WordEncoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def lower(text: str) -> str:
    """Lower case character by character, as the vocabulary's normaliser does (no final sigma)."""
    return text.replace("Σ", "σ").lower()


def normal(text: str) -> str:
    return lower(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))


def split_words(chunk: str) -> list[str]:
    return WORDS.findall(normal(chunk))


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


LETTERS = byte_letters()


def as_letters(word: bytes) -> str:
    return word.decode() if word.isalpha() else "".join([LETTERS[b] for b in word])


class TwoGenerations(dict):
    """A bounded cache: a full generation becomes the old one, and what is used again moves up."""

    def __init__(self, make: Callable, cap: int = CACHE):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def one_by_one(ids_of: Callable[[bytes], list[int]]) -> WordEncoder:
    """An encoder of words through a cache and a function for a single word."""
    known = TwoGenerations(lambda w: np.array(ids_of(w), dtype="<u4").tobytes())

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes = [known[w] for w in words.to_pylist()]
        return np.frombuffer(b"".join(codes), dtype="<u4"), np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4

    return encode


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def from_offsets(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def ascii_words(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of ASCII chunks, in order, and their number in each chunk. The pattern's alternatives as marks on bytes."""
    edges = np.frombuffer(chunks.buffers()[1], dtype=np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    raw = np.frombuffer(chunks.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    n = len(raw)
    low = np.zeros(n + 3, dtype=np.uint8)
    low[:n] = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    letter = (low >= 97) & (low <= 122)
    digit = (low >= 48) & (low <= 57)
    kind = letter + 2 * digit
    first = np.ones(n + 1, dtype=bool)
    first[1:n] = (kind[1:n] != kind[: n - 1]) | digit[1:n]
    opens = np.zeros(n + 4, dtype=bool)  # a chunk begins here, or the bytes end
    opens[edges] = True
    first |= opens[: n + 1]
    at = np.flatnonzero((low[:n] == ord("'")) & first[:n])  # an apostrophe inside a run of other signs belongs to the run
    one, two = low[at + 1], low[at + 2]
    single = ((one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))) & ~opens[at + 1]
    double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~opens[at + 1] & ~opens[at + 2]
    first[at[single] + 1] = first[at[double] + 1] = False
    first[at[single] + 2] = first[at[double] + 3] = True
    starts = np.flatnonzero(first)  # ends with n, which begins nothing
    return from_offsets(starts, low[:n]), np.diff(np.searchsorted(starts, edges))


def other_words(chunks: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of any chunks, in order, and their number in each chunk."""
    found = LINED_WORDS.findall(normal("".join([c + "\n" for c in chunks])))
    words = pa.array(found, pa.large_string())
    ends = pc.equal(words, "\n").to_numpy(zero_copy_only=False)
    closed = np.flatnonzero(ends)
    return words.filter(pa.array(~ends)).cast(pa.large_binary()), np.diff(closed, prepend=-1) - 1


class Encoded:
    """The ids of a slice of texts, flat: text i has ids[offsets[i]:offsets[i + 1]]."""

    def __init__(self, texts: pa.Array, encode: WordEncoder, special: dict[str, int]):
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        list_offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        index, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        marked = pc.match_substring_regex(distinct, SPECIAL.pattern).to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(distinct).to_numpy(zero_copy_only=False) & ~marked
        groups, counts, words = [], [], []
        for chosen in (plain, ~plain & ~marked, marked):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            some = distinct.take(pa.array(at))
            if chosen is marked:  # special tokens stand as words of their own; a letter that no word holds marks them
                made = [[w for p in SPECIAL.split(c) for w in ([b"\n" + p.encode()] if p in special else [x.encode() for x in split_words(p)])] for c in some.to_pylist()]
                found, each = pa.array([w for x in made for w in x], pa.large_binary()), np.array(list(map(len, made)))
            else:
                found, each = ascii_words(some) if chosen is plain else other_words(some.to_pylist())
            groups.append(at), counts.append(each), words.append(found)
        if not groups:
            self.ids, self.offsets = np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
            return
        spelled = pa.concat_arrays(words).dictionary_encode()
        which, vocabulary = spelled.indices.to_numpy(zero_copy_only=False), spelled.dictionary
        named = pc.starts_with(vocabulary, b"\n").to_numpy(zero_copy_only=False)
        ids, n = encode(vocabulary.filter(pa.array(~named)))
        if named.any():
            theirs = np.array([special[w[1:].decode()] for w in vocabulary.filter(pa.array(named)).to_pylist()], dtype="<u4")
            every, start = np.ones(len(vocabulary), dtype=np.int64), np.zeros(len(vocabulary), dtype=np.int64)
            every[~named], start[~named] = n, np.cumsum(n) - n
            start[named] = len(ids) + np.arange(len(theirs))
            ids, n = np.concatenate([ids, theirs]), every
        else:
            start = np.cumsum(n) - n
        # chunks, in the order of their groups
        order, each = np.concatenate(groups), np.concatenate(counts)
        sizes = np.concatenate([[0], np.cumsum(n[which])])
        last = np.cumsum(each)
        table = ids[spread(start[which], n[which])]
        chunk_start, chunk_size = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        chunk_start[order], chunk_size[order] = sizes[last - each], sizes[last] - sizes[last - each]
        size = chunk_size[index]
        self.ids = table[spread(chunk_start[index], size)]
        self.offsets = np.concatenate([[0], np.cumsum(size)])[list_offsets - list_offsets[0]]
