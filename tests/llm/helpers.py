"""Brute-force versions of what the operators compute."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(prints, radius=2):
    """Component label (least index) of each fingerprint."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = find(i), find(int(j))
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, dtype=np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(r)] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()))
    return out


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def quality(text):
    w = WORD.findall(text or "")
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def sha(b):
    return hashlib.sha256(b).hexdigest()
