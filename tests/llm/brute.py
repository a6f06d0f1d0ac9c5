"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(bytes(UPPER.get(i, i) for i in range(256))).split()


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_dups(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component id), all pairs compared that share a shingle."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sorted(sets.items()):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contained(docs: list[tuple], items: list[tuple]) -> dict[tuple, tuple[int, int]]:
    """(doc, item) -> (item shingles, shared)."""
    out = {}
    for item, text in items:
        w = word_list(text)
        width = min(len(w), 5)
        q = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()
        for doc, t in docs:
            d = word_list(t)
            have = {tuple(d[i : i + width]) for i in range(len(d) - width + 1)} if width else set()
            n = len(q & have)
            if q and 100 * n >= 75 * len(q):
                out[doc, item] = len(q), n
    return out


def chat(turns: list[tuple]) -> dict[int, tuple]:
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: r[0])
        said = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        learned = "".join(t for _, r, t in rows if r == "assistant")
        out[conv] = len(rows), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()
    return out


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2) -> dict:
    """Shares dealt again and again until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, got, open_ = share * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not full:
            got |= {s: unit * weight[s] for s in open_}
            break
        got |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return got


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def fold(text: str | None) -> str:
    return (text or "").translate(UPPER)
