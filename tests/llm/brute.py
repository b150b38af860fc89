"""The contracts, done the long way in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[\x20\x09-\x0D]+"


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def space_words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def shingles(text: str | None, k: int) -> frozenset:
    w = space_words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(rows: list[tuple], k: int, percent: int) -> dict:
    """id to the least id it reaches, over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    p, q = top(i), top(j)
                    up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}


def contaminated(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - n + 1)) if w and item is not None else ():
            windows[tuple(w[i : i + n])].add(str(item))
    sizes, out = sorted({len(w) for w in windows}), []
    for i, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for a in range(len(w)):
            for size in sizes:
                got = windows.get(tuple(w[a : a + size])) if a + size <= len(w) else None
                if got:
                    hit.update(range(a, a + size))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
