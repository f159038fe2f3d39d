"""Slow and plain versions of the operators, for small tables."""

from __future__ import annotations

import re

import xxhash


def words(text: str | None) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]


def runs(items: list, k: int) -> list[tuple]:
    if not items:
        return []
    return [tuple(items[i : i + k]) for i in range(max(1, len(items) - k + 1))]


def simhash(text: str | None) -> int:
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs(words(text), 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, linked) -> dict:
    """The smallest id that links reach, by id position."""
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    members: dict[int, list] = {}
    for i in range(len(ids)):
        members.setdefault(top(i), []).append(ids[i])
    return {i: min((x for x in members[top(i)] if x is not None), default=None) for i in range(len(ids))}
