"""Words and hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: The primes of the public XXH64 hash.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

#: Spans longer than this are hashed one by one.
LONG_SPAN = 1024
SPACE = 32


def rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, lane):
    return rotl(acc + lane * P2, 31) * P1


def xxh64_spans(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start+size] for every span."""
    with np.errstate(over="ignore"):
        return _xxh64_spans(buf, start, size, seed)


def _xxh64_spans(buf: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    raw = np.frombuffer(buf + bytes(8), dtype=np.uint8)
    words = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)).copy()
    s = np.uint64(seed)
    out = np.full(len(start), s + P5, dtype=np.uint64)
    at = start.astype(np.int64)
    left = size.astype(np.int64)
    far = np.flatnonzero(left > LONG_SPAN)
    left[far] = 0
    wide = np.flatnonzero(left >= 32)
    if len(wide):
        lanes = [np.full(len(wide), x, dtype=np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        pos, stripes = at[wide], left[wide] // 32
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            for lane in range(4):
                lanes[lane][on] = _round(lanes[lane][on], words[pos[on] + (32 * k + 8 * lane)])
        h = rotl(lanes[0], 1) + rotl(lanes[1], 7) + rotl(lanes[2], 12) + rotl(lanes[3], 18)
        for lane in lanes:
            h = (h ^ _round(np.uint64(0), lane)) * P1 + P4
        out[wide] = h
        at[wide] += 32 * stripes
    out += left.astype(np.uint64)
    left %= 32
    for k in range(3):
        on = np.flatnonzero(left >= 8)
        out[on] = rotl(out[on] ^ _round(np.uint64(0), words[at[on]]), 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    out[on] = rotl(out[on] ^ ((words[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for k in range(3):
        on = np.flatnonzero(left >= 1)
        out[on] = rotl(out[on] ^ (raw[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    for i in far:
        out[i] = xxhash.xxh64_intdigest(buf[int(start[i]) : int(start[i] + size[i])], seed)
    return out


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * P1
        x = (x ^ (x >> np.uint64(29))) * P2
        return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts, as spans of one buffer in which single spaces part them.

    ``text`` is the index of a word's text, ``place`` its place among the words of that text, ``count``
    the number of words by text.
    """

    def __init__(self, texts: list[bytes]):
        parts = [b" ".join(t.split()) for t in texts]
        self.count = np.array([p.count(b" ") + 1 if p else 0 for p in parts], dtype=np.int64)
        self.buf = b" ".join(p for p in parts if p)
        gaps = np.flatnonzero(np.frombuffer(self.buf, dtype=np.uint8) == SPACE)
        n = int(self.count.sum())
        self.start = np.concatenate([[0], gaps + 1]).astype(np.int64)[:n]
        self.end = np.concatenate([gaps, [len(self.buf)]]).astype(np.int64)[:n]
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.place = np.arange(n) - self.first[self.text]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and size of every run of k words; of fewer words, the whole sequence."""
        ordinary = np.flatnonzero(self.place <= self.count[self.text] - k)
        short = np.flatnonzero((self.place == 0) & (self.count[self.text] < k))
        heads = np.sort(np.concatenate([ordinary, short]))
        tails = np.minimum(heads + k, self.first[self.text[heads] + 1]) - 1
        return self.text[heads], self.start[heads], self.end[tails] - self.start[heads]


def segments(text: bytes, k: int, most: int) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes whose runs of k words are together those of the text."""
    while len(text) > most:
        cut = text.rfind(b" ", 0, most)
        back = cut
        for _ in range(k - 1):
            back = text.rfind(b" ", 0, max(back, 0))
        if back <= 0:
            cut = text.find(b" ", most)
            if cut < 0:
                break
            back = cut
            for _ in range(k - 1):
                back = text.rfind(b" ", 0, max(back, 0))
            if back <= 0:
                most *= 2
                continue
        yield text[:cut]
        text = text[back + 1 :]
    yield text
