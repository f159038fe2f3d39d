"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs
(a merge across a boundary can only come from the two tokens beside it). Two things follow. First, the
encodings of all prefixes of a piece form a tree: the last token of the encoding of a prefix is the one token
that ends there and is compatible with the last token of the prefix before it. Second, whatever is read later,
the final encoding has a boundary at some position from which a token can still run past what has been read.
The point where the branches of all such positions meet is final: tokens before it are stable and are emitted,
bytes after it are pending. What follows depends on the pending bytes alone.

How far the stable point can lag behind is a property of the merge list (``BytePairs.lookahead``): a byte can
change a boundary to its left only through a chain of merges, each of which competes for the left token of the
one before and is applied after it. Ranks grow along such a chain, so that one pass over the merges by rank
gives the longest.
"""

from __future__ import annotations

import codecs
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pattern that parts a text into pieces before merging.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A place between two pieces whatever stands around: white space after something else.
CUT = regex.compile(r"\S(?=\s)", regex.REVERSE)

#: Characters read at a time.
READ = 1 << 16
#: Pieces of at most this many characters are remembered, and at most so many of them.
SHORT = 64
REMEMBERED = 1 << 17
#: Bytes of an open piece after which stable tokens are looked for.
STEP = 256


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, then from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """The merge list of a tokenizer file, with what the transducers derive from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_characters()
        self.ids = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.words = dict(map(reversed, self.ids.items()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self.longest = max(map(len, self.ids))
        self.prefixes = {w[:k] for w in self.ids for k in range(1, len(w))}
        sizes = defaultdict(set)
        for word in self.ids:
            sizes[word[-2:]].add(len(word))
        self.sizes = {end: sorted(n, reverse=True) for end, n in sizes.items()}
        self._alone: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def lookahead(self) -> int:
        """Bytes that must follow a boundary at most before it can no longer change."""
        reach = {i: len(w) for i, w in self.words.items()}
        for (a, b), (_, made) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            through = reach[b] + len(self.words[a])
            reach[a] = max(reach[a], through)
            reach[made] = max(reach[made], through)
        return max(reach.values()) + self.longest

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by the definition: the lowest merge first, and of equal ones the leftmost."""
        parts = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merged(self.words[a] + self.words[b]) == [a, b]
        return known

    def own(self, a: int) -> bool:
        known = self._alone.get(a)
        if known is None:
            known = self._alone[a] = self.merged(self.words[a]) == [a]
        return known

    def grow(self, piece: bytes, last: list[int]) -> None:
        """Append to ``last`` the last token of the encoding of each further prefix; last[0] stands for none."""
        for end in range(len(last), len(piece) + 1):
            for size in (*self.sizes.get(piece[max(0, end - 2) : end], ()), 1):
                if size > end:
                    continue
                token = self.ids.get(piece[end - size : end])
                if token is None or not self.own(token):
                    continue
                if size == end or self.neighbours(last[end - size], token):
                    last.append(token)
                    break

    def path(self, last: list[int], end: int) -> list[int]:
        """The tokens of the encoding of the prefix of this length."""
        out = []
        while end:
            out.append(last[end])
            end -= len(self.words[last[end]])
        return out[::-1]

    def stable(self, piece: bytes, last: list[int]) -> int:
        """The position before which no token can change, whatever follows."""
        n = len(piece)
        open_ = {n} | {i for i in range(max(0, n - self.longest), n) if piece[i:] in self.prefixes}
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(top - len(self.words[last[top]]))
        return open_.pop()


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


class PieceEncoder:
    """One piece, fed in parts: gives the tokens that have become stable, and the rest at its end."""

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs
        self.pending = b""
        self.last = [-1]

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(more), STEP):
            self.pending += more[i : i + STEP]
            self.pairs.grow(self.pending, self.last)
            if len(self.pending) >= STEP and (at := self.pairs.stable(self.pending, self.last)):
                out += self.pairs.path(self.last, at)
                self.pending = self.pending[at:]
                self.last = [-1]
                self.pairs.grow(self.pending, self.last)
        return out

    def close(self) -> list[int]:
        out = self.pairs.path(self.last, len(self.pending))
        self.pending, self.last = b"", [-1]
        return out


class _Remembered(dict):
    """Short pieces and their tokens, as bytes of little-endian words; emptied when full."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        encoder = PieceEncoder(self.pairs)
        out = np.array(encoder.feed(piece.encode()) + encoder.close(), dtype="<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """One text to token ids, piece by piece, in memory that does not grow with it.

    For a text at hand alone; ``machine`` compiles the same steps for many texts at once.
    """

    def __init__(self, path: str):
        self.pairs = byte_pairs(path)
        self.known = _Remembered(self.pairs)
        marks = sorted(self.pairs.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of a text in order, as bytes of little-endian words, as they become stable."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text, at, mark.start())
            yield np.array([self.pairs.special[mark.group()]], dtype="<u4").tobytes()
            at = mark.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while at < end:
            cut = end
            if end - at > READ:
                found = CUT.search(text, at, at + READ)
                cut = found.end() if found else 0
            if cut:
                yield b"".join(map(self.known.__getitem__, PATTERN.findall(text[at:cut])))
                at = cut
                continue
            cut = self._next_cut(text, at + READ, end)
            for piece in PATTERN.finditer(text[at:cut]):
                if piece.end() - piece.start() <= READ:
                    yield self.known[piece.group()]
                    continue
                encoder = PieceEncoder(self.pairs)
                for i in range(at + piece.start(), at + piece.end(), STEP):
                    part = text[i : min(i + STEP, at + piece.end())]
                    yield np.array(encoder.feed(part.encode()), dtype="<u4").tobytes()
                yield np.array(encoder.close(), dtype="<u4").tobytes()
            at = cut

    @staticmethod
    def _next_cut(text: str, at: int, end: int) -> int:
        found = regex.compile(r"\S(?=\s)").search(text, at, end)
        return found.end() if found else end


class Decoder:
    """Token ids to text; bytes of an unfinished character wait for the next tokens."""

    def __init__(self, path: str):
        pairs = byte_pairs(path)
        self.words = pairs.words | {i: mark.encode() for mark, i in pairs.special.items()}
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.text.decode(b"".join(map(self.words.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())))

    def close(self) -> str:
        out = self.text.decode(b"", True)
        self.text.reset()
        return out
