"""A byte-level BPE tokenizer compiled, as far as texts need it, to a deterministic transducer over bytes.

A state is what decides the future: where the reader is in the pattern that parts a text into pieces, and the
pending bytes of the open piece, those after its last stable token (``bpe``). Reading a byte leads to one next
state and emits the tokens that become stable; each transition is annotated with them and with their number.
States and transitions are made when a text first needs them and kept in arrays, so that many stretches of
text advance together, one byte each, in a few array operations. When the tables are full they are emptied and
filled again by what is needed next: memory stays bounded and results do not depend on it.

Stretches. White space after a visible ASCII character ends a piece whatever was read before. From there on
the machine behaves as if it started anew, except that the piece before is closed: the map from the state in
which a chunk of text is entered to the state in which it is left is constant after its first such place. So
the chunks of a text are moved to the first such place at or after every LANE-th byte (which gives a chunk's
undecided head to its left neighbour, that is, composes the two maps), all chunks run at once from the start
state, and the maps of a text compose by adding up what they emit. A chunk without such a place is one longer
stretch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from hearthspark.llm.bpe import BytePairs, byte_pairs

LANE = 512
#: States, and transitions, that the tables hold at most.
STATES = 1 << 18
TRANSITIONS = 1 << 20
#: Slots of the table of transitions, as a power of two; with the bound above it stays half empty.
SLOTS = 21
#: Remembered steps of open pieces.
STEPS = 1 << 16
START, SPACE, LETTERS, NUMBERS, OTHERS, QUOTE = range(6)
_SPACE, _LETTER, _NUMBER = (regex.compile(x) for x in (r"\s", r"\p{L}", r"\p{N}"))
#: What may follow an apostrophe to make one piece with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

State = tuple[int, bytes, bytes, bytes]


class Machine:
    """Transitions from (state, byte) to the next state and an emission."""

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs
        self.emissions: list[tuple[int, ...]] = [()]
        self.numbers = {(): 0}
        self.sizes = np.zeros(1 << 12, dtype=np.int64)
        self._class: dict[bytes, int] = {}
        self._last: dict[bytes, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = []
        self.index: dict[State, int] = {}
        self.key = np.full(1 << SLOTS, -1, dtype=np.int32)
        self.to = np.zeros(1 << SLOTS, dtype=np.int32)
        self.said = np.zeros(1 << SLOTS, dtype=np.int32)
        self.filled = 0
        self.end = np.full(1 << 10, -1, dtype=np.int32)
        self.number((START, b"", b"", b""))

    def full(self) -> bool:
        return len(self.states) >= STATES or self.filled >= TRANSITIONS

    def number(self, state: State) -> int:
        """The row of a state: pattern state, pending bytes, last white space or contraction, unfinished character."""
        at = self.index.get(state)
        if at is None:
            at = self.index[state] = len(self.states)
            self.states.append(state)
            if at >= len(self.end):
                self.end = np.concatenate([self.end, np.full(len(self.end), -1, dtype=np.int32)])
        return at

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions of these keys (state * 256 + byte) are, or the free slot that ends the search."""
        at = ((keys.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS)).astype(np.int64)
        held = self.key[at]
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)
            held = self.key[at[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return at

    def emission(self, tokens: tuple[int, ...]) -> int:
        at = self.numbers.get(tokens)
        if at is None:
            at = self.numbers[tokens] = len(self.emissions)
            self.emissions.append(tokens)
            if at >= len(self.sizes):
                self.sizes = np.concatenate([self.sizes, np.zeros(len(self.sizes), dtype=np.int64)])
            self.sizes[at] = len(tokens)
        return at

    # The open piece.

    def lasts(self, pending: bytes) -> list[int]:
        """The last token of the encoding of each prefix."""
        known = self._last.get(pending)
        if known is None:
            if len(self._last) >= STEPS:
                self._last.clear()
            known = self._last[pending] = [-1]
            self.pairs.grow(pending, known)
        return known

    def grow(self, pending: bytes, more: bytes) -> tuple[tuple[int, ...], bytes]:
        """The tokens that ``more`` makes stable, and what is pending then."""
        whole, last = pending + more, self.lasts(pending).copy()
        self.pairs.grow(whole, last)
        at = self.pairs.stable(whole, last)
        return tuple(self.pairs.path(last, at)), whole[at:]

    def close(self, pending: bytes) -> tuple[int, ...]:
        """The tokens of the pending bytes at the end of a piece."""
        return tuple(self.pairs.path(self.lasts(pending), len(pending)))

    # The pattern.

    def kind(self, char: bytes) -> int:
        known = self._class.get(char)
        if known is None:
            c = char.decode()
            known = SPACE if _SPACE.match(c) else LETTERS if _LETTER.match(c) else NUMBERS if _NUMBER.match(c) else OTHERS
            self._class[char] = known
        return known

    def begin(self, char: bytes) -> tuple[tuple[int, ...], State]:
        """A character where a piece begins."""
        kind = self.kind(char)
        if kind == SPACE:
            return (), (SPACE, b"", char, b"")
        if char == b"'":
            return (), (QUOTE, b"", b"", b"")
        out, pending = self.grow(b"", char)
        return out, (kind, pending, b"", b"")

    def read(self, state: State, char: bytes) -> tuple[tuple[int, ...], State]:
        """A whole character in any state."""
        mode, pending, extra, _ = state
        if mode == START:
            return self.begin(char)
        kind = self.kind(char)
        if mode == SPACE:
            if kind == SPACE:
                out, pending = self.grow(pending, extra)
                return out, (SPACE, pending, char, b"")
            out = self.close(pending)
            if extra == b" ":
                first, pending = self.grow(b"", b" ")
                more, pending = self.grow(pending, char)
                return out + first + more, (kind, pending, b"", b"")
            more, then = self.begin(char)
            return out + self.close(extra) + more, then
        if mode == QUOTE:
            said = (extra + char).decode()
            if said in CONTRACTIONS:
                return self.close(b"'" + extra + char), (START, b"", b"", b"")
            if any(c.startswith(said) for c in CONTRACTIONS):
                return (), (QUOTE, b"", extra + char, b"")
            if extra:
                out, then = self.begin(extra)
                more, then = self.read(then, char)
                return self.close(b"'") + out + more, then
            if kind == OTHERS:
                first, pending = self.grow(b"", b"'")
                more, pending = self.grow(pending, char)
                return first + more, (OTHERS, pending, b"", b"")
            out, then = self.begin(char)
            return self.close(b"'") + out, then
        if kind == mode:
            out, pending = self.grow(pending, char)
            return out, (mode, pending, b"", b"")
        out, then = self.begin(char)
        return self.close(pending) + out, then

    def finish(self, state: State) -> tuple[int, ...]:
        """What the end of the text emits."""
        mode, pending, extra, _ = state
        if mode == SPACE:
            out, pending = self.grow(pending, extra)
            return out + self.close(pending)
        if mode == QUOTE:
            return self.close(b"'") + (self.close(extra) if extra else ())
        return self.close(pending)

    # The tables.

    def fill(self, keys: np.ndarray) -> None:
        """Make the transitions of these keys."""
        for key in keys.tolist():
            at, byte = divmod(key, 256)
            mode, pending, extra, part = self.states[at]
            char = part + bytes([byte])
            lead = char[0]
            size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if len(char) < size:
                out, then = (), (mode, pending, extra, char)
            else:
                out, then = self.read((mode, pending, extra, b""), char)
            slot = ((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - SLOTS)
            while self.key.item(slot) >= 0:
                slot = (slot + 1) & ((1 << SLOTS) - 1)
            self.key[slot], self.to[slot], self.said[slot] = key, self.number(then), self.emission(out)
            self.filled += 1

    def ends(self, states: np.ndarray) -> np.ndarray:
        """The emissions at the end of a stretch."""
        for at in np.unique(states[self.end[states] < 0]).tolist():
            self.end[at] = self.emission(self.finish(self.states[at]))
        return self.end[states]


@lru_cache(maxsize=4)
def machine(path: str) -> Machine:
    return Machine(byte_pairs(path))


def stretches(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the stretches of texts that lie at begin..end of a buffer."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    visible = (raw > 32) & (raw < 127)
    cuts = np.flatnonzero(space[1:] & visible[:-1]) + 1
    size = end - begin
    count = np.maximum((size - 1) // LANE, 0)
    text = np.repeat(np.arange(len(begin)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
    wanted = begin[text] + step * LANE
    found = np.searchsorted(cuts, wanted)
    at = cuts[np.minimum(found, len(cuts) - 1)] if len(cuts) else wanted
    good = (found < len(cuts)) & (at < end[text])
    inner, owner = at[good], text[good]
    start = np.concatenate([begin, inner])
    owner = np.concatenate([np.arange(len(begin)), owner])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (owner[1:] != owner[:-1])
    start, owner = start[fresh], owner[fresh]
    stop = np.concatenate([start[1:], [0]])
    final = np.ones(len(owner), dtype=bool)
    final[:-1] = owner[1:] != owner[:-1]
    stop[final] = end[owner[final]]
    return owner, start, stop


def run(m: Machine, texts: list[bytes], keep: bool = False) -> tuple[np.ndarray, list[bytes] | None]:
    """The number of tokens of each text and, if asked for, the ids as little-endian words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner, start, stop = stretches(raw, end - sizes, end)
    length = stop - start
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    n = len(order)
    state = np.zeros(n, dtype=np.int64)
    many = np.zeros(n, dtype=np.int64)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    active = np.searchsorted(-length, -np.arange(int(length[0]) if n else 0), side="left")
    for t, on in enumerate(active.tolist()):
        if m.full():
            held = [m.states[s] for s in state.tolist()]
            m.reset()
            state = np.array([m.number(s) for s in held], dtype=np.int64)
        key = state[:on] * 256 + raw[start[:on] + t]
        slot = m.slots(key)
        fresh = m.key[slot] != key
        if fresh.any():
            m.fill(np.unique(key[fresh]))
            slot = m.slots(key)
        to, said = m.to[slot], m.said[slot]
        state[:on] = to
        out = np.flatnonzero(said)
        if keep:
            seen.append((out, said[out]))
        many[out] += m.sizes[said[out]]
    said = m.ends(state)
    many += m.sizes[said]
    counts = np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64)
    if not keep:
        return counts, None
    seen.append((np.arange(n), said))
    lane = np.concatenate([x for x, _ in seen])
    what = np.concatenate([y for _, y in seen])
    place = np.lexsort((start[lane], owner[lane])) if len(lane) else lane
    what = what[place]
    flat, offsets = _flat(m)
    reps = m.sizes[what]
    total = int(reps.sum())
    into = np.repeat(offsets[what] - (np.cumsum(reps) - reps), reps) + np.arange(total)
    ids = flat[into].astype("<u4")
    cut = np.concatenate([[0], np.cumsum(counts)])
    return counts, [ids[cut[i] : cut[i + 1]].tobytes() for i in range(len(texts))]


def _flat(m: Machine) -> tuple[np.ndarray, np.ndarray]:
    sizes = m.sizes[: len(m.emissions)]
    flat = np.fromiter((x for e in m.emissions for x in e), dtype=np.int64, count=int(sizes.sum()))
    return flat, np.cumsum(sizes) - sizes


def tokenize(path: str, texts: list[bytes], keep: bool = False) -> tuple[np.ndarray, list[bytes] | None]:
    """As ``run``, with the strings of special tokens inside texts as those tokens."""
    m = machine(path)
    marks = {mark.encode(): i for mark, i in m.pairs.special.items()}
    if not any(mark in t for t in texts for mark in marks):
        return run(m, texts, keep)
    split = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(marks, key=len, reverse=True))) + b")")
    parts = [split.split(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    flat = [x for p in parts for x in p]
    plain = [b"" if x in marks else x for x in flat]
    some, ids = run(m, plain, keep)
    special = np.array([x in marks for x in flat])
    counts = np.bincount(owner, weights=some + special, minlength=len(texts)).astype(np.int64)
    if not keep:
        return counts, None
    joined: list[list[bytes]] = [[] for _ in texts]
    for at, x, got in zip(owner.tolist(), flat, ids, strict=True):
        joined[at].append(np.array([marks[x]], dtype="<u4").tobytes() if x in marks else got)
    return counts, [b"".join(j) for j in joined]
