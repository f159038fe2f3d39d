"""Many requests against the rows of one slab, with a bit for each row.

A slab is a shard of a block of listings, of some hundred thousand rows at most. Spark deals the slabs and the requests that
meet them over the tasks; here each test of a request is one bit per row, made once for all requests that ask the same,
and the requests' tests are met by AND, 64 rows at a time. Rows lie in the order a request asks for, so that places in
its order are counts of bits.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EARTH_KM = 6371.0
# Bytes of bits that are met at once, and how many tests' bits are kept for the requests that follow.
AT_ONCE = 1 << 21
KEPT = 512
FOUND_AT_ONCE = 1 << 16
SETS = {"q_beds": "beds_int", "q_baths": "bath_int", "q_furnished": "furnished_flag", "q_completion": "completion_status"}


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """The column as doubles; null is no number."""
    return table[name].cast(pa.float64()).to_numpy()


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """(codes, values): each row's place in the distinct values, the last of which is null."""
    kept = pc.dictionary_encode(column.combine_chunks())
    if isinstance(kept, pa.ChunkedArray):
        kept = kept.combine_chunks()
    values = kept.dictionary.to_pylist()
    return kept.indices.fill_null(len(values)).to_numpy(zero_copy_only=False), [*values, None]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    both = np.ascontiguousarray(np.stack([a, b], axis=1)).view(np.complex128).ravel()
    values, codes = np.unique(both, return_inverse=True)
    return codes, [(v.real, v.imag) for v in values]


def _km(lat1: float, lon1: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``geo.haversine``, rounded as the search ranks by it."""
    lat, lon = np.sin((np.radians(lat2) - np.radians(lat1)) / 2), np.sin((np.radians(lon2) - np.radians(lon1)) / 2)
    a = lat * lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * lon * lon
    return np.round(2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a))), 9)


class Rows:
    """A slab's rows that can match a request at all: a row without price, size or flags never does."""

    def __init__(self, table: pa.Table):
        missing = [np.isnan(_numbers(table, c)) for c in ("price", "size_sqft", "trusted", "verified")]
        table = table.filter(pa.array(~np.any(missing, axis=0)))
        self.n = table.num_rows
        self.numbers = {
            c: _numbers(table, c)
            for c in ("price", "size_sqft", "trusted", "verified", "beds_int", "listed_at", "ai_score", "latitude", "longitude")
        }
        self.coded = {c: _coded(table[c]) for c in (*SETS.values(), "property_type")}
        ids = table["property_listing_id"].fill_null("").combine_chunks()
        order = pc.sort_indices(ids).to_numpy()
        laid = ids.take(pa.array(order))
        new = np.ones(self.n, dtype=bool)
        if self.n > 1:
            new[1:] = pc.not_equal(laid[1:], laid[:-1]).to_numpy(zero_copy_only=False)
        self.names = laid.filter(pa.array(new))
        self.id_place = np.empty(self.n, dtype=np.int64)
        self.id_place[order] = np.cumsum(new) - 1
        self._names: np.ndarray | None = None

    def key(self, order: str, km: np.ndarray | None) -> np.ndarray:
        """The sort key, that of a row without the value before or after all others, as the search has it."""
        v = self.numbers
        if order == "newest":
            return np.where(np.isnan(v["listed_at"]), np.inf, -v["listed_at"])
        if order == "featured":
            return (0.0 if km is None else np.where(np.isnan(km), 0.0, km * 0.1)) - np.nan_to_num(v["ai_score"], nan=np.inf)
        column = v["price"] if order.startswith("price") else v["beds_int"]
        key = -column if order.endswith("Desc") else column
        return np.where(np.isnan(key), -np.inf, key) + 0.0

    def id_at_most(self, wanted: list) -> np.ndarray:
        """For each id the place of the last one in the slab that is not above it, or -1."""
        if self._names is None:
            self._names = np.array(self.names.to_pylist(), dtype=object)
        return np.searchsorted(self._names, np.array(wanted, dtype=object), side="right") - 1


class Laid:
    """Rows in one order, from a subset of a slab."""

    def __init__(self, rows: Rows, at: np.ndarray, key: np.ndarray | None, km: np.ndarray | None):
        if key is not None:
            at = at[np.lexsort((rows.id_place[at], key[at]))]
        self.rows, self.at, self.n, self.words = rows, at, len(at), -(-len(at) // 64)
        self.km = None if km is None else km[at]
        self.key = None if key is None else key[at]

    def bits(self, mask: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, dtype=np.uint8)
        filled = np.packbits(mask, bitorder="little")
        packed[: len(filled)] = filled
        return packed.view(np.uint64)

    def up_to(self, keys: np.ndarray, ids: list) -> np.ndarray:
        """How many of the rows are not after each (key, id)."""
        values, ranks = np.unique(self.key, return_inverse=True)
        span = len(self.rows.names) + 1
        laid = ranks * span + self.rows.id_place[self.at]
        place = np.searchsorted(values, keys)
        there = values[np.minimum(place, len(values) - 1)] == keys
        marks = place * span + np.where(there, self.rows.id_at_most(ids), -1)
        return np.searchsorted(laid, marks, side="right")

    def tests(self, asked: pa.Table, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, Callable[[int], np.ndarray | None]]]:
        """(codes of the requests, the mask of a code or None for all rows), one for each test."""
        v = {c: x[self.at] for c, x in self.rows.numbers.items()}
        tests = []

        def between(column: str, least: str, most: str) -> None:
            codes, values = _pairs(_numbers(asked, least), _numbers(asked, most))

            def mask(code: int) -> np.ndarray | None:
                a, b = values[code]
                return None if a == -np.inf and b == np.inf else (v[column] >= a) & (v[column] <= b)

            tests.append((codes, mask))

        def among(coded: tuple[np.ndarray, list], wanted: str, fits: Callable[[object, list], bool]) -> None:
            places, values = coded
            codes, lists = _coded(asked[wanted])

            def mask(code: int) -> np.ndarray | None:
                if lists[code] is None:
                    return None
                allowed = [x for x in json.loads(lists[code]) if x is not None]
                return np.array([x is not None and fits(x, allowed) for x in values])[places[self.at]]

            tests.append((codes, mask))

        between("price", "q_min_price", "q_max_price")
        between("size_sqft", "q_min_area", "q_max_area")
        for wanted, column in SETS.items():
            among(self.rows.coded[column], wanted, lambda x, allowed: x in allowed)
        among(self.rows.coded["property_type"], "q_types", lambda x, allowed: any(t in x for t in allowed))
        for wanted, column in (("q_trusted", "trusted"), ("q_verified", "verified")):
            flag = np.nan_to_num(_numbers(asked, wanted), nan=0.0)
            tests.append((flag.astype(np.int64), lambda code, column=column: v[column] >= code))
        since, codes = np.unique(_numbers(asked, "q_since"), return_inverse=True)
        listed = np.where(np.isnan(v["listed_at"]), -np.inf, v["listed_at"])
        tests.append((codes, lambda code: None if since[code] == -np.inf else listed >= since[code]))
        if self.km is not None:
            steps, far = _pairs(low, high)
            tests.append((steps, lambda code: (self.km > far[code][0]) & (self.km <= far[code][1])))
        return tests

    def met(self, asked: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(requests, their bits) by the batch; requests that ask the same lie together."""
        tests = self.tests(asked, low, high)
        order = np.lexsort([codes for codes, _ in tests])
        kept: list[dict[int, np.ndarray | None]] = [{} for _ in tests]
        every = self.bits(np.ones(self.n, dtype=bool))
        step = max(1, AT_ONCE // (8 * self.words))
        for start in range(0, len(order), step):
            batch = order[start : start + step]
            hits = np.repeat(every[None, :], len(batch), axis=0)
            for (codes, mask), known in zip(tests, kept, strict=True):
                there, which = np.unique(codes[batch], return_inverse=True)
                if len(known) > KEPT:
                    known.clear()
                for code in there:
                    if code not in known:
                        made = mask(code)
                        known[code] = None if made is None else self.bits(made)
                bits = [known[code] for code in there]
                if len(bits) == 1:
                    if bits[0] is not None:
                        hits &= bits[0]
                else:
                    hits &= np.stack([every if b is None else b for b in bits])[which]
            yield batch, hits


class Counted:
    """Bits of several requests with their running counts."""

    def __init__(self, hits: np.ndarray, n: int):
        self.words = hits.shape[1]
        self.hits = hits.ravel()
        self.ones = np.bitwise_count(hits)
        self.sums = np.cumsum(self.ones, axis=1, dtype=np.int64)
        self.total = self.sums[:, -1]
        self.span = n + 1
        self.flat = (self.sums + np.arange(len(hits))[:, None] * self.span).ravel()

    def before(self, end: np.ndarray) -> np.ndarray:
        """How many bits are set among each request's first ``end`` rows."""
        word, rest = np.divmod(end, 64)
        which = np.arange(len(end))
        low = np.where(word > 0, self.sums[which, np.maximum(word - 1, 0)], 0)
        mask = (np.uint64(1) << rest.astype(np.uint64)) - np.uint64(1)
        part = self.hits[which * self.words + np.minimum(word, self.words - 1)] & mask
        return low + np.where(word < self.words, np.bitwise_count(part), 0)

    def nth(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The row of each request's ``place``-th set bit, from 1."""
        found = [np.empty(0, dtype=np.int64)]
        for start in range(0, len(which), FOUND_AT_ONCE):
            w, p = which[start : start + FOUND_AT_ONCE], place[start : start + FOUND_AT_ONCE]
            at = np.searchsorted(self.flat, w * self.span + p)
            word = self.hits[at]
            left = p - (self.flat[at] - w * self.span - np.bitwise_count(word))
            bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = np.argmax(np.cumsum(bits, axis=1, dtype=np.int64) == left[:, None], axis=1)
            found.append((at % self.words) * 64 + inside)
        return np.concatenate(found)


def ladder(total: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, first place, last place) of groups of matches, each twice as long as the one before.

    A group ends at ``upto``, and one more holds all after it, so that a request has few groups however many rows match.
    """
    most = np.minimum(total, upto)
    doublings = (1 << np.arange(1, max(2, int(most.max(initial=1)).bit_length() + 1))) - 1
    ends = np.concatenate(
        [np.where(doublings < most[:, None], doublings, 0), most[:, None], np.where(total > most, total, 0)[:, None]], axis=1
    )
    which, column = np.nonzero(ends)
    last = ends[which, column]
    first = np.ones_like(last)
    same = which[1:] == which[:-1]
    first[1:][same] = last[:-1][same] + 1
    return which, first, last


def passed_places(total: np.ndarray, upto: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The last end of a ``ladder`` group that is at most ``seen``."""
    doubled = (1 << (np.frexp((seen + 1).astype(np.float64))[1].astype(np.int64) - 1)) - 1
    most = np.minimum(total, upto)
    return np.where(seen >= total, total, np.where(seen >= most, most, doubled))


def _arranged(rows: Rows, asked: pa.Table, orders: list[str], sort: bool) -> Iterator[tuple[Laid, np.ndarray]]:
    """Rows laid out for requests of one order and, with a distance, of one middle, and which requests those are."""
    lat, lon, radius = (_numbers(asked, c) for c in ("q_lat", "q_lon", "q_radius"))
    order = asked["q_order"].to_numpy()
    middles, values = _pairs(np.nan_to_num(lat, nan=np.inf), np.nan_to_num(lon, nan=np.inf))
    distant = ~np.isnan(radius)
    everything = np.arange(rows.n)
    for middle in range(-1, len(values)):
        if middle < 0:
            mine, km, at = ~distant, None, everything
        else:
            mine = distant & (middles == middle)
        if not mine.any():
            continue
        if middle >= 0:
            y, x = values[middle]
            km = _km(y, x, rows.numbers["latitude"], rows.numbers["longitude"]) if np.isfinite([y, x]).all() else np.full(rows.n, np.nan)
            at = np.nonzero(km <= radius[mine].max())[0]
        if not len(at):
            continue
        for kind in np.unique(order[mine]) if sort else [0]:
            here = np.nonzero(mine & (order == kind))[0] if sort else np.nonzero(mine)[0]
            yield Laid(rows, at, rows.key(orders[kind - 1], km) if sort else None, km), here


def serve(step: str, orders: list[str], rungs: list[float], asked: pa.Table, table: pa.Table) -> Iterator[dict]:
    """What the slab's rows are to the requests, by the batch.

    ``count``: matches by rung. ``ladder``: the same in groups by place in the request's order, with each group's first
    and last (key, id). ``page``: the matches that a page between two (key, id) needs of this slab.
    """
    if not asked.num_rows or not table.num_rows:
        return
    rows = Rows(table)
    if not rows.n:
        return
    # a request that asks for rungs is one request for each
    stepped = asked["q_rungs"].to_numpy(zero_copy_only=False).astype(bool)
    rung = np.zeros(len(stepped), dtype=np.int32)
    if step == "page":
        rung = asked["page_rung"].to_numpy().astype(np.int32)
    else:
        times = np.where(stepped, len(rungs), 1)
        which = np.repeat(np.arange(len(stepped)), times)
        place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        asked, rung = asked.take(pa.array(which)), np.where(stepped[which], place + 1, 0).astype(np.int32)
    radius = _numbers(asked, "q_radius")
    near, far = np.array([-1.0, -1.0, *rungs[:-1]]), np.array([np.inf, *rungs[:-1], np.inf])
    low, high = near[rung], np.fmin(far[rung], radius)
    high = np.where(np.isnan(high), np.inf, high)
    request, upto = asked["request_id"].to_numpy(), asked["upto"].to_numpy()
    for laid, here in _arranged(rows, asked, orders, step != "count"):
        mine = asked.take(pa.array(here))
        for batch, hits in laid.met(mine, low[here], high[here]):
            ours = here[batch]
            if step == "count":
                n = np.bitwise_count(hits).sum(axis=1, dtype=np.int64)
                some = n > 0
                yield {"request_id": request[ours[some]], "rung": rung[ours[some]], "n": n[some]}
                continue
            counted = Counted(hits, laid.n)
            if step == "ladder":
                who, first, last = ladder(counted.total, upto[ours])
                ends = {"first": counted.nth(who, first), "last": counted.nth(who, last)}
                out = {"request_id": request[ours[who]], "rung": rung[ours[who]], "n": last - first + 1}
                for name, at in ends.items():
                    out[f"{name}_key"] = laid.key[at]
                    out[f"{name}_id"] = rows.names.take(pa.array(rows.id_place[laid.at[at]]))
                yield out
                continue
            part = mine.take(pa.array(batch))

            def seen(end: str, missing: int) -> np.ndarray:
                keys = _numbers(part, f"page_{end}_key")
                there = laid.up_to(np.nan_to_num(keys, nan=0.0, posinf=np.inf, neginf=-np.inf), part[f"page_{end}_id"].fill_null("").to_pylist())
                return counted.before(np.where(np.isnan(keys), missing, there))

            most = upto[ours]
            start = passed_places(counted.total, most, seen("first", 0))
            stop = np.minimum(seen("last", laid.n), start + most - part["passed"].to_numpy())
            length = np.maximum(stop - start, 0)
            who = np.repeat(np.arange(len(ours)), length)
            place = np.arange(len(who)) - np.repeat(np.cumsum(length) - length, length) + start[who] + 1
            ids = rows.id_place[laid.at[counted.nth(who, place)]]
            # an id that comes twice is met with both its rows later
            who, ids = np.divmod(np.unique(who * len(rows.names) + ids), len(rows.names))
            yield {"request_id": request[ours[who]], "property_listing_id": rows.names.take(pa.array(ids))}
