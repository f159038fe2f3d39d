"""SimHash, its balls and components against brute force."""

import random

import pytest

import brute
from odd_rows import ODD
from hearthspark.llm import components, hashing, simhash


def test_hash_of_spans():
    import numpy as np
    import xxhash

    pick = random.Random(1)
    buf = bytes(pick.randrange(256) for _ in range(9000))
    start = np.array([pick.randrange(6000) for _ in range(800)])
    size = np.array([pick.choice([0, 1, 3, 4, 7, 8, 31, 32, 33, 64, 100, 1024, 1025, 2500]) for _ in range(800)])
    got = hashing.xxh64_spans(buf, start, size, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(buf[a : a + n], 42) for a, n in zip(start, size, strict=True)]


@pytest.mark.parametrize("most", [5, 17, 300])
def test_segments_have_the_runs_of_the_text(most):
    pick = random.Random(2)
    text = b" ".join(b"w%d" % pick.randrange(10 ** pick.randrange(1, 9)) for _ in range(400))
    parts = [r for p in hashing.segments(text, 3, most) for r in brute.runs(p.split(), 3)]
    assert parts == brute.runs(text.split(), 3)


def flip(x: int, n: int, pick: random.Random) -> int:
    for b in pick.sample(range(64), n):
        x ^= 1 << b
    return x


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def test_links_reach_exactly_three_bits(spark):
    pick = random.Random(5)
    prints = set()
    for _ in range(60):
        x = pick.getrandbits(64)
        prints |= {x} | {flip(x, n, pick) for n in (1, 2, 3, 3, 4, 4, 5)}
    prints = sorted(prints)
    rows = spark.createDataFrame([(signed(x), 0, signed(x)) for x in prints], "node long, view int, fp long")
    links = simhash.star_links(simhash.with_neighbours(rows)).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links)
    want = brute.components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    at = {signed(x): i for i, x in enumerate(prints)}
    pairs = {frozenset((at[r.a], at[r.b])) for r in links}
    got = brute.components(prints, lambda i, j: frozenset((i, j)) in pairs)
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    random.Random(3).shuffle(edges)
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert found == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_on_odd_rows(odd, docs):
    pick = random.Random(8)
    base = [f"w{pick.randrange(500)}" for _ in range(300)]
    more = [(20 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 60, 6)]
    table = odd.unionByName(docs(more)).withColumnRenamed("source", "component_id")
    found = simhash.near_duplicates(table).collect()
    rows = ODD + more
    prints = [brute.simhash(t) for _, t in rows]
    roots = brute.components([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    want = sorted((str(i), f"{prints[k]:016x}", roots[k]) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_deduplicated_keeps_one_of_each_component(odd, docs):
    pick = random.Random(9)
    base = [f"v{pick.randrange(900)}" for _ in range(400)]
    rows = [(30 + k, " ".join(base[: 40 * k] + ["new"] + base[40 * k + 1 :])) for k in range(6)]
    rows += [(50 + k, " ".join(f"z{pick.randrange(900)}" for _ in range(200))) for k in range(5)]
    rows += [(2, "another text of a doc_id that repeats"), (30, rows[0][1]), (None, rows[1][1]), (None, "no id and no copy of it")]
    every = ODD + rows
    prints = [brute.simhash(t) for _, t in every]
    at = brute.components(list(range(len(every))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    groups = {}
    for k, root in at.items():
        groups.setdefault(root, set()).add(every[k])
    kept = [(r.doc_id, r.text) for r in simhash.deduplicated(odd.unionByName(docs(rows))).collect()]
    assert len(kept) == len(groups)
    for members in groups.values():
        (stays,) = [row for row in kept if row in members]
        smallest = min((i for i, _ in members if i is not None), default=None)
        assert stays[0] == smallest
    assert simhash.deduplicated(docs([])).count() == 0
