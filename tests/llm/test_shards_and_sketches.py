"""Shards and sketches against brute force."""

import hashlib
import random

import pytest

from odd_rows import ODD
from hearthspark.llm import sharding, sketches


def big_endian(x: int | None) -> bytes:
    return bytes(8) if x is None else (x + (1 << 63)).to_bytes(8, "big")


@pytest.mark.parametrize(("hot", "shards"), [(0, 40), (400, 40), (400, 3), (0, 1)])
def test_shards_have_near_equal_bytes(docs, hot, shards):
    pick = random.Random(hot)
    rows = [(k, "x" * pick.randrange(200) + str(k)) for k in range(900)] + [(2000 + k, "copy " * 20) for k in range(hot)]
    rows += [(7, "same row")] * 50
    table = docs(rows).withColumnRenamed("source", "slot").cache()
    found = sharding.shard(table, shards).select("doc_id", "text", "size", "shard", "slot", "lang").collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(rows)
    assert all(r.size == len(r.text.encode()) + 16 for r in found)
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    keys = [(hashlib.md5(r.text.encode()).digest(), big_endian(r.doc_id)) for r in order]
    assert keys == sorted(keys)
    total, before, seen = sum(r.size for r in order), 0, {}
    for r in order:
        assert r.shard == min(shards - 1, before * shards // total)
        assert r.slot == seen.setdefault(r.shard, 0)
        seen[r.shard] += 1
        before += r.size


def test_shards_of_odd_rows(odd, docs):
    found = sharding.shard(odd.cache(), 5).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, ODD))
    assert sharding.shard(docs([]), 5).count() == 0


def test_shard_files(spark, docs, tmp_path):
    sharded = sharding.shard(docs([(k, "y" * (k % 50)) for k in range(300)]).cache(), 4)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4


def brute_sketch(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    hashes = {hashlib.md5(r.encode()).hexdigest()[:16] for r in runs}
    return sorted(h for h in hashes if h < "20" or h == min(hashes))


def test_sketches_of_edited_texts(spark, odd, docs, monkeypatch):
    pick = random.Random(2)
    more = [(50 + k, " ".join(f"w{pick.randrange(50)}" for _ in range(pick.randrange(80)))) for k in range(60)]
    found = sketches.fingerprints(odd.unionByName(docs(more))).collect()
    rows = [(i, t or "") for i, t in ODD + more]
    rows.sort(key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((str(i), len(text), edited, brute_sketch(text), brute_sketch(edited), brute_sketch(after)))
    got = [(str(r.doc_id), r.n_chars, r.edited, r.sketch, r.edited_sketch, r.next_sketch) for r in found]
    assert sorted(got) == sorted(want)
    assert sketches.fingerprints(docs([])).count() == 0
    one = sketches.fingerprints(docs([(1, "just one text")])).collect()
    assert one[0].edited == "just one" [:7] + "just o"


def test_merging_and_containment(spark, docs):
    pick = random.Random(3)
    a, b = (" ".join(f"w{pick.randrange(9999)}" for _ in range(900)) for _ in range(2))
    rows = docs([(1, a), (2, b), (3, a + " " + b), (4, "")])
    s = {r.doc_id: r.s for r in rows.select("doc_id", sketches.sketch(rows.text).alias("s")).collect()}
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(s[1], s[2], s[3], s[4])], "a array<string>, b array<string>, c array<string>, d array<string>")
    r = table.select(
        sketches.merged(F.array("a", "b")).alias("m"),
        sketches.containment(F.col("a"), F.col("c")).alias("ac"),
        sketches.containment(F.col("a"), F.col("b")).alias("ab"),
        sketches.containment(F.col("a"), F.col("d")).alias("ad"),
        sketches.containment(F.col("d"), F.col("d")).alias("dd"),
    ).first()
    assert set(r.m) <= set(s[3]) | set(s[1]) and len(set(s[3]) - set(r.m)) <= 4
    assert r.ac == 1.0 and r.ab < 0.1 and r.ad == 0.0 and r.dd == 1.0
