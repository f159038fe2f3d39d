"""Ranked search against scoring every document, and the bounds of its trees."""

import math
import re
from collections import Counter

import numpy as np
from odd_rows import ODD

from hearthspark.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, best=10):
    """(item_id, rank, doc_id, score) by scoring every document."""

    def cut(text):
        return TERM.findall((text or "").translate(LOW))

    words = [(i, cut(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    tf = [Counter(w) for _, w in words]
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, w), c in zip(words, tf, strict=True):
            m = 100 - 75 + (75 * len(w) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in cut(text)
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, doc, score) for k, (_, _, doc, score) in enumerate(scored[:best])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = [
    (1, "The first document, the FIRST one; it really does"),
    (2, None),
    (3, "   ...  "),
    (4, "größe Größe 中文 字 zebra"),
    (5, "nothing holds thiswordatall"),
    (None, "words two long word"),
    (1, "The first document, the FIRST one; it really does"),
]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_odd_documents_and_items(spark, docs):
    assert found(ranking.search(docs(ODD), items(spark, ITEMS))) == brute(ODD, ITEMS)


def test_blocks_salts_and_small_chunks_change_nothing(spark, docs, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in range(300)]
    text = lambda n: " ".join(words[min(299, int(k))] for k in rng.zipf(1.3, n))
    rows = [(k, text(int(rng.integers(1, 60)))) for k in range(600)] + [(k, "w1 w2 one of many copies w7") for k in range(600, 900)]
    asked = [(k, text(int(rng.integers(1, 25)))) for k in range(40)] + [(40, "w7 copies many")]
    want = brute(rows, asked)
    assert found(ranking.search(docs(rows), items(spark, asked))) == want
    for name, value in (("BLOCK_ITEMS", 9), ("SALTS", 3)):
        monkeypatch.setattr(ranking, name, value)
    assert found(ranking.search(docs(rows), items(spark, asked))) == want
    assert found(ranking.search(docs(rows), items(spark, asked), best=3)) == brute(rows, asked, 3)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    for subspaces in (7, 4096):
        ranking.SUBSPACES, kept = subspaces, ranking.SUBSPACES
        try:
            matrix = (rng.integers(1, 999_000, (500, 60)) * (rng.random((500, 60)) < 0.1)).astype(np.int32)
            tree = ranking.BallTree(matrix)
            assert sorted(tree.rows.tolist()) == list(range(500))
            vectors = (rng.integers(0, 20_000, (30, 60)) * (rng.random((30, 60)) < 0.2)).astype(float)
            exact = matrix.astype(np.int64) @ vectors.astype(np.int64).T
            bounds = tree.bounds(vectors)
            for node in range(len(tree.lo)):
                inside = tree.rows[tree.lo[node] : tree.hi[node]]
                assert (bounds[node] >= exact[inside].max(0)).all()
        finally:
            ranking.SUBSPACES = kept


def test_search_opens_few_leaves_for_a_clear_winner():
    rng = np.random.default_rng(2)
    matrix = np.zeros((2000, 50), dtype=np.int32)
    matrix[np.arange(2000), rng.integers(0, 49, 2000)] = 100_000
    matrix[77, 49] = 900_000
    block = ranking.Block(50, np.array([0, 1]), np.array([49]), np.array([5]), 2000, 2000)
    searcher = ranking.Searcher(block, 1)
    assert searcher.search(matrix, np.arange(2000)) == [(0, 4_500_000, 77)]
    assert searcher.opened == 1 < searcher.leaves


def test_text_ids_clashing_columns_and_no_rows(spark, docs):
    named = docs([(1, "a b"), (2, "b c")]).selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS rank", "2 AS score", "3 AS q")
    asked = items(spark, [(1, "b")]).selectExpr("item_id", "text", "'x' AS doc_id")
    out = ranking.search(named, asked)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.item_id, r["rank"], r.doc_id) for r in out.orderBy("rank").collect()] == [(1, 1, "d1"), (1, 2, "d2")]
    assert ranking.search(docs([]), asked).count() == 0
    assert ranking.search(named, asked.limit(0)).count() == 0
    assert ranking.search(docs([(1, None)]), asked).count() == 0
