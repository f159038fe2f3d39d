"""Learned operators: odd rows, missing classes, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_rows import ODD
from hearthspark.llm import languages, quality, toxicity

SF_DIR = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = languages.fit(docs)
    found = languages.predict(docs, model).withColumn("held", languages.fold(docs.doc_id) == 2).toPandas()
    held = found[found.held]
    assert len(held) > 200
    assert (held.lang == held.nearest).mean() > 0.97
    assert found.score.between(0, 1).all()
    rows = languages.predict(odd.withColumnRenamed("source", "score"), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        blank = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.nearest == "und") == blank
        assert r.language in (r.nearest, "und")
    strange = [r for r in rows if r.doc_id == 10]
    assert strange[0].rejected


def test_language_without_labels(docs, odd):
    model = languages.fit(docs(ODD, lang=None))
    assert {r.nearest for r in languages.predict(odd, model).collect()} == {"und"}
    assert languages.predict(docs([]), languages.fit(docs([]))).count() == 0


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held", toxicity.fold(F.col("doc_id")) == 0)
    held = found.select("toxicity", "toxic", "held").toPandas()
    assert held.toxicity.between(0, 1).all()
    held = held[held.held]
    order = held.toxicity.rank().to_numpy()
    ones = held.toxic.to_numpy() == 1
    auc = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.9
    assert ((held.toxicity >= 0.5) == ones).mean() > 0.94


def test_toxicity_learns_rare_words(spark, docs):
    pick = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        words = [f"w{chr(97 + pick.randrange(26))}{chr(97 + pick.randrange(26))}" for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            words[pick.randrange(40)] = "grubak" + chr(97 + pick.randrange(26))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    labels += [(5000, 1), (None, 1), (3, None)]
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    tests = [(1, "wab wcd grubakz wef"), (2, "wab wcd wef wgh"), *((i, t) for i, t in ODD)]
    score = {(r.doc_id, r.text): r.toxicity for r in toxicity.score(docs(tests), model).collect()}
    assert score[1, tests[0][1]] > 0.5 > score[2, tests[1][1]]
    assert all(0 <= s <= 1 for s in score.values())


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_toxicity_with_one_class(spark, docs, odd, toxic):
    labels = spark.createDataFrame([(i, toxic) for i in range(12)], "doc_id long, toxic int")
    scores = {r.toxicity for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert toxicity.score(docs([]), toxicity.fit(docs([]), labels)).count() == 0


def test_shared_estimates_are_kneser_ney(docs):
    """The shared estimates after each context add up to one less what is left for unseen bytes."""
    grams = toxicity.gather(docs([(k, f"aba abc cab bca {k % 7}") for k in range(30)]).withColumnRenamed("n_chars", "label"), "text", "label")
    shared = toxicity.shared_estimates(grams).toPandas()
    size = toxicity.SHORTER[0]
    assert (shared.shared > 0).all()
    assert (shared.groupby(shared.key.to_numpy() >> 8).shared.sum() <= 1 + 1e-9).all()
    keys, _, _ = toxicity.ngrams([b"aba abc cab bca 1"])
    assert set(np.unique(keys & ((1 << 8 * size) - 1)).tolist()) <= set(shared.key)


def test_language_model_knows_nothing_of_other_rows(docs):
    """Held-out documents, and those without a language, have no part in frequencies or centroids."""
    kept = [(k, f"ein satz mit worten {k} und mehr davon") for k in range(300) if zlib.crc32(str(k).encode()) % 4 != 2]
    held = [(k, "x") for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    first = languages.fit(docs(kept, "de"))
    other = docs([(i, "quite another text with other letters") for i, _ in held], "de").unionByName(
        docs([(9000 + k, "no language was given here") for k in range(50)], None)
    )
    second = languages.fit(docs(kept, "de").unionByName(other))
    assert first.languages == second.languages == ["de"]
    assert (first.idf == second.idf).all()
    assert first.centroids.shape == second.centroids.shape and np.allclose(first.centroids, second.centroids)


def test_quality_of_held_out_documents(spark, odd):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit(docs, labels)
    found = quality.resample(docs, model).withColumn("held", quality.fold(F.col("doc_id")) == 0).join(labels, "doc_id").toPandas()
    held = found[found.held]
    good = held.quality.to_numpy() == 1
    order = held.log_weight.rank().to_numpy()
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95
    every = quality.resample(docs, model).toPandas()
    k = round(len(every) * quality.SHARE)
    assert every.selected.sum() == k
    assert every[every.selected].noisy_weight.min() > every[~every.selected].noisy_weight.max()
    rows = quality.resample(odd.withColumnRenamed("source", "selected"), model).collect()
    assert len(rows) == len(ODD)
    assert all(r.log_weight == 0 for r in rows if r.doc_id in (3, 4, 5))


def test_quality_without_target(spark, docs, odd):
    model = quality.fit(odd, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert {r.log_weight for r in quality.weigh(odd, model).collect()} == {0.0}
    assert quality.resample(docs([]), model).count() == 0


@pytest.mark.parametrize("k", [1, 7, 2500, 5000])
def test_kth_largest(spark, monkeypatch, k):
    monkeypatch.setattr(quality, "FEW", 10)
    pick = random.Random(6)
    values = [pick.gauss(0, 1) * 10 ** pick.randrange(-6, 7) for _ in range(3000)] + [1.5] * 2000
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]


def test_every_ratio_is_kept():
    pick = np.random.default_rng(7)
    keys = np.unique(pick.integers(1, 1 << 62, 200_000))
    held, ratio = toxicity.Table(keys, np.arange(len(keys), dtype=np.float32)).look(np.concatenate([keys, keys + 1]))
    assert held[: len(keys)].all() and (ratio[: len(keys)] == np.arange(len(keys))).all()
    assert (held[len(keys) :] == np.isin(keys + 1, keys)).all()


def test_ratios_that_are_not_sent_give_the_same_scores(spark, odd, docs, monkeypatch):
    pick = random.Random(12)
    rows = [(100 + k, " ".join(f"w{pick.randrange(90)}" for _ in range(30)) + (" Vile, v1le!" if k % 3 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(i, int("Vile" in t)) for i, t in rows], "doc_id long, toxic int")
    table = odd.unionByName(docs(rows))
    sent = toxicity.fit(table, labels)
    monkeypatch.setattr(toxicity, "SENT_RATIOS", 0)
    joined = toxicity.fit(table, labels)
    assert isinstance(joined.ratios, tuple) and not isinstance(sent.ratios, tuple)
    got, want = (
        sorted((str(r.doc_id), str(r.text), r.toxicity) for r in toxicity.score(table, m).collect()) for m in (joined, sent)
    )
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(got) == table.count()
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)
