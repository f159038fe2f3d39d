"""Operators on small tables whose answers are known or worked out by brute force."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark import schemas
from hearthspark.functions import cleaning, codes, geo, scoring
from hearthspark.operators import boosting, bounds, clean, etl, features, profile, quantiles, ranker, recommend, search
from hearthspark.plans.jobs import Workspace
from hearthspark.sources import files

AS_OF = "2024-01-31 00:00:00"
SF_DIR = "/root/testdata/sf0.001"


def column(df, name):
    return [r[name] for r in df.collect()]


def test_number_reads_text_as_pandas_does(spark):
    given = ["1,250", "True", "False", "nan", None, "abc", " 7.5 ", "12d", "3f", "1e3", "-4"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = column(df.select("i", cleaning.number(F.col("v"), T.StringType()).alias("x")).orderBy("i"), "x")
    assert got == [1250.0, 1.0, 0.0, 0.0, 0.0, 0.0, 7.5, 0.0, 0.0, 1000.0, -4.0]


def test_rooms(spark):
    df = spark.createDataFrame(
        [(0, "Studio", "2 Baths"), (1, "3 Beds", None), (2, None, "none"), (3, "10+", "7")],
        "i int, bedrooms string, bathrooms string",
    )
    got = [(r.beds_int, r.bath_int) for r in clean.parse_rooms(df).orderBy("i").collect()]
    assert got == [(0, 2), (3, 1), (0, 1), (10, 7)]


def test_text_and_flags(spark):
    df = spark.createDataFrame(
        [(" Villa ", "1.0", "Yes", "Ready", "False"), (None, "2", None, None, None), ("x", "3.05", "PARTLY", "other", "maybe")],
        "property_type string, offering_type string, furnished_flag string, completion_status string, is_verified string",
    )
    got = [tuple(r) for r in clean.normalize_flags(clean.clean_text(df)).collect()]
    assert got == [
        ("villa", "1", "1", "completed", False), ("unknown", "2", "0", None, False), ("x", "3.05", "partly", "other", False),
    ]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2024-01-02",), ("junk",), (None,)], "listing_date string")
    assert [v is None for v in column(clean.parse_dates(df), "listing_date")] == [False, True, True]


def test_age_is_floored(spark):
    df = spark.createDataFrame(
        [("2024-01-30 00:00:01",), ("2024-01-23 00:00:00",), ("2024-01-31 00:00:01",), (None,)], "d string"
    ).withColumn("listing_date", F.col("d").cast("timestamp_ntz"))
    rows = features.add_freshness(df, AS_OF).withColumn("decay", features.search_freshness(df, AS_OF)).collect()
    assert [r.days_old for r in rows] == [0, 8, -1, None]
    assert [r.freshness_score for r in rows] == [1.0, 0.7, 1.0, 0.1]
    assert rows[2].decay == 1.0 and rows[3].decay == pytest.approx(1 / (1 + 365 / 30))


def test_missing_columns_take_their_fallbacks(spark):
    df = spark.createDataFrame([("1",)], "property_listing_id string")
    row = features.build(df, AS_OF).collect()[0]
    assert (row.freshness_score, row.trust_score, row.quality_score, row.smart_popularity_score) == (0.0, 0.5, 0.0, 0.0)


def test_keep_first_with_one_hot_id(spark):
    rows = [("hot", i % 500 + 1, f"x{i}") for i in range(5000)] + [("hot", 0, "first")] + [(str(i), 0, "y") for i in range(50)]
    df = spark.createDataFrame(rows, "property_listing_id string, ingest_seq int, v string").repartition(8)
    kept = clean.keep_first(df)
    assert kept.count() == 51
    assert kept.filter("property_listing_id = 'hot'").collect()[0].v == "first"
    assert kept._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("few", [10, 10**9])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_quantile_is_exact(spark, monkeypatch, few, p):
    monkeypatch.setattr(quantiles, "_FEW", few)
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(size=4000), np.full(2000, 1.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(8)
    assert quantiles.exact_quantile(df, F.col("v"), p).collect()[0][0] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles.exact_quantile(df, F.col("v"), 0.5).collect()[0][0] is None


def test_auc_agrees_with_the_evaluator(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(s, 2)), int(rng.random() < s)) for s in rng.random(900)]
    df = spark.createDataFrame(rows, "s double, target_is_lead int")
    ours = ranker.auc(df, "s").collect()[0].auc
    assert ours == pytest.approx(ranker.evaluator_auc(df, "s"), abs=1e-9)


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (25.2, 55.3, 25.2, 55.3), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = column(df.select(geo.haversine("a", "b", "c", "d").alias("km")), "km")
    assert got == pytest.approx([np.pi * 6371, 0.0, np.pi * 6371 / 180])


@pytest.mark.parametrize(("most_lat", "most_lon", "most_km", "spread"), [(70, 170, 30, 0.2), (89, 180, 4500, 30.0)])
def test_covering_cells_hold_every_near_point(spark, most_lat, most_lon, most_km, spread):
    """Also far circles, circles over the date line and over a pole."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(3000):
        lat, lon, radius = rng.uniform(-most_lat, most_lat), rng.uniform(-most_lon, most_lon), rng.uniform(0.5, most_km)
        near_lat, near_lon = np.clip(lat + rng.normal(scale=spread), -90, 90), lon + rng.normal(scale=1.5 * spread)
        rows.append((lat, lon, radius, near_lat, (near_lon + 180) % 360 - 180))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "lat double, lon double, r double, plat double, plon double")
    near = df.filter(geo.haversine("lat", "lon", "plat", "plon") <= F.col("r"))
    cells = geo.covering_cells(F.col("lat"), F.col("lon"), F.col("r"))
    filed = F.array(*[geo.grid_cell(F.col("plat"), F.col("plon"), k) for k in range(len(geo.GRIDS))])
    missed = near.filter(~F.arrays_overlap(cells, filed))
    assert near.count() > 100 and missed.count() == 0
    assert df.agg(F.max(F.size(cells))).first()[0] <= geo.MOST_CELLS


def test_distinct_scores_close_together_have_an_exact_area(spark):
    rng = np.random.default_rng(8)
    scores, labels = 0.5 + rng.random(5000) * 1e-3, rng.integers(0, 2, 5000)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, labels)], "s double, target_is_lead int")
    order = scores.argsort().argsort() + 1
    ones = labels == 1
    want = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert ranker.auc(df, "s").first()[0] == pytest.approx(want, abs=1e-12)


def test_histogram_of_equal_prices(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "price double")
    assert [tuple(r) for r in profile.price_histogram(df).collect()] == [(16, 4)]


def test_sampling_nothing(spark):
    assert ranker.sample_interactions(spark.createDataFrame([], "property_listing_id string")).count() == 0


def test_csv_keeps_every_value(spark, tmp_path):
    texts = [" Villa ", "a\nb", "", None, 'q"u"o', "a\r\nb", '"', "\\N", ",x,", "a\rb", '""', "\\", "\t", "# c", "é中"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema).collect()
    assert [r.t for r in sorted(back)] == texts


def test_requests_that_do_not_fit_are_rejected(spark):
    df = spark.createDataFrame(
        [(1, "3000000000", 1.0), (2, "cheap", 1.0), (3, None, 1.5), (4, "", 1.0), (5, None, None)],
        "request_id long, min_price string, page double",
    )
    found = {r.request_id: (r.min_price, r.reject_reason) for r in search.validate(df).collect()}
    assert found[1] == (3e9, None) and found[5] == (None, None)
    assert found[2][1] == found[4][1] == "min_price does not fit its type"
    assert found[3][1] == "page does not fit its type"


def test_models_of_two_dates_are_two_models(spark):
    paths = {Workspace(spark, SF_DIR, day).model_path("listing") for day in ("2024-01-31 00:00:00", "2024-01-15 00:00:00")}
    assert len(paths) == 2


def test_no_more_than_the_neighbours_can_be_asked_for(ws):
    with pytest.raises(ValueError, match="at most"):
        recommend.recommend(ws.sources.rec_requests(), ws.recommend_index(), n=recommend.NEIGHBOURS + 1)


def test_an_index_without_optional_columns(ws):
    table = ws.model_table().drop("location_id", "furnished_flag", "completion_status", "bath_int")
    found = recommend.recommend(ws.sources.rec_requests(), recommend.build_index(table))
    assert found.count() > 0


def test_a_listing_that_cannot_be_scored_falls_back(spark, ws):
    table = ws.serving().limit(20).withColumn("price", F.when(F.col("property_listing_id") > "3", F.col("price")))
    scored = ranker.ai_score(table, ws.listing_model(), ws.as_of)
    fresh = scored.withColumn("half", features.search_freshness(scored, ws.as_of) * 50)
    assert fresh.filter("price IS NULL AND ai_score != half").count() == 0
    assert fresh.filter("price IS NULL").count() > 0


def test_the_etl_inventory_can_be_searched(ws):
    """What the ETL writes is what the search reads."""
    serving = search.prepare(ws.inventory())
    index = search.build_index(serving)
    requests = ws.sources.search_requests()
    counts = {r.request_id: r.total_count for r in search.counts(requests, index, ws.as_of).collect()}
    asked = requests.filter("keywords IS NULL AND near_by IS NULL AND page >= 1").select("request_id").collect()
    assert set(r.request_id for r in asked) <= set(counts)
    assert max(counts.values()) > 0


def test_contains_pairs_is_substring_search(spark, monkeypatch):
    names = ["dubai marina", "marina", "al barsha", "a", "mar", "jumeirah", *[f"marine drive {i}" for i in range(30)]]
    terms = ["mar", "a", "marina", "nowhere", "ba", "dubai marina", "drive 2", "xyz", "rin"]
    monkeypatch.setattr(bounds, "FEW", 5)
    found, others = bounds.contains_pairs(
        spark.createDataFrame([(n,) for n in names], "name string"), "name",
        spark.createDataFrame([(t,) for t in terms], "term string"), "term",
    )
    common = {"a", "ba", "mar", "rin", "drive 2"}
    assert {r.term for r in others.collect()} == common
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(n, t) for n in names for t in terms if t in n and t not in common}


def test_codes(spark):
    df = spark.createDataFrame([(1, [35, 99, 1]), (4, [99]), (9, []), (None, None)], "c int, t array<int>")
    rows = df.select(codes.lookup(codes.OFFERING_BY_CATEGORY, F.col("c")).alias("o"), codes.type_names(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("1", ["villa", "apartment"]), ("3", None), (None, None), (None, None)]


def test_safe_float(spark):
    df = spark.createDataFrame([(1.256,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert column(df.select(scoring.safe_float(F.col("v")).alias("v")), "v") == [1.26, 0.0, 0.0, 0.0]


def test_conform_adds_casts_and_fills(spark):
    df = spark.createDataFrame([("7", "x", float("nan"))], "price string, beds_int string, trust_score double")
    row = schemas.conform(df, schemas.SERVING, schemas.SERVING_DEFAULTS).collect()[0]
    assert (row.price, row.beds_int, row.trust_score, row.is_verified, row.image_url) == (7.0, 0.0, 0.0, False, None)


def test_merge_signals_passes_listings_through(spark):
    listings = spark.createDataFrame([("1",)], "property_listing_id string")
    other = spark.createDataFrame([("1", 2)], "id string, view_count int")
    assert files.merge_signals(listings, other).columns == ["property_listing_id"]
    missing = files.read_optional(lambda: files.read_parquet(spark, "/tmp/no-such-folder-here"))
    assert missing is None and files.merge_signals(listings, missing).count() == 1


def test_empty_tables(spark, ws):
    empty = ws.sources.event().limit(0)
    assert etl.engagement(empty, AS_OF).count() == 0
    assert profile.duplicates(ws.sources.raw_listings().limit(0)).collect()[0][0] == 0


def test_sampling_does_not_depend_on_partitions(spark, ws):
    ids = ws.model_table().select("property_listing_id")
    one, many = (ranker.sample_interactions(ids.repartition(n), 300) for n in (1, 7))
    first = sorted(map(tuple, one.collect()))
    assert len(first) == 300 and first == sorted(map(tuple, many.collect()))
    assert len({r[1] for r in first}) > 200 and 10 < sum(r[2] for r in first) < 60


def test_counted_rows_train_the_model_of_all_rows(spark):
    inputs = ["price", "size_sqft", "beds_int"]
    listed = [(float(100 + 37 * k % 911), float(300 + 53 * k % 701), k % 5) for k in range(120)]
    rows = [(*x, int((k + int(x[0])) % 4 == 0)) for k, x in enumerate(listed * 9)] + [(None, None, 1, 1)] * 5
    train = spark.createDataFrame(rows, "price double, size_sqft double, beds_int int, target_is_lead long")
    few = ranker.counted(train, inputs)
    assert few.count() < train.count() / 3 and few.agg(F.sum(ranker.ROWS)).first()[0] == train.count()
    both = [ranker.fit(train, inputs, 0.1, 5), ranker.fit(few, inputs, 0.1, 5, weight=ranker.ROWS)]
    scored = ranker.probability(ranker.probability(few, both[0], "a"), both[1], "b")
    assert scored.filter("abs(a - b) > 1e-6").count() == 0
    assert scored.select("a").distinct().count() > 5


def test_trees_are_those_of_sparks_learner(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a, b, c = rng.integers(0, 20, 3000), rng.integers(0, 31, 3000), rng.integers(0, 5, 3000)
    lead = rng.random(3000) < 1 / (1 + np.exp(-(0.2 * (a - 10) + 0.1 * (b - 15) * (c - 2))))
    inputs = ["price", "size_sqft", "beds_int"]
    rows = [(float(x), float(y), float(z), int(w)) for x, y, z, w in zip(a, b, c, lead)]
    train = spark.createDataFrame(rows, "price double, size_sqft double, beds_int double, target_is_lead int").repartition(3)
    fitted = []
    for alone, chunk in ((16, 32_768), (1, 400)):
        monkeypatch.setattr(boosting, "ALONE", alone)
        monkeypatch.setattr(boosting, "CHUNK", chunk)
        fitted.append(ranker.fit(train, inputs, 0.1, 12).stages[-1])
    seen = VectorAssembler(inputCols=inputs, outputCol="features").transform(train)
    sparks = GBTClassifier(labelCol="target_is_lead", maxIter=12, stepSize=0.1, maxDepth=5, seed=42).fit(seen)
    want = np.array([r[0] for r in sparks.transform(seen).select(vector_to_array("probability")[1]).collect()])
    for model in fitted:
        got = np.array([r[0] for r in model.transform(seen).select(vector_to_array("probability")[1]).collect()])
        assert np.abs(got - want).max() < 1e-5 and len(set(got)) > 100
        assert np.allclose(model.featureImportances.toArray(), sparks.featureImportances.toArray(), atol=1e-5)
        assert model.treeWeights == sparks.treeWeights and model.getMaxDepth() == 5


def test_bins_take_every_row():
    value, weight = boosting._fewer(np.concatenate([np.zeros(9000), np.arange(1.0, 5001.0)]), np.ones(14000))
    assert len(value) <= 3 * boosting.POINTS and weight.sum() == 14000 and weight[value == 0][0] == 9000 and value[-1] == 5000
    some = boosting.cuts(np.array([0.0, 1.0, 4.0]), np.array([5.0, 1.0, 1.0]), 31)
    assert some.tolist() == [0.5, 2.5]
    many = boosting.cuts(np.arange(1000.0), np.ones(1000), 31)
    assert len(many) == 31 and np.abs(np.diff(many) - 31.25).max() < 1


def test_a_row_that_cannot_be_read_fails_training(spark):
    for row in ((float("nan"), 1), (1.0, None), (1.0, 2)):
        train = spark.createDataFrame([(1.0, 0), (2.0, 1), row], "price double, target_is_lead int")
        with pytest.raises(Exception, match="missing"):
            ranker.fit(train, ["price"], 0.1, 2)


def test_quantiles_of_several_columns_take_two_passes(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = np.floor(rng.lognormal(9, 1, 30000)), rng.integers(1, 40, 30000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None, float("nan")) for x, y in zip(a, b)], "a double, b double, c double, d double").repartition(7)
    narrowed = []
    nth = quantiles.nth_smallest
    monkeypatch.setattr(quantiles, "nth_smallest", lambda *x: narrowed.append(x) or nth(*x))
    for p in (0, 0.05, 0.5, 0.9, 1):
        got = quantiles.exact_quantiles(df, {c: F.col(c) for c in "abcd"}, p)
        assert got == {"a": pytest.approx(np.quantile(a, p), rel=1e-12), "b": np.quantile(b, p), "c": None, "d": None}
    assert not narrowed
    monkeypatch.setattr(quantiles, "_NEAR", 3)
    assert quantiles.exact_quantiles(df, {"a": F.col("a")}, 0.5)["a"] == np.quantile(a, 0.5) and len(narrowed) == 2
