"""Search and recommendation: invariants, skew, brute force on small tables."""

import pytest
from pyspark.sql import functions as F

from hearthspark import schemas
from hearthspark.operators import features, ranker, recommend, search
from hearthspark.plans import catalog
from hearthspark.schemas import conform
from hearthspark.session import written

AS_OF = "2024-01-31 00:00:00"


def skewed_serving(spark):
    """A third of all listings are copies of one, in one place at one price."""
    base = spark.range(3000).select(
        F.col("id").cast("string").alias("property_listing_id"),
        F.when(F.col("id") % 3 == 0, 500000.0).otherwise(100000.0 + F.col("id") * 37 % 900000).alias("price"),
        F.when(F.col("id") % 3 == 0, "marina").otherwise(F.concat(F.lit("place "), (F.col("id") % 7).cast("string"))).alias("location_name"),
        F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id") % 5).cast("double").alias("beds_int"),
        F.when(F.col("id") % 3 == 0, 25.08).otherwise(25.0 + (F.col("id") % 200) * 0.001).alias("latitude"),
        F.when(F.col("id") % 3 == 0, 55.14).otherwise(55.1 + (F.col("id") % 90) * 0.001).alias("longitude"),
        F.lit("apartment").alias("property_type"), F.lit("1").alias("offering_type"),
        (F.col("id") % 11 / 11).alias("trust_score"), F.lit(1000.0).alias("size_sqft"),
    )
    return search.prepare(base)


def requests(spark):
    def near(radius):
        return (25.08, 55.14, radius)

    rows = [
        (1, 1, None, None, None, None, "priceAsc", 1, 7), (2, None, 500000, 500000, None, None, "priceDesc", 3, 10),
        (3, None, None, None, ["Marina"], None, "featured", 1, 20), (4, None, None, None, ["place"], None, "bedroomDesc", 2, 15),
        (5, None, None, None, None, near(2.0), "featured", 1, 25), (6, 2, None, None, ["marina"], None, "newest", 1, 5),
        (7, None, 300000, None, None, near(4000.0), "bedroomAsc", 1, 9), (8, None, None, None, [""], None, "newest", 1, 5),
        (9, None, None, None, None, None, None, 0, 5), (10, None, None, None, None, None, "sideways", 1, 5),
        # pages far down, of all rows, of a hot key, of a distance, and beyond the end
        (11, None, None, None, None, None, "priceAsc", 40, 30), (12, None, 500000, 500000, None, None, "priceDesc", 50, 19),
        (13, None, None, None, None, near(4000.0), "featured", 100, 12), (14, 1, 200000, None, None, None, "bedroomDesc", 400, 5),
        (15, None, None, None, None, None, "priceAsc", 5000, 20),
    ]
    df = spark.createDataFrame(
        rows,
        "request_id long, category_id int, min_price int, max_price int, keywords array<string>,"
        " near_by struct<lat:double,lon:double,radius:double>, sort string, page int, page_limit int",
    )
    return conform(df, schemas.SEARCH_REQUEST, fill_nulls=False)


def brute_force(serving, resolved):
    """Pages and totals, row against row, in plain Python."""
    import math

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    listings, pages, totals = serving.collect(), {}, {}
    for r in resolved.collect():
        pool = []
        for x in listings:
            if r.q_offering and x.offering_type != r.q_offering:
                continue
            if (r.q_min_price and x.price < r.q_min_price) or (r.q_max_price and x.price > r.q_max_price):
                continue
            if r.mode == "text" and r.term not in x.location_name:
                continue
            d = km(r.q_lat, r.q_lon, x.latitude, x.longitude) if r.q_lat is not None else None
            if d is not None and d > r.q_radius:
                continue
            rung = 0 if r.mode != "centroid" else 1 if d <= 1.5 else 2 if d <= 3.5 else 3
            key = {
                "priceAsc": x.price, "priceDesc": -x.price, "bedroomAsc": x.beds_int, "bedroomDesc": -x.beds_int,
                "newest": 0, "featured": round(d, 9) * 0.1 if d is not None else 0,
            }[r.sort]
            pool.append((rung, key, x.property_listing_id))
        pool = sorted(p for p in pool if p[0] == min(q[0] for q in pool))
        totals[r.request_id] = len(pool)
        pages[r.request_id] = [p[2] for p in pool[r.skip : r.upto]]
    return pages, totals


def stage(name, make):
    return written(make(), name)


def test_search_on_hot_data_equals_brute_force(spark):
    serving = skewed_serving(spark)
    index = search.build_index(serving, stage=stage)
    resolved = search.resolve(requests(spark), index, AS_OF)
    pages, totals = brute_force(serving, resolved)
    found = {}
    for r in search.page(requests(spark), index, AS_OF).orderBy("request_id", "position").collect():
        found.setdefault(r.request_id, []).append(r.property_listing_id)
    assert found == {k: v for k, v in pages.items() if v}
    assert {r.request_id: r.total_count for r in search.counts(requests(spark), index, AS_OF).collect()} == totals


def test_search_does_not_depend_on_partitions(spark, ws):
    def pages(parts):
        index = search.build_index(ws.serving().repartition(parts), stage=stage)
        got = search.page(ws.sources.search_requests(), index, AS_OF).select("request_id", "position", "property_listing_id")
        return sorted(map(tuple, got.collect()))

    assert pages(1) == pages(6)


def test_rejected_requests(spark):
    got = {r.request_id: r.reject_reason for r in search.validate(requests(spark)).collect()}
    assert got[9] and got[10] and not any(got[i] for i in (*range(1, 9), *range(11, 16)))


def test_rows_before_a_page_are_counted_not_opened(spark):
    """A page far down opens the rows around it; what the others open does not change."""
    index = search.build_index(skewed_serving(spark), stage=stage)
    resolved = search.resolve(requests(spark), index, AS_OF)
    found = search.match(resolved, index)
    ends = {r.request_id: r for r in found.ends.collect()}
    assert all(r.passed <= 30 * 399 for r in ends.values())
    assert ends[14].passed > 1000 and ends[14].passed <= 399 * 5
    assert ends[15].total_count == 3000 and search.listings(found, index).filter("request_id = 15").count() == 0
    alone = search.match(resolved.filter("request_id < 11"), index)
    several = {r.request_id: r for r in alone.ends.collect()}
    assert several and all(ends[k] == several[k] for k in several)


def test_small_slabs_and_slices_equal_brute_force(spark, monkeypatch):
    """Blocks cut into many slabs, and requests into slices, give the same pages and totals."""
    monkeypatch.setattr(search, "PER_SHARD", 90)
    monkeypatch.setattr(search, "PER_SLICE", 2)
    test_search_on_hot_data_equals_brute_force(spark)


def test_rows_of_equal_key_are_not_all_met(spark, monkeypatch):
    """Where all rows tie in a request's order a page takes rows by their ids, not every row of that key."""
    index = search.build_index(skewed_serving(spark), stage=stage)
    resolved = search.resolve(requests(spark), index, AS_OF).filter("request_id = 6 OR request_id = 2")
    taken = []
    over = search._over_slabs

    def kept(met, index, step):
        out = over(met, index, step)
        if step == "page":
            taken.append(out)
        return out

    monkeypatch.setattr(search, "_over_slabs", kept)
    ends = {r.request_id: r for r in search.match(resolved, index).ends.collect()}
    assert ends[2].total_count == 1000 and search.top_matches(resolved, index).filter("request_id = 2").count() == 30
    assert taken[0].filter("request_id = 2").count() <= 64


def test_elements_that_do_not_fit(spark):
    df = spark.createDataFrame(
        [
            (1, ["35", "x"], [1.0], (25.0, 55.0, 5.0)), (2, ["35", None], [1.5], (25.0, 55.0, 5.0)),
            (3, ["35"], [2.0], (25.0, 55.0, float("nan"))), (4, ["1", "22"], [2.0, None], (25.0, 55.0, 5.0)), (5, None, None, None),
        ],
        "request_id long, property_type_ids array<string>, number_of_bedrooms array<double>, near_by struct<radius:double,lat:double,lon:double>",
    )
    got = {r.request_id: r for r in search.validate(df).collect()}
    assert [got[i].reject_reason for i in range(1, 6)] == [
        "property_type_ids does not fit its type", "number_of_bedrooms does not fit its type", "near_by does not fit its type", None, None
    ]
    assert got[4].property_type_ids == [1, 22] and got[4].near_by.radius == 25.0 and got[4].near_by.lon == 5.0


def test_no_window_above_the_rows(spark, ws):
    """Bounds come from counts by bucket: the only window of a page ranks its rows."""
    index = ws.search_index()
    found = search.match(search.resolve(ws.sources.search_requests(), index, AS_OF), index)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found.parts, found.ends, search.listings(found, index))]
    assert [p.count("Window [") for p in plans] == [0, 0, 1]


def test_no_pair_join_is_a_nested_loop(ws):
    index = ws.search_index()
    resolved = search.resolve(ws.sources.search_requests(), index, AS_OF)
    wishes = ws.sources.rec_requests()
    for df in (
        search.top_matches(resolved, index), search.count_matches(resolved, index),
        recommend.recommend(wishes, ws.recommend_index()),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_the_requested_type(ws):
    wishes = ws.sources.rec_requests().filter("lower(property_type) = 'villa'")
    kinds = recommend.recommend(wishes, ws.recommend_index()).select("property_type").distinct().collect()
    assert [r.property_type for r in kinds] == ["villa"]


def test_all_levels_and_no_match(spark):
    """The smallest sample has too few requests to reach every level."""
    got = catalog.QUERIES["fallback_levels"](spark, "/root/testdata/sf0.01").select("status", "level").distinct().collect()
    assert {r.level for r in got} == {1, 2, 3, 4, None} and "no_match" in {r.status for r in got}


def test_a_long_history_has_no_map(spark, ws):
    """A user with very many category values is compared through rows, and as by hand."""
    rows = ws.model_table().limit(400).withColumn("location_id", F.col("property_listing_id").cast("bigint") + 1_000_000)
    table = rows.unionByName(ws.model_table().join(rows.select("property_listing_id"), "property_listing_id", "left_anti"))
    history = rows.select(F.lit(1).cast("long").alias("user_id"), "property_listing_id")
    index = recommend.build_index(table, stage)
    vectors, weights = recommend.query_vectors(recommend.resolve(_ask(spark, "villa", 1)), index, history, table)
    assert not any("map" in kind for _, kind in [*vectors.dtypes, *weights.dtypes])
    mine = {(r.feature, r.value): r.weight for r in weights.filter("owner = 'user 1'").collect()}
    assert sum(f == "location_id" for f, _ in mine) == 400 and abs(sum(w for (f, _), w in mine.items() if f == "location_id") - 1) < 1e-9
    found = recommend.candidates(_ask(spark, "villa", 1), index, history, table).collect()
    listed = {r.property_listing_id: r for r in recommend.build_index(table, stage).rows.collect()}
    q = vectors.collect()[0]
    for r in found:
        x = listed[r.property_listing_id]
        dot = sum(mine.get((c, x[c]), 0.0) for c in features.CATEGORIES) + sum(x[f"x_{n}"] * q[f"q_{n}"] for n in features.NUMERIC)
        norm = (len(features.CATEGORIES) + sum(x[f"x_{n}"] ** 2 for n in features.NUMERIC)) ** 0.5
        assert abs(r.similarity_score - dot / (norm * q.q_norm)) < 1e-9
    assert found


def test_levels_are_those_of_the_listings(spark, ws):
    """The level of a request, decided on segments and paths, is the smallest level of any listing."""
    asked, index = catalog.all_rec_requests(ws), ws.recommend_index()
    resolved = recommend.resolve(asked)
    asking = recommend._asking(resolved, index)
    got = {r.request_id: r.level for r in recommend.request_levels(asking, index, recommend._places(asking, index)).collect()}
    listed = index.rows.select("offering_type", "property_type", "beds_int", "full_location_path", "price")
    near = asking.join(listed, ["offering_type", "property_type"]).filter("abs(beds_int - want_beds) <= 1")
    level = recommend._level(F.col("price"), F.col("price")).alias("level")
    want = near.select("request_id", level).filter("level IS NOT NULL").groupBy("request_id").agg(F.min("level").alias("level"))
    assert got == {r.request_id: r.level for r in want.collect()} and len(set(got.values())) > 2
    pairs = recommend._leveled_blocks(resolved, index)
    assert pairs.filter("level <= 2 AND beds_int != want_beds").count() == 0


def test_one_level_per_request(ws):
    found = recommend.candidates(catalog.all_rec_requests(ws), ws.recommend_index())
    assert found.groupBy("request_id").agg(F.countDistinct("level").alias("n")).filter("n > 1").count() == 0


def _ask(spark, kind, user):
    return spark.createDataFrame(
        [(1, user, "sale", kind, "")], "request_id long, user_id long, offering_type string, property_type string, location_name string"
    )


@pytest.mark.parametrize("seed,kind", [("luxury", "villa"), ("budget", "apartment")])
def test_history_moves_the_ranking(spark, ws, seed, kind):
    seeds = features.history_seeds(ws.model_table()).filter(F.col("seed") == seed)
    history = seeds.select(F.lit(1).cast("long").alias("user_id"), "property_listing_id")
    index, asked = ws.recommend_index(), _ask(spark, kind, 1)
    mine = recommend.candidates(asked, index, history, ws.model_table())
    plain = recommend.candidates(asked, index)
    labels = recommend.recommend(asked, index, history, ws.model_table()).select("match_reason").distinct().collect()
    assert all(r.match_reason.endswith("(Personalized)") for r in labels) and labels
    price = [d.agg(F.avg("price")).collect()[0][0] for d in (mine, plain)]
    assert mine.count() > 0
    # with fewer than 50 candidates both have all of them
    gain = (price[0] - price[1]) * (1 if seed == "luxury" else -1)
    assert gain > 0 if mine.count() == recommend.NEIGHBOURS else gain > -1e-3


def test_impossible_request_has_a_status_and_no_rows(spark, ws):
    asked = spark.createDataFrame(
        [(1, "sale", "villa", "15 Beds", 100000.0, "non_existent_city"), (2, "sale", "castle", "1", 0.0, "")],
        "request_id long, offering_type string, property_type string, bedrooms string, price double, location_name string",
    )
    index = ws.recommend_index()
    assert {r.request_id: r.status for r in recommend.statuses(asked, index).collect()} == {1: "no_match", 2: "no_inventory"}
    assert recommend.recommend(asked, index).count() == 0


def test_hot_twins_keep_the_smallest_ids(spark, ws):
    """Very many listings with equal features: 50 neighbours are the first 50 ids."""
    one = ws.model_table().filter("property_type = 'villa' AND offering_type = '1' AND price > 0").limit(1)
    copies = one.crossJoin(spark.range(400)).withColumn("property_listing_id", F.format_string("z%04d", "id")).drop("id")
    table = ws.model_table().filter("property_type <> 'villa'").unionByName(copies)
    beds = one.collect()[0].beds_int
    asked = _ask(spark, "villa", None).withColumn("bedrooms", F.lit(str(beds)))
    index = recommend.build_index(table, stage)
    got = [r.property_listing_id for r in recommend.candidates(asked, index).orderBy("nearest").collect()]
    assert got == [f"z{i:04d}" for i in range(50)]
    assert index.rows.filter("property_type = 'villa'").count() == 50


def test_training_scoring_and_saving(ws, tmp_path):
    table = ws.model_table()
    model = ranker.fit(table, ranker.LISTING_FEATURES, ranker.LISTING_RATE, trees=5)
    scored = ranker.probability(table, model)
    low, high = scored.agg(F.min("lead_probability"), F.max("lead_probability")).collect()[0]
    assert 0 <= low < high <= 1 and ranker.auc(scored).collect()[0].auc > 0.5
    ranker.save(model, str(tmp_path / "model"))
    again = ranker.probability(table, ranker.load(str(tmp_path / "model")))
    assert again.exceptAll(scored).count() == 0
    leak_free = [f for f in ranker.LISTING_FEATURES if f != "smart_popularity_score"]
    honest = ranker.fit(table, leak_free, ranker.LISTING_RATE, trees=3)
    assert 0 <= ranker.auc(ranker.probability(table, honest)).collect()[0].auc <= 1
    index = search.build_index(*(lambda t: (t, t["ai_score"]))(ranker.ai_score(ws.serving(), model, AS_OF)), stage=stage)
    page = search.page(ws.sources.search_requests(), index, AS_OF).collect()
    assert page and all(0 <= r.ai_score <= 110 for r in page)
    pool = recommend.recommend(ws.sources.rec_requests(), ws.recommend_index(), n=50)
    best = ranker.rerank(pool, table, model).collect()
    assert best and all(0 <= r.ai_conversion_score <= 1 for r in best)


def test_own_categories_are_counted_without_a_join(ws, monkeypatch):
    index = ws.recommend_index()
    resolved = recommend.resolve(catalog.all_rec_requests(ws))
    vectors, weights = recommend.query_vectors(resolved, index, None, None)
    pairs = written(recommend._leveled_blocks(resolved, index).join(vectors, "request_id"), "pairs")
    key = ["request_id", *recommend.BLOCK, "shared"]
    joined = recommend.with_shared(pairs.drop(*[f"own_{c}" for c in features.CATEGORIES]), weights).select(*key)
    counted = recommend.with_own_shared(pairs).select(*key)
    assert joined.filter("shared > 0").count() > 0
    assert joined.exceptAll(counted).count() == 0 and counted.exceptAll(joined).count() == 0
    monkeypatch.setattr(recommend, "with_shared", None)
    assert recommend.candidates(catalog.all_rec_requests(ws), index).count() > 0
