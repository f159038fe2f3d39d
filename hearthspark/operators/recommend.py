"""Recommendations for a table of requests: fallback levels, similarity, final score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.functions import cleaning, codes, geo, scoring
from hearthspark.operators import bounds, features
from hearthspark.schemas import REC_DEFAULTS, REC_REQUEST, conform
from hearthspark.session import written

# Pool size, price slack, radius cut, weights, labels.
NEIGHBOURS = 50
TOP_N = 5
PRICE_SLACK = 1.25
NEARBY_KM = 5.0
WEIGHTS = {"similarity_score": 0.40, "geo_score": 0.30, "pop_score": 0.20, "freshness_score": 0.10}
LABELS = {
    1: "Exact Match", 2: "Nearby (Radius Fallback)", 3: "Similar Layout (+/- 1 Bed)", 4: "Higher Budget Options",
}
PERSONALIZED = " (Personalized)"
LABEL_WIDTH = 40

SEGMENT = ["offering_type", "property_type", "beds_int"]
BLOCK = SEGMENT + ["bath_int", "location_id", "full_location_path", "furnished_flag", "completion_status"]
CELL = BLOCK + ["price_band", "size_band"]
RANGES = ["price", "x_price", "x_size_sqft", "x_beds_int", "x_bath_int"]
SALTS = 8
SLACK = 1e-9
# Similarities are compared in steps of this share when the 50th certain neighbour is looked for.
STEP = 2048
EVERYWHERE = "*"


@dataclass
class RecommendIndex:
    """Listings and their summaries; ``paths`` and ``segments`` are what levels are decided on."""

    rows: DataFrame
    cells: DataFrame
    blocks: DataFrame
    paths: DataFrame
    segments: DataFrame
    scaling: DataFrame
    vocabulary: DataFrame
    max_popularity: DataFrame


Stage = Callable[[str, Callable[[], DataFrame]], DataFrame]


def _inline(_name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return make()


def build_index(model: DataFrame, stage: Stage = _inline) -> RecommendIndex:
    """The tables that every batch of requests reads, made once per model table.

    Listings with equal features are equally similar to any query and tie on
    id, so of such a group only the first 50 ids can be among 50 neighbours.
    Spark applies that limit per partition before it shuffles the group.
    A feature whose column is missing is unknown, or 0, for all listings.
    """
    texts = ["property_type", "offering_type", "location_id", "full_location_path", "furnished_flag", "completion_status"]
    absent = {c: F.lit(None).cast("string") for c in texts if c not in model.columns}
    model = model.withColumns(absent | {c: F.lit(0.0) for c in features.NUMERIC if c not in model.columns})
    scaling = stage("scaling", lambda: features.fit_scaling(model))
    plain = features.with_scaling(
        model.select(
            "property_listing_id",
            *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in texts],
            "location_name", "price", "size_sqft", "beds_int", "bath_int", "latitude", "longitude",
            "freshness_score", "smart_popularity_score",
            bounds.log_band(F.col("price"), 8).alias("price_band"),
            bounds.log_band(F.col("size_sqft"), 4).alias("size_band"),
        ),
        scaling,
    )
    twins = Window.partitionBy(*CELL, "price", "size_sqft").orderBy("property_listing_id")
    rows = stage(
        "rows",
        lambda: plain.withColumn("_twin", F.row_number().over(twins))
        .filter(F.col("_twin") <= NEIGHBOURS)
        .drop("_twin"),
    )
    cells = stage("cells", lambda: bounds.summarise(rows, CELL, RANGES, {}))
    blocks = stage("blocks", lambda: _filed(bounds.roll_up(cells, BLOCK, RANGES, [])))
    paths = stage("paths", lambda: bounds.roll_up(cells, [*SEGMENT, "full_location_path"], ["price"], []))
    segments = stage("segments", lambda: bounds.roll_up(paths, SEGMENT, ["price"], []))
    vocabulary = stage("vocabulary", lambda: features.category_vocabulary(model))
    top = stage("max_popularity", lambda: model.agg(F.max("smart_popularity_score").alias("max_popularity")))
    return RecommendIndex(rows, cells, blocks, paths, segments, scaling, vocabulary, top)


def _filed(blocks: DataFrame) -> DataFrame:
    """Every block under its path and under "any"."""
    keys = F.array(F.concat(F.lit("path:"), F.col("full_location_path")), F.lit(EVERYWHERE))
    return bounds.salted(blocks, BLOCK, SALTS).withColumn("path_key", F.explode(keys))


# --- queries -------------------------------------------------------------------

def resolve(requests: DataFrame) -> DataFrame:
    """Requests with defaults for the fields they lack, cleaned like the listings."""
    df = conform(requests, REC_REQUEST, REC_DEFAULTS, fill_nulls=False)
    df = df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("price", "size_sqft", "latitude", "longitude")}
    )

    def text(name: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(name))), F.lit("unknown"))

    return df.select(
        "request_id",
        "user_id",
        F.col("price").alias("cap"),
        "price",
        "size_sqft",
        cleaning.first_digits(F.col("bedrooms"), 0).alias("beds_int"),
        cleaning.first_digits(F.col("bathrooms"), 1).alias("bath_int"),
        text("property_type").alias("property_type"),
        codes.offering_word(text("offering_type")).alias("offering_type"),
        F.coalesce(F.lower(F.trim("location_name")), F.lit("")).alias("place"),
        "location_id",
        "latitude",
        "longitude",
        cleaning.furnished(text("furnished_flag")).alias("furnished_flag"),
        cleaning.completion(text("completion_status")).alias("completion_status"),
    )


def _entries(*values: Column) -> Column:
    return F.explode(F.array(*values)).alias("entry")


def own_weights(resolved: DataFrame, index: RecommendIndex) -> DataFrame:
    """(owner, feature, value, weight): weight 1 for each known category of a request.

    The offering is no dimension of a request's vector: the request says it in
    words, which the fitted categories do not hold.
    """
    named = [c for c in features.CATEGORIES if c != "offering_type"]
    entries = _entries(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in named])
    return (
        resolved.select(_request_owner().alias("owner"), entries)
        .select("owner", "entry.*")
        .join(index.vocabulary, ["feature", "value"])
        .select("owner", "feature", "value", F.lit(1.0).alias("weight"))
    )


def _request_owner() -> Column:
    return F.concat(F.lit("request "), F.col("request_id").cast("string"))


def _user_owner() -> Column:
    return F.concat(F.lit("user "), F.col("user_id").cast("string"))


def _seen(history: DataFrame, model: DataFrame, scaling: DataFrame) -> DataFrame:
    """The listings of each user's history, each once, with scaled numbers and categories."""
    seen = history.select("user_id", F.col("property_listing_id").cast("string")).distinct()
    listed = features.with_scaling(model, scaling).select(
        "property_listing_id",
        *[f"x_{c}" for c in features.NUMERIC],
        *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in features.CATEGORIES],
    )
    return seen.join(listed, "property_listing_id")


def user_centroids(history: DataFrame, model: DataFrame, scaling: DataFrame) -> DataFrame:
    """(user_id, n, x_...): the mean numbers of each user's listings."""
    return _seen(history, model, scaling).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"x_{c}").alias(f"x_{c}") for c in features.NUMERIC]
    )


def user_shares(history: DataFrame, model: DataFrame, scaling: DataFrame) -> DataFrame:
    """(user_id, feature, value, share): which share of a user's listings has a category value, one row for each."""
    joined = _seen(history, model, scaling)
    entries = _entries(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features.CATEGORIES])
    counted = (
        joined.select("user_id", entries)
        .groupBy("user_id", "entry.feature", "entry.value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    totals = joined.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(totals, "user_id").select("user_id", "feature", "value", (F.col("c") / F.col("n")).alias("share"))


def query_vectors(
    resolved: DataFrame, index: RecommendIndex, history: DataFrame | None, model: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """The vector each request is compared by: its user's centroid if there is one.

    (request_id, personalized, owner, q_..., q_norm, own_...: the categories of a request that
    is compared by its own), and the category weights of
    the owners as rows: (owner, feature, value, weight). An owner is a request or a
    user; the weights of a user are there once, however many requests or categories.
    """
    numbers = [f"x_{c}" for c in features.NUMERIC]
    own = features.with_scaling(resolved, index.scaling).select("request_id", "user_id", _request_owner().alias("owner"), *numbers)
    weights = own_weights(resolved, index)
    if history is None or model is None:
        vectors = own.drop("user_id").withColumn("personalized", F.lit(False))
    else:
        wanted = history.join(resolved.select("user_id").distinct(), "user_id", "left_semi")
        users = user_centroids(wanted, model, index.scaling).select("user_id", F.struct(*numbers).alias("u"))
        shares = user_shares(wanted, model, index.scaling)
        weights = weights.unionAll(shares.select(_user_owner().alias("owner"), "feature", "value", F.col("share").alias("weight")))
        theirs = F.col("u").isNotNull()
        vectors = own.join(users, "user_id", "left").select(
            "request_id",
            F.when(theirs, _user_owner()).otherwise(F.col("owner")).alias("owner"),
            *[F.when(theirs, F.col(f"u.{x}")).otherwise(F.col(x)).alias(x) for x in numbers],
            theirs.alias("personalized"),
        )
    weights = written(weights, "weights")
    of = {c: F.collect_set(F.when(F.col("feature") == c, F.col("value"))).alias(f"own_{c}") for c in features.CATEGORIES}
    named = weights.filter(F.col("owner").startswith("request ")).groupBy("owner").agg(*of.values())
    lengths = weights.groupBy("owner").agg(F.sum(F.col("weight") * F.col("weight")).alias("_squares"))
    squares = sum((F.col(x) * F.col(x) for x in numbers), F.lit(0.0))
    return vectors.join(lengths, "owner", "left").join(named, "owner", "left").select(
        "request_id",
        "personalized",
        "owner",
        *[F.col(f"x_{c}").alias(f"q_{c}") for c in features.NUMERIC],
        F.sqrt(squares + F.coalesce("_squares", F.lit(0.0))).alias("q_norm"),
        *[f"own_{c}" for c in features.CATEGORIES],
    ), weights


# --- candidates ----------------------------------------------------------------

def with_own_shared(pairs: DataFrame) -> DataFrame:
    """Adds ``shared`` to pairs of requests compared by their own categories, each of weight 1: no join is needed."""
    same = {c: F.coalesce(F.array_contains(f"own_{c}", F.col(c)).cast("double"), F.lit(0.0)) for c in features.CATEGORIES}
    shared = sum(same.values(), F.lit(0.0))
    return pairs.withColumn("shared", shared).drop(*[f"own_{c}" for c in features.CATEGORIES])


def with_shared(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds ``shared``: what the categories of a block add to the dot product with its request's vector.

    Blocks meet the weights by owner and category value. All listings of a block have its categories, so cells and
    rows keep the number. The parts are added in one order, so that blocks of equal categories come out equal.
    """
    entries = _entries(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features.CATEGORIES])
    met = pairs.select("request_id", "owner", *BLOCK, entries).select("request_id", "owner", *BLOCK, "entry.*")
    found = met.join(weights, ["owner", "feature", "value"])
    parts = {c: F.max(F.when(F.col("feature") == c, F.col("weight"))) for c in features.CATEGORIES}
    sums = found.groupBy("request_id", *BLOCK).agg(*[F.coalesce(v, F.lit(0.0)).alias(f"_w_{c}") for c, v in parts.items()])
    shared = sum((F.col(f"_w_{c}") for c in features.CATEGORIES), F.lit(0.0))
    sums = sums.select("request_id", *BLOCK, shared.alias("shared"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BLOCK] + [F.col("request_id") == F.col("_request_id")]
    renamed = sums.withColumnsRenamed({c: f"_{c}" for c in [*BLOCK, "request_id"]})
    return (
        pairs.join(renamed, same, "left")
        .drop(*[f"_{c}" for c in BLOCK], "_request_id")
        .withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    )


def _cosine(dot: str, norm: str) -> str:
    return f"CASE WHEN ({norm}) * q_norm > 0 THEN ({dot}) / (({norm}) * q_norm) ELSE 0D END"


def _norm(prefix: str) -> str:
    """Length of a listing's vector: its numbers, and 1 for each category."""
    squares = " + ".join(f"{prefix}{c} * {prefix}{c}" for c in features.NUMERIC)
    return f"sqrt({len(features.CATEGORIES)}D + {squares})"


def similarity() -> Column:
    """Cosine of a listing (x_ columns, categories) and a query (q_ columns, ``shared`` categories)."""
    numbers = " + ".join(f"x_{c} * q_{c}" for c in features.NUMERIC)
    return F.expr(_cosine(f"shared + {numbers}", _norm("x_")))


def with_similarity_bounds(df: DataFrame) -> DataFrame:
    """Adds sim_lo and sim_hi, between which every listing of a summary lies.

    Scaled features are in 0..1, so the norm is smallest at the low ends.
    """
    low, high = (
        " + ".join(f"{pick}(lo_x_{c} * q_{c}, hi_x_{c} * q_{c})" for c in features.NUMERIC)
        for pick in ("least", "greatest")
    )
    parts = df.selectExpr(
        "*", f"shared + {low} AS _dot_lo", f"shared + {high} AS _dot_hi",
        f"{_norm('lo_x_')} AS _short", f"{_norm('hi_x_')} AS _long",
    )
    return parts.selectExpr(
        "*",
        _cosine("_dot_lo", "CASE WHEN _dot_lo >= 0 THEN _long ELSE _short END") + f" - {SLACK}D AS sim_lo",
        _cosine("_dot_hi", "CASE WHEN _dot_hi >= 0 THEN _short ELSE _long END") + f" + {SLACK}D AS sim_hi",
    ).drop("_dot_lo", "_dot_hi", "_short", "_long")


def _level(cheapest: Column, dearest: Column) -> Column:
    """The first level at which something in this price range is in the pool."""
    capped = F.col("cap") > 0
    affordable = F.when(capped, cheapest <= F.col("cap")).otherwise(dearest > 0)
    stretched = capped & (cheapest <= F.col("cap") * PRICE_SLACK)
    same_beds = F.col("beds_int") == F.col("want_beds")
    here = F.contains(F.col("full_location_path"), F.col("place"))
    return (
        F.when(affordable & same_beds & here, 1)
        .when(affordable & same_beds, 2)
        .when(affordable, 3)
        .when(stretched, 4)
    )


def _assess(df: DataFrame) -> DataFrame:
    """For (request, summary) pairs of the request's level: sure, sim_lo, sim_hi."""
    capped = F.col("cap") > 0
    ceiling = F.when(F.col("level") == 4, F.col("cap") * PRICE_SLACK).otherwise(F.col("cap"))
    whole = F.when(capped, F.col("hi_price") <= ceiling).otherwise(F.col("lo_price") > 0)
    return with_similarity_bounds(df.withColumn("sure", whole))


_CARRIED = [
    "request_id", "level", "cap", "want_beds", "place", "personalized", "shared",
    *[f"q_{c}" for c in features.NUMERIC], "q_norm",
]


def _segments(resolved: DataFrame, index: RecommendIndex) -> DataFrame:
    """Requests with the property types they may draw from; none means no inventory."""
    types = index.blocks.select("offering_type", F.col("property_type").alias("has_type")).distinct()
    any_type = F.col("property_type") == "unknown"
    return (
        resolved.join(types, "offering_type")
        .filter(any_type | (F.col("property_type") == F.col("has_type")))
        .drop("property_type")
        .withColumnRenamed("has_type", "property_type")
    )


def _asking(resolved: DataFrame, index: RecommendIndex) -> DataFrame:
    return _segments(resolved, index).select(
        "request_id", "offering_type", "property_type", "cap", "place", F.col("beds_int").alias("want_beds")
    )


def _places(asking: DataFrame, index: RecommendIndex) -> DataFrame:
    """(place, path_key): the paths that contain a place, or all if it is in very many of them, or empty."""
    paths = index.paths.select("full_location_path").distinct()
    places = asking.select("place").distinct()
    found, common = bounds.contains_pairs(paths, "full_location_path", places, "place")
    every = common.unionAll(places.filter("place = ''"))
    return found.select("place", F.concat(F.lit("path:"), F.col("full_location_path")).alias("path_key")).unionAll(
        every.select("place", F.lit(EVERYWHERE).alias("path_key"))
    )


def request_levels(asking: DataFrame, index: RecommendIndex, places: DataFrame) -> DataFrame:
    """(request_id, level): the first level at which a request finds anything, decided on prices by segment and path.

    The cheapest and the dearest listing of a segment tell the levels of any place; those of its paths, which a
    request meets by the paths that contain its place, tell the first level.
    """
    beds = F.explode(F.array(F.col("want_beds") - 1, F.col("want_beds"), F.col("want_beds") + 1))
    nowhere = F.lit(None).cast("string").alias("full_location_path")
    anywhere = asking.withColumn("beds_int", beds).join(index.segments, SEGMENT).select("*", nowhere)
    keyed = index.paths.withColumn(
        "path_key", F.explode(F.array(F.concat(F.lit("path:"), F.col("full_location_path")), F.lit(EVERYWHERE)))
    )
    here = asking.withColumn("beds_int", F.col("want_beds")).join(places, "place").join(keyed, [*SEGMENT, "path_key"])
    level = _level(F.col("lo_price"), F.col("hi_price"))
    return (
        anywhere.select("request_id", level.alias("level"))
        .unionAll(here.select("request_id", level.alias("level")))
        .filter("level IS NOT NULL")
        .groupBy("request_id")
        .agg(F.min("level").alias("level"))
    )


def _leveled_blocks(resolved: DataFrame, index: RecommendIndex) -> DataFrame:
    """Requests with the blocks of their level, the first that has anything; no others are opened."""
    asking = written(_asking(resolved, index), "asking")
    places = written(_places(asking, index), "places")
    levels = request_levels(asking, index, places)
    leveled = asking.join(levels, "request_id")
    wanted = F.col("want_beds")
    beds = F.explode(F.when(F.col("level") <= 2, F.array(wanted)).otherwise(F.array(wanted - 1, wanted, wanted + 1)))
    first = F.col("level") == 1
    meets = leveled.join(places.withColumnRenamed("place", "_place"), first & (F.col("place") == F.col("_place")), "left")
    meets = meets.withColumns({"beds_int": beds, "path_key": F.coalesce("path_key", F.lit(EVERYWHERE))}).drop("_place")
    pairs = bounds.salted_join(meets, index.blocks, [*SEGMENT, "path_key"], SALTS).drop("path_key")
    return pairs.filter(_level(F.col("lo_price"), F.col("hi_price")) == F.col("level"))


def candidates(
    requests: DataFrame,
    index: RecommendIndex,
    history: DataFrame | None = None,
    model: DataFrame | None = None,
) -> DataFrame:
    """The 50 most similar listings of each request's level."""
    resolved = resolve(requests)
    vectors, weights = query_vectors(resolved, index, history, model)
    best, worst = (F.floor(-F.col(c) * STEP) for c in ("sim_hi", "sim_lo"))
    leveled = with_own_shared(_leveled_blocks(resolved, index).join(vectors, "request_id"))
    if history is not None and model is not None:
        leveled = written(leveled, "leveled")
        theirs = with_shared(leveled.filter("personalized").drop("shared"), weights)
        leveled = leveled.filter("NOT personalized").unionByName(theirs)
    blocks = written(_assess(leveled), "blocks")
    blocks = bounds.keep_contenders(blocks, NEIGHBOURS, best, worst)
    cells = blocks.select(*_CARRIED, *BLOCK).join(index.cells, BLOCK)
    cells = written(_assess(cells.filter(_level(F.col("lo_price"), F.col("hi_price")) == F.col("level"))), "cells")
    cells = bounds.keep_contenders(cells, NEIGHBOURS, best, worst)
    rows = (
        cells.select(*_CARRIED, *CELL)
        .join(index.rows, CELL)
        .filter(_level(F.col("price"), F.col("price")) == F.col("level"))
        .withColumn("similarity_score", similarity())
    )
    nearest = Window.partitionBy("request_id").orderBy(F.desc("similarity_score"), "property_listing_id")
    return (
        rows.withColumn("nearest", F.row_number().over(nearest))
        .filter(F.col("nearest") <= NEIGHBOURS)
        .join(
            resolved.select(
                "request_id", F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon")
            ),
            "request_id",
        )
        .select(
            "request_id", "level", "personalized", "nearest", "similarity_score", "from_lat", "from_lon",
            "property_listing_id", "property_type", "price", "beds_int", "location_name", "full_location_path",
            "latitude", "longitude", "smart_popularity_score", "freshness_score",
        )
    )


def final_scores(found: DataFrame, index: RecommendIndex) -> DataFrame:
    """Weigh similarity, distance, popularity and freshness.

    Only the second level penalises distance, and drops what is beyond 5 km
    after the 50 nearest were chosen.
    """
    by_radius = F.col("level") == 2
    km = geo.haversine("from_lat", "from_lon", "latitude", "longitude")
    scored = found.withColumn("dist_km", km).filter(~by_radius | (F.col("dist_km") <= NEARBY_KM))
    scored = scored.withColumns(
        {
            "geo_score": F.when(by_radius, 1 / (F.col("dist_km") + 1)).otherwise(1.0),
            "pop_score": scoring.popularity_share(
                F.col("smart_popularity_score"), index.max_popularity.scalar()
            ),
        }
    )
    total = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    label = F.concat(
        codes.lookup(LABELS, F.col("level")), F.when(F.col("personalized"), PERSONALIZED).otherwise("")
    )
    place = F.substring(F.coalesce("full_location_path", "location_name", F.lit("Unknown")), 1, LABEL_WIDTH)
    return scored.withColumns({"final_score": total, "match_reason": label, "display_location": place})


def top_n(scored: DataFrame, score: str, n: int) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.desc(score), "property_listing_id")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def recommend(
    requests: DataFrame,
    index: RecommendIndex,
    history: DataFrame | None = None,
    model: DataFrame | None = None,
    n: int = TOP_N,
) -> DataFrame:
    """The best ``n`` listings of each request, among its NEIGHBOURS nearest; more cannot be asked for."""
    if n > NEIGHBOURS:
        raise ValueError(f"at most {NEIGHBOURS} listings can be recommended")
    scored = final_scores(candidates(requests, index, history, model), index)
    return top_n(scored, "final_score", n).select(
        "request_id", "position", "property_listing_id", "property_type", "price", "beds_int",
        "match_reason", "final_score", "display_location",
    )


def statuses(requests: DataFrame, index: RecommendIndex) -> DataFrame:
    """(request_id, status, level): ok, no_inventory or no_match."""
    resolved = resolve(requests)
    stocked = _segments(resolved, index).select("request_id").distinct().withColumn("stocked", F.lit(True))
    asking = _asking(resolved, index)
    levels = request_levels(asking, index, _places(asking, index))
    status = (
        F.when(F.col("level").isNotNull(), "ok").when(F.col("stocked"), "no_match").otherwise("no_inventory")
    )
    return (
        resolved.select("request_id")
        .join(stocked, "request_id", "left")
        .join(levels, "request_id", "left")
        .select("request_id", status.alias("status"), "level")
    )
