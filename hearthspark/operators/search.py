"""Filtered, geo-aware, sorted and paged search for a table of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark import schemas
from hearthspark.functions import cleaning, codes, geo, scoring
from hearthspark.operators import bounds, features, quantiles, slabs
from hearthspark.schemas import conform
from hearthspark.session import ship, written

# Radius rungs in km, the boost for dear searches, rank per km.
RUNGS_KM = [1.5, 3.5, 10.0]
LUXURY_FROM = 5_000_000
LUXURY_BOOST = 10.0
RANK_PER_KM = 0.1
TRUST_QUANTILE = 0.95
TRUST_FLOOR = 0.1

BLOCK = ["offering_type", "location_name", "grid", "grid_1", "grid_2"]
VARYING = [
    "price", "size_sqft", "beds_int", "listed_at", "ai_score", "bath_int", "furnished_flag", "completion_status", "verified",
    "trusted",
]
RANGES = VARYING + ["latitude", "longitude"]
BLOCK_ID = ["block_a", "block_b"]
FILED = ["offering_key", "place"]
SALTS = 8
EVERYWHERE = "*"
_NEVER_BELOW = float("-inf")
# Rows of a block that one task holds: larger blocks are cut into shards by id. A slab is a shard of a block.
PER_SHARD = 100_000
# Requests that meet a slab in one call: more are dealt over several.
PER_SLICE = 65_536


# --- preparation ---------------------------------------------------------------

def prepare(listings: DataFrame) -> DataFrame:
    """Listings as the search reads them: fixed columns, plain flags, no bad numbers."""
    df = conform(listings, schemas.SERVING, schemas.SERVING_DEFAULTS)
    named = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("offering_type", "location_name")}
    return df.withColumns(
        {
            **named,
            "property_type": F.coalesce(F.lower("property_type"), F.lit("unknown")),
            "furnished_flag": (
                cleaning.furnished(F.col("furnished_flag"))
                if "furnished_flag" in listings.columns
                else F.col("furnished_flag")
            ),
            "completion_status": cleaning.completion(F.col("completion_status")),
        }
    )


def trust_threshold(serving: DataFrame) -> DataFrame:
    """One row: the trust score from which an agent counts as a super agent."""
    cut = quantiles.exact_quantile(serving, F.col("trust_score"), TRUST_QUANTILE, "q")
    usable = F.when(F.col("q") != 0, F.col("q"))
    return cut.select(F.coalesce(usable, F.lit(TRUST_FLOOR)).alias("threshold"))


def location_centroids(serving: DataFrame) -> DataFrame:
    """Mean coordinates per location, over listings that have any."""
    located = serving.filter(F.col("latitude").isNotNull() & (F.col("latitude") != 0))
    return located.groupBy("location_name").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )


@dataclass
class SearchIndex:
    rows: DataFrame
    blocks: DataFrame
    centroids: DataFrame
    threshold: DataFrame

    def names(self) -> DataFrame:
        return self.blocks.select("location_name").distinct()


Stage = Callable[[str, Callable[[], DataFrame]], DataFrame]


def _inline(_name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return make()


def build_index(serving: DataFrame, ai_score: Column | None = None, stage: Stage = _inline) -> SearchIndex:
    """The tables that every batch of requests reads, made once per listing table.

    ``ai_score`` is the listing's own score; without a model it is 0.
    ``stage(name, make)`` may write a table and return it read back.

    A block holds the rows of one offering and location in one grid cell, and one
    with very many rows is split into slabs by id, as many as its size asks for,
    so that no task holds a whole hot block.

    Blocks go by two hashes of their keys: 128 bits, which do not collide in practice.
    """
    threshold = stage("threshold", lambda: trust_threshold(serving))
    micros = F.unix_micros(F.col("listing_date").cast("timestamp")).cast("double")
    plain = serving.select(
        "property_listing_id", "property_title", "image_url", "agent_name",
        "offering_type", "property_type", "location_name", "beds_int", "bath_int",
        F.coalesce("furnished_flag", F.lit("")).alias("furnished_flag"),
        F.coalesce("completion_status", F.lit("")).alias("completion_status"),
        F.col("is_verified").cast("int").alias("verified"),
        (F.col("trust_score") >= threshold.scalar()).cast("int").alias("trusted"),
        "trust_score", "price", "size_sqft", "latitude", "longitude", "listing_date",
        micros.alias("listed_at"),
        (F.lit(0.0) if ai_score is None else ai_score).alias("ai_score"),
        geo.grid_cell(F.col("latitude"), F.col("longitude")).alias("grid"),
        *[geo.grid_cell(F.col("latitude"), F.col("longitude"), k).alias(f"grid_{k}") for k in (1, 2)],
    ).withColumns({"block_a": F.xxhash64(*BLOCK), "block_b": F.xxhash64(F.lit("b"), *BLOCK)})
    large = stage(
        "large", lambda: plain.groupBy(*BLOCK_ID).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > PER_SHARD)
    )
    rows = stage(
        "rows",
        lambda: plain.join(large, BLOCK_ID, "left")
        .withColumn("slab", _slab(F.pmod(F.xxhash64("property_listing_id"), F.coalesce(_shards(F.col("_size")), F.lit(1)))))
        .drop("_size"),
    )
    present = {
        "dated": F.col("listed_at").isNotNull(),
        "located": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
    }
    blocks = stage("blocks", lambda: _filed(_with_reach(bounds.summarise(rows, BLOCK_ID, RANGES, present, BLOCK))))
    centroids = stage("centroids", lambda: location_centroids(serving))
    return SearchIndex(rows, blocks, centroids, threshold)


def _shards(size: Column) -> Column:
    return F.ceil(size / PER_SHARD)


def _slab(shard: Column) -> Column:
    return F.xxhash64(*BLOCK_ID, shard)


def _with_reach(summary: DataFrame) -> DataFrame:
    """The middle of a summary's coordinates, and how far its listings can be from it."""
    lat_span, lon_span = (F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in ("latitude", "longitude"))
    return summary.withColumns(
        {
            "mid_lat": (F.col("lo_latitude") + F.col("hi_latitude")) / 2,
            "mid_lon": (F.col("lo_longitude") + F.col("hi_longitude")) / 2,
            "reach_km": geo.reach(lat_span, lon_span),
        }
    )


def _filed(blocks: DataFrame) -> DataFrame:
    """Every block under each key a request may look it up by, and under "any"."""
    anything = F.lit(EVERYWHERE)
    keys = {
        "offering_key": [F.col("offering_type"), anything],
        "place": [
            F.col("grid"), *[F.col(f"grid_{k}") for k in range(1, len(geo.GRIDS))],
            F.concat(F.lit("name:"), F.lower("location_name")), anything,
        ],
    }
    blocks = bounds.salted(blocks, BLOCK_ID, SALTS)
    for name, values in keys.items():
        blocks = blocks.withColumn(name, F.explode(F.array(*values)))
    return blocks


# --- requests ------------------------------------------------------------------

def validate(requests: DataFrame) -> DataFrame:
    """Requests in their schema, with ``reject_reason``; null means the request is accepted.

    A value that was given but does not fit its type rejects the request: dropping it would drop its filter.
    """
    unfit = schemas.misfit(requests, schemas.SEARCH_REQUEST)
    requests = conform(
        requests.withColumn("unfit", unfit),
        T.StructType([*schemas.SEARCH_REQUEST.fields, T.StructField("unfit", T.StringType())]),
        fill_nulls=False,
    )
    page = F.coalesce("page", F.lit(1))
    limit = F.coalesce("page_limit", F.lit(20))
    reason = (
        F.when(F.col("unfit").isNotNull(), F.concat(F.col("unfit"), F.lit(" does not fit its type")))
        .when(page < 1, "page must be 1 or more")
        .when(limit < 1, "limit must be 1 or more")
        .when(F.col("sort").isNotNull() & ~F.col("sort").isin(*codes.SORTS), "unknown sort")
        .when(
            F.col("near_by").isNotNull()
            & (
                F.col("near_by.lat").isNull() | F.col("near_by.lon").isNull() | F.col("near_by.radius").isNull()
            ),
            "near_by needs lat, lon and radius",
        )
    )
    return requests.withColumn("reject_reason", reason).drop("unfit")


def _set(value: Column) -> Column:
    """Zero means the filter is not set."""
    return F.when(value != 0, value)


def _least(value: Column) -> Column:
    """A lower limit; one that is not set lies below everything, so that the tests need not ask."""
    return F.coalesce(_set(value), F.lit(_NEVER_BELOW))


def _most(value: Column) -> Column:
    return F.coalesce(_set(value), F.lit(-_NEVER_BELOW))


def _listed(value: Column, kind: str) -> Column:
    return F.when(F.size(value) > 0, F.array_distinct(value.cast(f"array<{kind}>")))


def resolve(requests: DataFrame, index: SearchIndex, as_of) -> DataFrame:
    """Accepted requests with their codes, limits and geo step worked out."""
    accepted = validate(requests).filter(F.col("reject_reason").isNull())
    centers = index.centroids.groupBy(F.lower("location_name").alias("term")).agg(
        F.min_by(F.struct("latitude", "longitude"), "location_name").alias("center")
    )
    near = F.col("near_by").isNotNull()
    page, limit = F.coalesce("page", F.lit(1)), F.coalesce("page_limit", F.lit(20))
    now = F.unix_micros(scoring.moment(as_of).cast("timestamp"))
    mode = (
        F.when(near, "near")
        .when(F.col("center").isNotNull(), "centroid")
        .when(F.col("term").isNotNull(), "text")
        .otherwise("none")
    )
    return (
        accepted.withColumn("term", F.lower(F.try_element_at("keywords", F.lit(1))))
        .join(centers, "term", "left")
        .select(
            "request_id",
            mode.alias("mode"),
            "term",
            codes.lookup(codes.OFFERING_BY_CATEGORY, F.col("category_id")).alias("q_offering"),
            codes.type_names(F.col("property_type_ids")).alias("q_types"),
            _least(F.col("min_price")).alias("q_min_price"),
            _most(F.col("max_price")).alias("q_max_price"),
            _least(F.col("min_area")).alias("q_min_area"),
            _most(F.col("max_area")).alias("q_max_area"),
            _listed(F.col("number_of_bedrooms"), "double").alias("q_beds"),
            _listed(F.col("number_of_bathrooms"), "double").alias("q_baths"),
            F.when(F.col("is_super_agent"), 1).alias("q_trusted"),
            F.when(F.col("is_verified"), 1).alias("q_verified"),
            codes.lookup(codes.FURNISHED_BY_CODE, _set(F.col("furnished"))).alias("q_furnished"),
            codes.lookup(codes.COMPLETION_BY_CODE, F.col("completion_status")).alias("q_completion"),
            F.coalesce((now - _set(F.col("listed_within")).cast("bigint") * 1_000_000).cast("double"), F.lit(_NEVER_BELOW)).alias("q_since"),
            F.when(near, F.col("near_by.lat")).otherwise(F.col("center.latitude")).alias("q_lat"),
            F.when(near, F.col("near_by.lon")).otherwise(F.col("center.longitude")).alias("q_lon"),
            F.when(near, F.col("near_by.radius"))
            .when(F.col("center").isNotNull(), RUNGS_KM[-1])
            .alias("q_radius"),
            F.coalesce("sort", F.lit("featured")).alias("sort"),
            # numbers, as they are compared once per pair
            F.array_position(F.array(*[F.lit(name) for name in codes.SORTS]), F.coalesce("sort", F.lit("featured")))
            .cast("int")
            .alias("q_order"),
            (mode == "centroid").alias("q_rungs"),
            page.alias("page"),
            (page.cast("bigint") * limit).alias("upto"),
            ((page - 1).cast("bigint") * limit).alias("skip"),
            F.coalesce(F.col("min_price") >= LUXURY_FROM, F.lit(False)).alias("luxury"),
        )
    )


def without_geo(resolved: DataFrame) -> DataFrame:
    """The same requests before their geo step."""
    nothing = F.lit(None).cast("double")
    return resolved.withColumns(
        {
            "mode": F.lit("none"), "q_rungs": F.lit(False),
            "q_lat": nothing, "q_lon": nothing, "q_radius": nothing,
        }
    )


def _places(resolved: DataFrame, index: SearchIndex) -> DataFrame:
    """Adds the place keys a request must visit: grid cells, matching names or everywhere.

    A text search gets one row per location name that contains its term; a
    term in very many names goes everywhere, with ``q_text`` to test there.
    """
    textual = (F.col("mode") == "text") & (F.length("term") > 0)
    names = index.names().select(F.lower("location_name").alias("name")).distinct()
    terms = resolved.filter(textual).select("term").distinct()
    matches, common = bounds.contains_pairs(names, "name", terms, "term")
    cells = geo.covering_cells(F.col("q_lat"), F.col("q_lon"), F.col("q_radius"))
    everywhere = F.array(F.lit(EVERYWHERE))
    place = (
        F.when(F.col("name").isNotNull(), F.array(F.concat(F.lit("name:"), F.col("name"))))
        .when(F.col("_common").isNotNull(), everywhere)
        .when(
            ~F.coalesce(textual, F.lit(False)),
            F.coalesce(F.when(F.col("q_lat").isNotNull(), cells), everywhere),
        )
    )
    word = F.when(textual, F.col("term"))
    return (
        resolved.join(matches.withColumnRenamed("term", "_term"), word == F.col("_term"), "left")
        .join(common.select(F.col("term").alias("_common")), word == F.col("_common"), "left")
        .withColumns({"place": F.explode(place), "q_text": F.col("_common")})
        .drop("name", "_term", "_common")
    )


# --- matching ------------------------------------------------------------------

def _assess(df: DataFrame, step: str) -> DataFrame:
    """Keep pairs that can match and add, for what lies behind each:

    ``sure`` (all rows match, in one rung), ``rung``/``rung_last`` and
    ``first_key``/``last_key``, the ends of its sort key.
    ``step`` is block or row; on rows both ends are the value itself, so
    the tests are exact.
    """

    def ends(name: str) -> tuple[str, str]:
        if step == "row":
            return name, name
        return f"lo_{name}", f"hi_{name}"

    tests = [
        bounds.within(ends("price"), "q_min_price", "q_max_price"),
        bounds.within(ends("size_sqft"), "q_min_area", "q_max_area"),
        bounds.within(ends("trusted"), "coalesce(q_trusted, 0)"),
        bounds.within(ends("verified"), "coalesce(q_verified, 0)"),
        bounds.within(tuple(f"coalesce({end}, double('-infinity'))" for end in ends("listed_at")), "q_since"),
        bounds.among(ends("beds_int"), "q_beds"),
        bounds.among(ends("bath_int"), "q_baths"),
        bounds.among(ends("furnished_flag"), "q_furnished"),
        bounds.among(ends("completion_status"), "q_completion"),
    ]
    possible = [can for can, _ in tests] + ["(q_radius IS NULL OR near_km <= q_radius)"]
    if step == "row":
        km = F.round(geo.haversine("q_lat", "q_lon", "latitude", "longitude"), 9)
        df = df.withColumn("near_km", km).withColumn("far_km", F.col("near_km"))
        undated = "listed_at IS NULL"
    else:
        df = df.withColumn("_km", geo.haversine("q_lat", "q_lon", "mid_lat", "mid_lon")).selectExpr(
            "*",
            "CASE WHEN _km > reach_km THEN _km - reach_km WHEN _km IS NOT NULL THEN 0D END AS near_km",
            "_km + reach_km AS far_km",
        )
        undated = "n_dated < n"
    can = " AND ".join(possible)
    must = [certain for _, certain in tests] + [
        "q_types IS NULL",
        "(q_radius IS NULL OR far_km <= q_radius)",
        "(q_since = double('-infinity') OR n_dated = n)",
        "(q_lat IS NULL OR n_located = n)",
    ]

    def rung(km: str) -> str:
        steps = f"CASE WHEN {km} <= {RUNGS_KM[0]} THEN 1 WHEN {km} <= {RUNGS_KM[1]} THEN 2 ELSE 3 END"
        return f"CASE WHEN q_rungs THEN {steps} ELSE 0 END"

    price, beds, listed, ai = ends("price"), ends("beds_int"), ends("listed_at"), ends("ai_score")
    never = "double('infinity')"
    keys = {
        "priceAsc": price,
        "priceDesc": (f"-{price[1]}", f"-{price[0]}"),
        "bedroomAsc": beds,
        "bedroomDesc": (f"-{beds[1]}", f"-{beds[0]}"),
        "newest": (f"coalesce(-{listed[1]}, {never})", f"CASE WHEN {undated} THEN {never} ELSE -{listed[0]} END"),
        "featured": tuple(
            f"coalesce({km} * {RANK_PER_KM}D, 0D) - {score}" for km, score in (("near_km", ai[1]), ("far_km", ai[0]))
        ),
    }

    def by_order(end: int) -> str:
        return "CASE q_order " + " ".join(f"WHEN {i} THEN {keys[name][end]}" for i, name in enumerate(codes.SORTS, 1)) + " END"

    sure = "true" if step == "row" else f"coalesce({' AND '.join(must)}, false) AND rung = rung_last"
    tested = bounds.apart(df.filter(can))
    kept = tested.selectExpr("*", f"{rung('near_km')} AS rung", f"{by_order(0)} AS first_key")
    last = "rung AS rung_last", "first_key AS last_key"
    if step != "row":
        last = f"{rung('far_km')} AS rung_last", f"{by_order(1)} AS last_key"
    return kept.selectExpr("*", *last).withColumn("sure", F.expr(sure))


def _carried(resolved: DataFrame) -> list[str]:
    return [c for c in resolved.columns if c not in ("term", "q_offering", "page", "skip", "luxury", "mode")]


def block_pairs(resolved: DataFrame, index: SearchIndex) -> DataFrame:
    """Requests with the blocks that can hold matches.

    Offering and place are equality keys.  A filter that is not set meets the
    copy of each block filed under "any", so one join serves all combinations
    of set and unset filters.
    """
    anything = F.lit(EVERYWHERE)
    asking = _places(resolved, index).withColumns(
        {
            "offering_key": F.coalesce("q_offering", anything),
        }
    )
    pairs = bounds.salted_join(asking, index.blocks, FILED, SALTS)
    worded = F.col("q_text").isNull() | F.contains(F.lower("location_name"), F.col("q_text"))
    return _assess(pairs.filter(worded), "block")


_STATE = ["n", "sure", "rung", "rung_last", "first_key", "last_key"]
_MARK = "struct<key: double, id: string>"
_LISTS = ["q_beds", "q_baths", "q_furnished", "q_completion", "q_types"]
_SERVED = {
    "count": "request_id long, rung int, n long",
    "ladder": "request_id long, rung int, n long, first_key double, first_id string, last_key double, last_id string",
    "page": "request_id long, slab long, property_listing_id string",
}


def _over_slabs(met: DataFrame, index: SearchIndex, step: str) -> DataFrame:
    """Pairs of requests and blocks, taken to the rows: ``slabs.serve`` on every slab of the blocks.

    Requests are dealt to the slabs of their blocks, and in slices where very many meet one, so that a task never holds more
    than a shard of a block and a slice of its requests.
    """
    ship(met.sparkSession)
    partitions = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visits = met.groupBy(*BLOCK_ID).agg(F.ceil(F.count(F.lit(1)) / PER_SLICE).alias("_slices"))
    asking = (
        met.join(visits, BLOCK_ID)
        .withColumns({c: F.to_json(c) for c in _LISTS})
        .withColumn("_slice", F.pmod(F.xxhash64("request_id"), F.col("_slices")))
        .withColumn("slab", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), _shards(F.col("n")) - 1), _slab)))
        .drop(*BLOCK_ID, *[c for c in _STATE if c in met.columns], "_slices")
    )
    rows = (
        index.rows.join(visits, BLOCK_ID)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1)))
        .select("slab", "_slice", "property_listing_id", "property_type", *VARYING, "latitude", "longitude")
    )
    schema = T.StructType.fromDDL(_SERVED[step])
    types = {f.name: _ARROW[f.dataType.simpleString()] for f in schema}
    orders, rungs = list(codes.SORTS), list(RUNGS_KM)

    def serve(key: tuple, asked: pa.Table, listed: pa.Table) -> pa.Table:
        made = [pa.table({c: pa.array([], t) for c, t in types.items()})]
        for out in slabs.serve(step, orders, rungs, asked, listed):
            out["slab"] = pa.repeat(key[0], len(out["request_id"]))
            made.append(pa.table({c: pa.array(out[c], t) for c, t in types.items()}))
        return pa.concat_tables(made).combine_chunks()

    def dealt(df: DataFrame):
        return df.repartition(partitions, "slab", "_slice").groupBy("slab", "_slice")

    return dealt(asking).cogroup(dealt(rows)).applyInArrow(serve, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


@dataclass
class Matches:
    """What matches a batch of requests, and where its pages begin and end.

    ``parts`` are the blocks that can hold matches. ``ends`` has for each request with a match the nearest rung, its total
    count, and what is known of its page: rows whose sort key and id are above ``page_last`` come after it; ``passed``
    rows, all those of groups that end at ``page_first`` or earlier, before it.
    """

    asked: DataFrame
    parts: DataFrame
    ends: DataFrame

    @property
    def counts(self) -> DataFrame:
        return self.ends.select("request_id", "rung", "total_count")


def match(resolved: DataFrame, index: SearchIndex) -> Matches:
    """One way down for counts and pages: blocks, then the rows of their slabs.

    Matches are counted where the rows are read, in groups by their place in the request's order; only the counts and the
    ends of the groups are shuffled.
    """
    asked = written(resolved, "asked")
    parts = written(block_pairs(asked, index).select("request_id", *BLOCK_ID, *_STATE), "parts")
    counted = written(_over_slabs(_with_request(parts, asked), index, "ladder"), "counted")
    return Matches(asked, parts, written(_ends(asked, counted), "ends"))


def _with_request(parts: DataFrame, asked: DataFrame) -> DataFrame:
    return bounds.by_request(parts).join(asked.select(_carried(asked)), "request_id")


def _ends(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(request_id, rung, total_count, page_first, page_last, passed) from counts of groups between two marks.

    A mark is a sort key and an id. What is gathered for a request is one entry for each group's end, a few for a slab.
    Up to a mark lie at least the ``certain`` rows, whose group ends there or before, and at most the ``possible`` ones,
    whose group begins there or before.
    """
    nothing = F.lit(0).cast("bigint")
    first, last = (F.struct(F.col(f"{end}_key").alias("key"), F.col(f"{end}_id").alias("id")) for end in ("first", "last"))
    sides = F.array(
        F.struct(last.alias("mark"), F.col("n").alias("certain"), nothing.alias("possible")),
        F.struct(first.alias("mark"), nothing.alias("certain"), F.col("n").alias("possible")),
    )
    entries = (
        counted.select("request_id", "rung", F.explode(sides).alias("side"))
        .groupBy("request_id", "rung", "side.mark")
        .agg(F.sum("side.certain").alias("certain"), F.sum("side.possible").alias("possible"))
    )
    steps = entries.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("rung", "mark", "certain", "possible"))).alias("every")
    )
    nearest = steps.select("request_id", F.expr("every[0].rung AS rung"), F.expr("filter(every, s -> s.rung = every[0].rung) AS steps"))
    start = f"named_struct('sum', 0L, 'at', CAST(NULL AS {_MARK}))"
    after = (
        f"aggregate(steps, {start}, (a, s) -> named_struct('sum', a.sum + s.certain,"
        " 'at', CASE WHEN a.at IS NULL AND a.sum + s.certain >= upto THEN s.mark ELSE a.at END)).at"
    )
    before = (
        f"aggregate(steps, {start}, (a, s) -> named_struct('sum', a.sum + s.possible,"
        " 'at', CASE WHEN a.sum + s.possible <= skip THEN s.mark ELSE a.at END)).at"
    )
    total = "aggregate(steps, 0L, (a, s) -> a + s.certain)"
    passed = "aggregate(steps, 0L, (a, s) -> CASE WHEN s.mark <= page_first THEN a + s.certain ELSE a END)"
    return (
        nearest.join(asked.select("request_id", "upto", "skip"), "request_id")
        .withColumns({"page_last": F.expr(after), "page_first": F.expr(before), "total_count": F.expr(total)})
        .withColumn("passed", F.expr(passed))
        .select("request_id", "rung", "total_count", "page_first", "page_last", "passed")
    )


def count_matches(resolved: DataFrame, index: SearchIndex) -> DataFrame:
    """(request_id, rung, total_count) of requests with at least one match.

    Only the nearest rung with a match counts. A block that matches as a whole is counted from its summary.
    """
    asked = written(resolved, "asked")
    parts = written(block_pairs(asked, index).select("request_id", *BLOCK_ID, *_STATE), "parts")
    met = _with_request(parts, asked)
    whole = met.filter("sure").select("request_id", "rung", "n")
    counted = whole.unionByName(_over_slabs(met.filter("NOT sure"), index, "count"))
    rungs = counted.groupBy("request_id", "rung").agg(F.sum("n").alias("n"))
    nearest = rungs.groupBy("request_id").agg(F.min(F.struct("rung", "n")).alias("nearest"))
    return nearest.join(asked.select("request_id"), "request_id").select(
        "request_id", "nearest.rung", F.col("nearest.n").alias("total_count")
    )


def top_matches(resolved: DataFrame, index: SearchIndex) -> DataFrame:
    """The first ``upto`` listings of each request in its order, with ``position``."""
    return listings(match(resolved.withColumn("skip", F.lit(0).cast("bigint")), index), index)


def listings(found: Matches, index: SearchIndex) -> DataFrame:
    """The rows of the pages, with their ``position`` in the request's order.

    Blocks outside the page's keys are dropped; of the others' slabs only the rows between the page's marks are taken, and
    no more of a slab than the page can hold. Only those are met with the columns that are shown.
    """
    ends = found.ends.withColumnsRenamed({"rung": "page_rung"}).filter("total_count > passed").drop("total_count")
    asked = found.asked.select(*_carried(found.asked), "skip").join(ends, "request_id")
    outside = (F.col("first_key") > F.col("page_last.key")) | (F.col("last_key") < F.col("page_first.key"))
    parts = (
        bounds.by_request(found.parts)
        .join(asked, "request_id")
        .filter(F.col("page_rung").between(F.col("rung"), F.col("rung_last")) & ~F.coalesce(outside, F.lit(False)))
    )
    marks = {f"page_{end}_{of}": F.col(f"page_{end}.{of}") for end in ("first", "last") for of in ("key", "id")}
    picked = _over_slabs(parts.withColumns(marks).drop("page_first", "page_last"), index, "page")
    shown = index.rows.select(
        "slab", "property_listing_id", "property_title", "location_name", "property_type", "offering_type", "size_sqft",
        "price", "beds_int", "bath_int", "latitude", "longitude", "listing_date", "trusted", "trust_score", "image_url",
        "agent_name", "ai_score", "furnished_flag", "completion_status", "verified", "listed_at",
    )
    met = picked.join(shown, ["slab", "property_listing_id"]).join(asked, "request_id")
    order = Window.partitionBy("request_id").orderBy("first_key", "property_listing_id")
    return (
        _assess(met, "row")
        .withColumn("position", (F.row_number().over(order) + F.col("passed")).cast("int"))
        .filter(F.col("position").between(F.col("skip") + 1, F.col("upto")))
        .select(
            "request_id", "position", "rung", F.col("near_km").alias("dist_km"), "property_listing_id", "property_title",
            "location_name", "property_type", "offering_type", "price", "size_sqft", "beds_int", "bath_int", "latitude",
            "longitude", "listing_date", "trusted", "trust_score", "image_url", "agent_name", "ai_score",
        )
    )


def has_match(resolved: DataFrame, index: SearchIndex) -> DataFrame:
    """(request_id) of requests that at least one listing matches: a sure block decides, the others are opened."""
    asked = written(resolved, "asked")
    parts = written(block_pairs(asked, index).select("request_id", *BLOCK_ID, *_STATE), "parts")
    decided = parts.filter("sure").select("request_id").distinct()
    left = _with_request(parts.join(decided, "request_id", "left_anti"), asked)
    return decided.unionAll(_over_slabs(left, index, "count").select("request_id").distinct())


# --- results -------------------------------------------------------------------

def counts(requests: DataFrame, index: SearchIndex, as_of) -> DataFrame:
    """Total hits of every accepted request, 0 included."""
    resolved = resolve(requests, index, as_of)
    return resolved.select("request_id").join(count_matches(resolved, index), "request_id", "left").select(
        "request_id", F.coalesce("total_count", F.lit(0).cast("bigint")).alias("total_count")
    )


def filtered_counts(requests: DataFrame, index: SearchIndex, as_of) -> DataFrame:
    """Hits of the plain filters, before any geo step."""
    resolved = without_geo(resolve(requests, index, as_of))
    return resolved.select("request_id").join(count_matches(resolved, index), "request_id", "left").select(
        "request_id", F.coalesce("total_count", F.lit(0).cast("bigint")).alias("filtered_count")
    )


def _label(dated: bool) -> Column:
    steps = (
        F.when(F.col("mode") == "near", F.concat(F.lit("geo_radius_"), F.col("q_radius").cast("string"), F.lit("km")))
        .when(~F.col("filtered") | (F.col("mode") == "none"), F.concat(
            F.lit("filters_only"), F.when(F.col("q_trusted").isNotNull(), "_trusted").otherwise("")))
        .when(F.col("mode") == "text", "text_match")
        .when(F.col("rung") == 1, "exact_radius_1.5km")
        .when(F.col("rung") == 2, "nearby_radius_3.5km")
        .otherwise("wider_radius_10km")
    )
    order = (
        F.when(F.col("sort") == "priceAsc", "_sort_price_low")
        .when(F.col("sort") == "priceDesc", "_sort_price_high")
        .when(F.col("sort") == "bedroomAsc", "_sort_beds_least")
        .when(F.col("sort") == "bedroomDesc", "_sort_beds_most")
        .when((F.col("sort") == "newest") & F.lit(dated), "_sort_newest")
        .otherwise("")
    )
    found = F.col("total_count") > 0
    suffix = F.concat(F.when(F.col("luxury"), "_luxury").otherwise(""), order)
    return F.concat(steps, F.when(found, suffix).otherwise(""))


def meta(requests: DataFrame, index: SearchIndex, as_of, dated: bool = True) -> DataFrame:
    """(request_id, total_count, page, search_method) of every accepted request."""
    asked = written(resolve(requests, index, as_of), "asked")
    return _meta(asked, count_matches(asked, index), index, dated)


def _meta(asked: DataFrame, found: DataFrame, index: SearchIndex, dated: bool = True) -> DataFrame:
    """A keyword search without hits is labelled by whether its plain filters
    left anything; only those requests go down a second time."""
    hits = asked.join(found, "request_id", "left")
    keyword = F.col("mode").isin("centroid", "text")
    unsure = without_geo(hits.filter(keyword & F.col("total_count").isNull()).select(*asked.columns))
    before = has_match(unsure, index).withColumn("had_rows", F.lit(True))
    return (
        hits.join(before, "request_id", "left")
        .withColumn("filtered", F.col("total_count").isNotNull() | F.coalesce("had_rows", F.lit(False)))
        .withColumn("total_count", F.coalesce("total_count", F.lit(0).cast("bigint")))
        .select("request_id", "total_count", "page", _label(dated).alias("search_method"))
    )


def page(requests: DataFrame, index: SearchIndex, as_of) -> DataFrame:
    """The listings of each request's page, in order."""
    return _page(match(resolve(requests, index, as_of), index), index)


def _page(found: Matches, index: SearchIndex) -> DataFrame:
    score = F.col("ai_score") + F.when(F.col("luxury"), LUXURY_BOOST).otherwise(0.0)
    return (
        listings(found, index)
        .join(found.asked.select("request_id", "luxury"), "request_id")
        .withColumn("ai_score", score)
        .withColumn(
            "final_rank", F.col("ai_score") - F.coalesce(F.col("dist_km"), F.lit(0.0)) * RANK_PER_KM
        )
        .drop("luxury")
    )


def search(requests: DataFrame, index: SearchIndex, as_of) -> DataFrame:
    """Pages with their request's total count and search method."""
    found = match(resolve(requests, index, as_of), index)
    return _page(found, index).join(_meta(found.asked, found.counts, index), "request_id")


def response(results: DataFrame, index: SearchIndex, as_of, image_url: str = codes.DEFAULT_IMAGE) -> DataFrame:
    """Search results in the shape that is sent back, one row per listing."""
    shown = scoring.safe_float
    rent = F.col("offering_type") == "2"
    fresh = features.search_freshness(results, as_of)
    image = F.when(F.length("image_url") > 0, F.col("image_url")).otherwise(F.lit(image_url))
    distance = F.concat(F.lit("dist: "), shown(F.coalesce("dist_km", F.lit(0.0))).cast("string"), F.lit("km"))
    return results.withColumn("_threshold", index.threshold.scalar()).select(
        "request_id",
        "position",
        F.struct("total_count", "page", "search_method").alias("meta"),
        F.struct(
            F.col("property_listing_id").alias("id"),
            F.coalesce("property_title", F.lit(codes.DEFAULT_TITLE)).alias("title"),
            F.struct(
                F.coalesce("location_name", F.lit("Unknown")).alias("name"),
                shown(F.col("latitude")).alias("lat"),
                shown(F.col("longitude")).alias("lon"),
            ).alias("location"),
            F.struct(
                shown(F.col("price")).alias("value"),
                F.lit(codes.CURRENCY).alias("currency"),
                F.when(rent, "rent").otherwise("sell").alias("period"),
            ).alias("price"),
            F.struct(shown(F.col("beds_int")).cast("int").alias("value")).alias("bedrooms"),
            F.array(F.struct(image.alias("medium"))).alias("images"),
            F.array(F.col("search_method"), distance).alias("tags"),
            F.struct(
                shown(F.col("ai_score"), 1).alias("ai_match_percentage"),
                F.when(fresh >= 0.7, "Active").otherwise("Standard").alias("freshness_boost"),
            ).alias("scores"),
            F.struct(
                F.coalesce("agent_name", F.lit(codes.DEFAULT_AGENT)).alias("name"),
                (shown(F.col("trust_score")) >= F.col("_threshold")).alias("is_super_agent"),
            ).alias("agent"),
        ).alias("property"),
    )


def response_json(responses: DataFrame) -> DataFrame:
    return responses.select("request_id", "position", F.to_json("meta").alias("meta"), F.to_json("property").alias("property"))
