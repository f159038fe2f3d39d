"""Table schemas and the step that makes a DataFrame fit one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _I, _B, _TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LISTING = _struct(
    ("property_listing_id", _S), ("agent_id", _L), ("key_location", _L), ("property_type", _S),
    ("bedrooms", _S), ("bathrooms", _S), ("property_sqft", _L), ("completion_status", _S),
    ("offering_type", _S), ("furnished_flag", _S), ("start_time", _TS), ("property_serp_score", _L),
    ("is_verified", _B), ("property_title", _S), ("property_listing_status", _S),
)
PRICE = _struct(("web_id", _S), ("pp_price", _D))
LOCATION = _struct(
    ("key_location", _I), ("location_id", _I), ("coordinates_lat", _D), ("coordinates_lon", _D),
    ("location_name_english", _S), ("location_name_primary", _S), ("location_tower_name", _S),
    ("location_path_name_primary", _S),
)
AGENT_SCORE = _struct(("agent_id", _L), ("super_agent_score", _D))
EVENT = _struct(("listing_web_id", _S), ("event_name", _S), ("derived_timestamp", _TS))

SIGNALS = _struct(
    ("property_listing_id", _S), ("impression_count", _L), ("view_count", _L), ("favorite_count", _L),
    ("lead_click_count", _L), ("lead_submission_count", _L),
)

# What the search and ranking jobs read.
SERVING = _struct(
    ("property_listing_id", _S), ("property_title", _S), ("location_name", _S), ("location_id", _S),
    ("price", _D), ("beds_int", _D), ("bath_int", _D), ("size_sqft", _D), ("latitude", _D), ("longitude", _D),
    ("listing_date", _TS), ("trust_score", _D), ("smart_popularity_score", _D), ("quality_score", _D),
    ("view_count", _D), ("property_type", _S), ("offering_type", _S), ("furnished_flag", _S),
    ("completion_status", _S), ("image_url", _S), ("agent_name", _S), ("is_verified", _B),
)
SERVING_DEFAULTS = {
    "price": 0.0, "beds_int": 0.0, "bath_int": 0.0, "size_sqft": 0.0, "trust_score": 0.0,
    "smart_popularity_score": 0.0, "quality_score": 0.0, "view_count": 0.0, "is_verified": False,
}

SEARCH_REQUEST = T.StructType(
    _struct(
        ("request_id", _L), ("category_id", _I), ("min_price", _D), ("max_price", _D), ("min_area", _D),
        ("max_area", _D), ("is_super_agent", _B), ("is_verified", _B), ("furnished", _I),
        ("completion_status", _I), ("listed_within", _L), ("sort", _S), ("page", _L), ("page_limit", _L),
    ).fields
    + [
        T.StructField(name, T.ArrayType(kind), True)
        for name, kind in (
            ("property_type_ids", _I), ("number_of_bedrooms", _I), ("number_of_bathrooms", _I), ("keywords", _S),
        )
    ]
    + [T.StructField("near_by", _struct(("lat", _D), ("lon", _D), ("radius", _D)), True)]
)

REC_REQUEST = _struct(
    ("request_id", _L), ("user_id", _L), ("price", _D), ("size_sqft", _D), ("bedrooms", _S), ("bathrooms", _S),
    ("property_type", _S), ("offering_type", _S), ("location_name", _S), ("location_id", _S),
    ("latitude", _D), ("longitude", _D), ("furnished_flag", _S), ("completion_status", _S),
)
REC_DEFAULTS = {
    "price": 0.0, "size_sqft": 0.0, "bedrooms": "0", "bathrooms": "0", "property_type": "unknown",
    "offering_type": "rent", "location_name": "", "latitude": 0.0, "longitude": 0.0,
    "furnished_flag": "unknown", "completion_status": "unknown",
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None, fill_nulls: bool = True) -> DataFrame:
    """Add the columns that ``df`` lacks, cast the rest, and keep the schema's order.

    A value that does not fit its type becomes null, and with ``fill_nulls``
    nulls take the column's default.  NaN counts as null.
    """
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name not in df.columns:
            columns.append(default.alias(field.name))
            continue
        value = _fitted(F.col(field.name), df.schema[field.name].dataType, field.dataType)
        if fill_nulls and field.name in defaults:
            value = F.coalesce(value, default)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _fitted(value: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """The value in the wanted type, element by element; what does not fit, and NaN, is null."""
    if isinstance(wanted, T.ArrayType) and isinstance(given, T.ArrayType):
        return F.transform(value, lambda x: _fitted(x, given.elementType, wanted.elementType))
    if isinstance(wanted, T.StructType) and isinstance(given, T.StructType):
        parts = [
            (_fitted(value[f.name], given[f.name].dataType, f.dataType) if f.name in given.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if given != wanted:
        value = value.try_cast(wanted)
    return F.when(~F.isnan(value), value) if isinstance(wanted, T.DoubleType) else value


def _unfit(value: Column, given: T.DataType, wanted: T.DataType) -> Column:
    """Whether a value, or anything in it, was given but does not fit the wanted type."""
    if isinstance(wanted, T.ArrayType) and isinstance(given, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: _unfit(x, given.elementType, wanted.elementType)), F.lit(False))
    if isinstance(wanted, T.StructType) and isinstance(given, T.StructType):
        bad = F.lit(False)
        for f in wanted.fields:
            if f.name in given.names:
                bad |= _unfit(value[f.name], given[f.name].dataType, f.dataType)
        return bad
    bad = F.lit(False)
    if given != wanted:
        bad = value.isNotNull() & value.try_cast(wanted).isNull()
        if isinstance(wanted, T.IntegralType) and isinstance(given, T.FractionalType):
            bad |= F.coalesce(value != F.floor(value), F.lit(False))
    if isinstance(given, (T.DoubleType, T.FloatType)):
        bad |= F.coalesce(F.isnan(value), F.lit(False))
    return bad


def misfit(df: DataFrame, schema: T.StructType) -> Column:
    """The first column of the schema whose value was given but does not fit its type, or null.

    Lists are looked at element by element, structs field by field. A fraction
    does not fit a whole number, and NaN fits nothing.
    """
    reasons = [
        F.when(_unfit(F.col(f.name), df.schema[f.name].dataType, f.dataType), f.name)
        for f in schema.fields
        if f.name in df.columns
    ]
    return F.coalesce(*reasons, F.lit(None).cast("string"))
