"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key: a hash of the text, then doc_id, then the record's place in the input, so that
equal texts are neighbours and no two keys are equal. Keys are drawn with chances in proportion to size, their
quantiles are splitters, and the splitters cut the keys into ranges, far more than there are shards. The ranges
are measured; those with too many bytes (a large group of copies, an unlucky draw) are sampled again and
subdivided until none is left. The few ranges in which a shard ends are then cut exactly there. What reaches
the driver is DRAWS keys and one line per range, whatever the input; a range is what one task sorts.

The record with b bytes before it belongs to shard floor(b * shards / total), so the bytes of any two shards
differ by less than a record at each end.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import written

SHARDS = 40
#: Ranges per shard, keys drawn for each range, and times the fair share of bytes from which one is subdivided.
RANGES, DRAWS, FULL = 16, 32, 2.0
#: What a record weighs besides its text.
OVERHEAD = 16
KEY = 32


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and OVERHEAD."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _eight_bytes(value: Column) -> Column:
    """A long as bytes in the same order; null comes first."""
    shifted = F.coalesce(value.cast("long").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0))
    return F.unhex(F.lpad(F.hex(shifted), 16, "0"))


def key_of(text: Column, doc_id: Column) -> Column:
    """32 bytes: MD5 of the text, doc_id, place in the input."""
    place = _eight_bytes(F.monotonically_increasing_id())
    return F.concat(F.unhex(F.md5(F.coalesce(text, F.lit("")))), _eight_bytes(doc_id), place)


def _range_column(key: Column, bounds: list[bytes]) -> Column:
    """The number of bounds at or below the key."""
    listed = np.array(bounds, dtype=f"S{KEY}")

    @F.arrow_udf(T.IntegerType())
    def place(key: pa.Array) -> pa.Array:
        keys = np.array(key.to_pylist(), dtype=f"S{KEY}")
        return pa.array(np.searchsorted(listed, keys, side="right").astype(np.int32), type=pa.int32())

    return place(key) if bounds else F.lit(0)


def _drawn(rows: DataFrame, rate: float) -> list[tuple[bytes, int]]:
    """Keys drawn with ``rate`` per byte, with how often they were drawn; the draw follows from the key."""
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.col("size") * F.lit(rate)
    times = F.floor(wanted) + F.when(chance < wanted - F.floor(wanted), 1).otherwise(0)
    return sorted((bytes(r.key), r.times) for r in rows.select("key", times.alias("times")).filter("times > 0").collect())


def _quantiles(drawn: list[tuple[bytes, int]], parts: int) -> list[bytes]:
    """The keys that cut what was drawn into parts of equal weight."""
    if not drawn:
        return []
    ends = np.cumsum([n for _, n in drawn])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts, side="left")
    return sorted({drawn[i][0] for i in at.tolist()})


def _measured(slim: DataFrame, bounds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every range."""
    rows = slim.groupBy(_range_column(F.col("key"), bounds).alias("range")).agg(F.sum("size"), F.count("*")).collect()
    size, many = np.zeros(len(bounds) + 1, dtype=object), np.zeros(len(bounds) + 1, dtype=object)
    for at, s, n in rows:
        size[at], many[at] = s, n
    return size, many


def _fair_ranges(slim: DataFrame, total: int, ranges: int) -> tuple[list[bytes], np.ndarray]:
    """Bounds of ranges none of which has much over its share, and their bytes."""
    bounds = _quantiles(_drawn(slim, ranges * DRAWS / total), ranges)
    fair = total / ranges
    while True:
        size, many = _measured(slim, bounds)
        over = [i for i in range(len(size)) if size[i] > FULL * fair and many[i] > 1]
        if not over:
            return bounds, size
        inside = slim.withColumn("range", _range_column(F.col("key"), bounds)).filter(F.col("range").isin(over))
        weight = sum(size[i] for i in over)
        parts = math.ceil(weight / fair) * 2
        drawn = _drawn(inside, parts * DRAWS / weight)
        fresh: set[bytes] = set()
        for i in over:
            own = [d for d in drawn if bisect_right(bounds, d[0]) == i]
            fresh |= set(_quantiles(own, math.ceil(2 * size[i] / fair)))
        fresh -= set(bounds)
        if not fresh:  # one record outweighs the others of its range
            return bounds, size
        bounds = sorted({*bounds, *fresh})


def _exact_cuts(slim: DataFrame, bounds: list[bytes], size: np.ndarray, total: int, shards: int) -> list[bytes]:
    """The first key of every shard that begins within a range."""
    start = np.concatenate([[0], np.cumsum(size)])
    wanted = [(j, -(-j * total // shards)) for j in range(1, shards)]
    inside = [(i, int(start[i]), c) for i in range(len(size)) for _, c in wanted if start[i] < c < start[i + 1]]
    if not inside:
        return []
    spark = slim.sparkSession
    cuts = spark.createDataFrame(inside, "range int, start long, cut long")
    rows = slim.withColumn("range", _range_column(F.col("key"), bounds)).filter(F.col("range").isin(sorted({i for i, _, _ in inside})))
    before = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    met = placed.join(F.broadcast(cuts), "range").filter(F.col("start") + F.col("before") >= F.col("cut"))
    return [bytes(r.key) for r in met.groupBy("cut").agg(F.min("key").alias("key")).collect()]


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all) of every record with ``size``, ``shard`` (from 0) and ``slot`` (gapless in a shard).

    ``docs`` must give its rows in the same order whenever it is read, as a table does. Null and empty texts
    weigh OVERHEAD alone. Rows that repeat are kept and may be parted. Fewer bytes than shards leave shards
    empty; no rows give no rows. Columns named size, shard or slot are replaced.
    """
    carry = [c for c in carry or docs.columns if c not in ("size", "shard", "slot")]
    keyed = docs.select(*carry, key_of(F.col(text), F.col(doc_id)).alias("__key"), size_of(F.col(text)).alias("__size"))
    slim = written(keyed.select(F.col("__key").alias("key"), F.col("__size").alias("size")), "keys")
    total = slim.agg(F.sum("size")).first()[0]
    if total is None:
        return keyed.select(*carry, F.col("__size").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bounds, size = _fair_ranges(slim, total, shards * RANGES)
    bounds = sorted({*bounds, *_exact_cuts(slim, bounds, size, total, shards)})
    size, many = _measured(slim, bounds)
    before, count = 0, 0
    opened: dict[int, int] = {}
    places = []
    for i in range(len(size)):
        own = min(shards - 1, before * shards // total)
        places.append((i, own, count - opened.setdefault(own, count)))
        before, count = before + size[i], count + many[i]
    found = keyed.sparkSession.createDataFrame(places, "__range int, shard int, base long")
    order = Window.partitionBy("__range").orderBy("__key")
    ranged = keyed.withColumn("__range", _range_column(F.col("__key"), bounds))
    numbered = ranged.withColumn("__rank", F.row_number().over(order))
    return numbered.join(F.broadcast(found), "__range").select(
        *carry, F.col("__size").alias("size"), "shard", (F.col("base") + F.col("__rank") - 1).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its records in the order of their slots."""
    rows = sharded.repartitionByRange(SHARDS * 4, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
