"""Summaries of groups of rows, and top-k pruning with them.

Search and recommendation compare many requests with many listings.  Pairing
them row by row would grow with requests x listings, so both work down a
ladder of summaries: blocks (few), cells (more), rows.  A summary holds the
row count and the smallest and largest value of each column that a request
may test.  For a (request, summary) pair that tells whether no row, every row
or some row can match:

* no row: the pair is dropped;
* every row: its count is final, and its worst rank bounds the request's top k;
* some rows: the pair goes one step down.

Rows are only reached through pairs that need them, and always by equality on
the summary's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(
    df: DataFrame, keys: list[str], ranges: list[str], present: dict[str, Column], constants: list[str] = ()
) -> DataFrame:
    """Per key: n, lo_/hi_ of each range column, and how many rows have a value.

    ``constants`` have one value per key and are kept under their own names.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(has).alias(f"n_{name}") for name, has in present.items()],
        *[F.min(c).alias(f"lo_{c}") for c in ranges],
        *[F.max(c).alias(f"hi_{c}") for c in ranges],
        *[F.min(c).alias(c) for c in constants],
    )


def roll_up(
    cells: DataFrame, keys: list[str], ranges: list[str], present: list[str], constants: list[str] = (), any_of: list[str] = ()
) -> DataFrame:
    """Summaries of summaries: the next coarser step. ``any_of`` columns keep one of their values."""
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(f"n_{name}").alias(f"n_{name}") for name in present],
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in ranges],
        *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in ranges],
        *[F.min(c).alias(c) for c in [*constants, *any_of]],
    )


def salted(blocks: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Spread summaries over ``salts`` buckets by a hash of their own key."""
    return blocks.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))


def salted_join(requests: DataFrame, blocks: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Equality join with salted blocks; each request visits every bucket, so
    the pairs of one key value are made by ``salts`` tasks.

    """
    visiting = requests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return by_request(visiting, "_salt").join(blocks, [*keys, "_salt"]).drop("_salt")


def by_request(df: DataFrame, *more: str) -> DataFrame:
    """Rows spread by request over a fixed number of partitions.

    Pairs are few bytes and much work, so adaptive execution must not merge
    their partitions by size.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, "request_id", *more)


def apart(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, with what follows compiled apart from what came before.

    Tests and keys of a pair together make a method so long that the JVM leaves it uncompiled. The column that is not
    deterministic keeps later filters, and the expressions they stand for, on this side.
    """
    return df.coalesce(1 << 30).withColumn("_apart", F.spark_partition_id()).filter("_apart >= 0").drop("_apart")


def within(ends: tuple[str, str], least: str | None = None, most: str | None = None) -> tuple[str, str]:
    """(can match, must match) for least <= value <= most; limits are never null."""
    lo, hi = ends
    can, must = [], []
    if least is not None:
        can.append(f"{hi} >= {least}")
        must.append(f"{lo} >= {least}")
    if most is not None:
        can.append(f"{lo} <= {most}")
        must.append(f"{hi} <= {most}")
    return " AND ".join(can), " AND ".join(must)


def among(ends: tuple[str, str], allowed: str) -> tuple[str, str]:
    """(can match, must match) for value in a list; a null list is not set."""
    lo, hi = ends
    listed = f"({allowed} IS NULL OR array_contains({allowed}, {lo}))"
    if lo == hi:
        return listed, listed
    spans = f"({allowed} IS NULL OR (array_min({allowed}) <= {hi} AND array_max({allowed}) >= {lo}))"
    return spans, f"{listed} AND ({allowed} IS NULL OR {lo} = {hi})"


def keep_contenders(pairs: DataFrame, k: int, best: Column, worst: Column) -> DataFrame:
    """Drop pairs that cannot reach the first ``k`` places of their request.

    ``best`` and ``worst`` are whole numbers, few of them, that rise with a pair's
    place.  A ``sure`` pair holds n rows that all match and rank no later than
    ``worst``.  They are counted by it, before and after the shuffle, so that what
    meets for a request is a count for each number, however many pairs it has;
    a pair whose best place comes after that of the k-th certain row is out.
    """
    certain = pairs.filter("sure").groupBy("request_id", worst.alias("at")).agg(F.sum("n").alias("n"))
    steps = certain.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("steps"))
    kth = (
        "aggregate(steps, named_struct('sum', 0L, 'at', CAST(NULL AS BIGINT)), (a, s) -> named_struct('sum', a.sum + s.n,"
        f" 'at', CASE WHEN a.at IS NULL AND a.sum + s.n >= {k} THEN CAST(s.at AS BIGINT) ELSE a.at END)).at"
    )
    cuts = steps.select("request_id", F.expr(kth).alias("_cut")).filter("_cut IS NOT NULL")
    return pairs.join(cuts, "request_id", "left").filter(F.col("_cut").isNull() | (best <= F.col("_cut"))).drop("_cut")


def log_band(value: Column, per_doubling: float) -> Column:
    """Bands of equal ratio; values of 0 or less share one."""
    return F.when(value > 0, F.floor(F.log2(value) * per_doubling)).otherwise(-1_000_000).cast("int")


#: A piece of three characters is common if more than one name in so many has it, and more than a few have.
RARE, FEW = 16, 64


def contains_pairs(names: DataFrame, name: str, terms: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """The (name, term) pairs in which the name contains the term, for selective terms, and the other terms.

    Both sides are distinct, lower-case texts. Names are filed under their pieces of three characters, which are
    counted; a term is looked up under the rarest of its own and the names found are tested. A term of one or two
    characters, or of common pieces only, has no such piece: it is in a large share of the names, or may be, and
    is returned for the caller to test where the names are. So no piece joins more than a bounded share of them.
    """

    def pieces(text: Column) -> Column:
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda at: F.substring(text, at, F.lit(3)))
        )

    filed = names.filter(F.length(name) >= 3).select(name, F.explode(pieces(F.col(name))).alias("_piece"))
    counted = filed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_names"))
    most = F.greatest(names.agg(F.count(F.lit(1))).scalar() / RARE, F.lit(FEW))
    asked = terms.filter(F.length(term) >= 3).select(term, F.explode(pieces(F.col(term))).alias("_piece"))
    rarest = (
        asked.join(counted, "_piece", "left")
        .groupBy(term)
        .agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("names"), "_piece")).alias("rare"))
        .select(term, F.col("rare._piece").alias("_piece"), (F.col("rare.names") <= most).alias("_selective"))
    )
    found = filed.join(rarest.filter("_selective").drop("_selective"), "_piece").filter(F.contains(F.col(name), F.col(term)))
    others = terms.filter((F.length(term) > 0) & (F.length(term) < 3)).select(term).unionAll(rarest.filter("NOT _selective").select(term))
    return found.select(name, term), others
