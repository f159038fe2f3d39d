"""The lead-probability model: training data, training, scoring, saving."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthspark.functions import codes
from hearthspark.operators import boosting, features, quantiles, recommend

# Inputs of the two models, label, tree count, depth, learning rates, seed, blend.
INTERACTION_FEATURES = [
    "price", "size_sqft", "beds_int", "bath_int", "freshness_score", "trust_score", "smart_popularity_score",
    "view_count",
]
LISTING_FEATURES = [
    "price", "size_sqft", "beds_int", "bath_int", "freshness_score", "trust_score", "smart_popularity_score",
    "quality_score",
]
LABEL = "target_is_lead"
# How many rows a counted row stands for.
ROWS = "_rows"
TREES, DEPTH, SEED = 100, 5, 42
INTERACTION_RATE, LISTING_RATE = 0.05, 0.1
CANDIDATE_SHARE, LEAD_SHARE = 0.60, 0.40


# --- data ----------------------------------------------------------------------

def digest(text: Column) -> Column:
    """A whole number below 2 ** 48 that stands for a text: the first 12 figures of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def sample_interactions(model: DataFrame, n: int = 1000, lead_percent: int = 10, seed: int = SEED, buckets: int = 1024) -> DataFrame:
    """``n`` listing ids drawn with replacement, each a lead with the given chance.

    A draw is a number below the table's size.  Ids are numbered by hash
    bucket and place within it, so the same draws come from any partitioning
    and no task orders all ids.  An empty table gives no draws.
    """
    ids = model.select("property_listing_id").withColumn("bucket", digest(F.col("property_listing_id")) % buckets)
    sizes = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    upto = F.sum("size").over(Window.orderBy("bucket"))
    ends = sizes.select("bucket", "size", upto.alias("end"))
    table = ends.agg(F.sort_array(F.collect_list(F.struct("end", "bucket", "size"))).alias("t")).scalar()

    def drawn(stream: int) -> Column:
        return digest(F.concat(F.col("id").cast("string"), F.lit(f":{stream}")))

    draws = (
        model.sparkSession.range(n)
        .withColumn("t", table)
        .withColumn("spot", F.try_mod(drawn(seed), F.try_element_at("t", F.lit(-1))["end"]))
        .withColumn("lead", (drawn(seed + 1) % 100 < lead_percent).cast("int"))
        .withColumn("hit", F.get(F.filter("t", lambda e: e["end"] > F.col("spot")), 0))
        .select("id", "lead", F.col("hit.bucket").alias("bucket"),
                (F.col("hit.end") - F.col("spot")).alias("place"))
    )
    numbered = ids.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("property_listing_id")))
    return draws.join(numbered, ["bucket", "place"]).select(
        F.col("id").alias("interaction_id"), "property_listing_id", F.col("lead").alias(LABEL)
    )


def event_interactions(event: DataFrame) -> DataFrame:
    """Every event of a listing as an interaction, a lead or not."""
    return event.filter(F.col("listing_web_id").isNotNull()).select(
        F.col("listing_web_id").alias("property_listing_id"),
        F.col("event_name").isin(*codes.LEAD_EVENTS).cast("bigint").alias(LABEL),
    )


def training_set(interactions: DataFrame, model: DataFrame) -> DataFrame:
    """Interactions with the features of their listing; deleted listings drop out."""
    listed = model.drop(LABEL)
    return interactions.join(listed, "property_listing_id", "left").dropna(subset=["price"])


def with_split(df: DataFrame, key: Column, parts: int = 5) -> DataFrame:
    """``is_test`` for a fifth of the keys, whatever the partitioning."""
    return df.withColumn("is_test", F.pmod(key, F.lit(parts)) == 0)


def split_key() -> Column:
    return digest(F.col("property_listing_id"))


# --- training and scoring --------------------------------------------------------

def counted(train: DataFrame, inputs: list[str]) -> DataFrame:
    """Rows of equal inputs and label as one row with their number, as all interactions of a listing are."""
    return train.groupBy(*inputs, LABEL).agg(F.count(F.lit(1)).alias(ROWS))


def fit(train: DataFrame, inputs: list[str], rate: float, trees: int = TREES, weight: str | None = None) -> PipelineModel:
    """Boosted trees on the given columns; quality is scaled as in scoring. ``weight`` says how many rows one stands for."""
    weights = [weight] if weight else []
    prepared = features.model_input(train.select(*inputs, LABEL, *weights), inputs)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    learner = GBTClassifier(
        labelCol=LABEL, maxIter=trees, stepSize=rate, maxDepth=DEPTH, seed=SEED, checkpointInterval=10
    )
    if weight:
        learner.setWeightCol(weight)
    return PipelineModel([assembler, boosting.learn(prepared, inputs, LABEL, weight, learner)])


def inputs_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def probability(df: DataFrame, model: PipelineModel, name: str = "lead_probability") -> DataFrame:
    """Adds the lead probability; every other column keeps its value."""
    inputs = inputs_of(model)
    held = [c for c in df.columns if c in inputs]
    kept = df.withColumns({f"_kept_{c}": F.col(c) for c in held})
    scored = model.transform(features.model_input(kept, inputs))
    restored = scored.withColumn(name, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction", *inputs
    )
    return restored.withColumnsRenamed({f"_kept_{c}": c for c in held}).select(*df.columns, name)


def auc(scored: DataFrame, score: str = "lead_probability", label: str = LABEL) -> DataFrame:
    """Area under the ROC curve by rank sums: ties count half."""
    counted = scored.select(
        F.col(score).alias("s"), F.col(label).cast("bigint").alias("pos"), (1 - F.col(label)).cast("bigint").alias("neg")
    )
    ranked = quantiles.running_totals(counted, "s", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    return ranked.agg(wins.alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        F.try_divide(F.col("wins"), (F.col("p") * F.col("n")).cast("double")).alias("auc")
    )


def evaluator_auc(scored: DataFrame, score: str = "lead_probability", label: str = LABEL) -> float:
    """The same area from Spark's own evaluator (binned above 1000 scores)."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC"
    ).evaluate(scored.withColumn(label, F.col(label).cast("double")))


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(inputs_of(model), weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- use -------------------------------------------------------------------------

def ai_score(df: DataFrame, model: PipelineModel, as_of) -> DataFrame:
    """Adds ``ai_score``: the lead probability as a percentage.

    The model was trained on the stepwise freshness, so scoring uses that too;
    a listing with an input that is missing or no number cannot be scored and
    gets half its search freshness.
    """
    fresh = features.add_freshness(df, as_of)
    read = [F.col(c).cast("double") for c in inputs_of(model) if c in df.columns]
    usable = reduce(and_, [value.isNotNull() & ~F.isnan(value) for value in read], F.lit(True))
    scored = probability(fresh.withColumn("_usable", usable), model)
    fallback = features.search_freshness(df, as_of) * 50
    score = F.when(F.col("_usable"), F.col("lead_probability") * 100).otherwise(fallback)
    return scored.withColumn("ai_score", score).select(*df.columns, "ai_score")


def rerank(candidates: DataFrame, table: DataFrame, model: PipelineModel, n: int = recommend.TOP_N) -> DataFrame:
    """Blend the candidates' final score with their lead probability.

    ``candidates`` holds at most 50 rows per request; one join brings all
    features that the model reads.
    """
    inputs = inputs_of(model)
    needed = [c for c in inputs if c in table.columns]
    looked_up = table.select("property_listing_id", F.struct(*needed).alias("f"))
    shown = [
        "request_id", "property_listing_id", "property_type", "price", "beds_int", "match_reason",
        "final_score", "display_location",
    ]
    rows = candidates.select(*shown).join(looked_up, "property_listing_id", "left")
    plain = rows.select(
        F.struct(*shown).alias("c"), *[F.col(f"f.{c}").alias(c) for c in needed]
    )
    scored = probability(plain, model, "ai_conversion_score").select("c.*", "ai_conversion_score")
    blended = scored.withColumn(
        "final_hybrid_score",
        F.col("final_score") * CANDIDATE_SHARE + F.coalesce("ai_conversion_score", F.lit(0.0)) * LEAD_SHARE,
    )
    return recommend.top_n(blended, "final_hybrid_score", n).select(
        "request_id", "position", "property_listing_id", "property_type", "price", "beds_int", "match_reason",
        "final_hybrid_score", "ai_conversion_score", "display_location",
    )
