"""The composite jobs: source tables to inventory, model table, indexes and models."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.operators import clean, etl, features, ranker, recommend, search
from hearthspark.session import stage_path, staged
from hearthspark.sources import files
from hearthspark.sources.sample_views import AS_OF, SampleTables

Stage = Callable[[str, Callable[[], DataFrame]], DataFrame]


def model_table(raw: DataFrame, signals: DataFrame | None, agents: DataFrame, as_of, stage: Stage) -> DataFrame:
    """Raw listings to the table that recommendation and training read.

    The cleaned table is staged: the medians and the largest agent score each
    read it once more, and should not repeat the joins and the de-duplication.
    """
    merged = files.merge_signals(raw, signals).join(agents, "agent_id", "left")
    cleaned = stage("cleaned", lambda: clean.standardise(merged))
    return features.build(clean.impute_median(cleaned), as_of)


class Workspace:
    """The tables and models of one data folder, each made once per application."""

    _models: dict[tuple[str, str, str], PipelineModel] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.sources = SampleTables(spark, sf_dir)

    def stage(self, name: str, make: Callable[[], DataFrame], prefix: str = "") -> DataFrame:
        return staged(self.spark, f"{self.sf_dir}|{self.as_of}|{prefix}{name}", make)

    def inventory(self) -> DataFrame:
        s = self.sources
        return etl.build_inventory(s.listing(), s.price(), s.location(), s.agent_score(), s.event(), self.as_of)

    def model_table_plan(self) -> DataFrame:
        s = self.sources
        return model_table(
            s.raw_listings(), etl.signals(s.event(), self.as_of), s.agent_score(), self.as_of, self.stage
        )

    def model_table(self) -> DataFrame:
        return self.stage("model_table", self.model_table_plan)

    def serving(self) -> DataFrame:
        return search.prepare(features.serving_columns(self.model_table()))

    def search_index(self) -> search.SearchIndex:
        return search.build_index(self.serving(), stage=partial(self.stage, prefix="search/"))

    def scored_index(self) -> search.SearchIndex:
        """The search index with the listing model's score."""

        def scored() -> DataFrame:
            return ranker.ai_score(self.serving(), self.listing_model(), self.as_of)

        table = self.stage("scored_serving", scored)
        return search.build_index(table, table["ai_score"], partial(self.stage, prefix="scored/"))

    def recommend_index(self) -> recommend.RecommendIndex:
        return recommend.build_index(self.model_table(), partial(self.stage, prefix="recommend/"))

    def _fitted(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, f"{self.as_of}|{name}")
        if key not in self._models:
            model = fit()
            ranker.save(model, self.model_path(name))
            self._models[key] = model
        return self._models[key]

    def model_path(self, name: str) -> str:
        return stage_path(self.spark, f"{self.sf_dir}|{self.as_of}|model|{name}")

    def listing_model(self) -> PipelineModel:
        return self._fitted(
            "listing", lambda: ranker.fit(self.model_table(), ranker.LISTING_FEATURES, ranker.LISTING_RATE)
        )

    def listing_model_held_out(self, leak: bool) -> PipelineModel:
        """The listing model without a fifth of the listings, with or without the popularity that counts leads."""
        inputs = [c for c in ranker.LISTING_FEATURES if leak or c != "smart_popularity_score"]
        return self._fitted(
            f"listing-held-out-{leak}",
            lambda: ranker.fit(self.split_listings().filter("NOT is_test"), inputs, ranker.LISTING_RATE),
        )

    def split_listings(self) -> DataFrame:
        return ranker.with_split(self.model_table(), ranker.split_key())

    def interactions(self) -> DataFrame:
        """The interactions file if there is one, else the events, else a sample of listings with random labels."""
        path = f"{self.sf_dir}/interactions.parquet"
        given = files.read_optional(lambda: files.read_parquet(self.spark, path))
        if given is not None:
            return given.select("property_listing_id", F.col(ranker.LABEL).cast("bigint").alias(ranker.LABEL))
        events = ranker.event_interactions(self.sources.event())
        return ranker.sample_interactions(self.model_table()) if events.isEmpty() else events

    def training_set(self) -> DataFrame:
        """Interactions with their listings' features, a fifth of the listings held out."""
        return self.stage(
            "training_set",
            lambda: ranker.with_split(
                ranker.training_set(self.interactions(), self.model_table()), ranker.split_key()
            ),
        )

    def interaction_model(self) -> PipelineModel:
        return self._fitted(
            "interaction",
            lambda: ranker.fit(
                ranker.counted(self.training_set().filter("NOT is_test"), ranker.INTERACTION_FEATURES),
                ranker.INTERACTION_FEATURES, ranker.INTERACTION_RATE, weight=ranker.ROWS,
            ),
        )
