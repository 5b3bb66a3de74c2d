"""Per-run wiring: the sources of one review (deals, owners, sentiment and the state
tables) and the shared intermediate frames built from them.

Everything here is lazy: properties build logical plans only, nothing runs until a result is
read. Absent optional sources and state tables are empty frames; only a review over the test
tables derives its state by rule.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealflow import schema
from dealflow.config import DEFAULT_CONFIG, ReviewConfig
from dealflow.functions.pacing import Pacing, pacing
from dealflow.operators import pods
from dealflow.operators.trends import fridays
from dealflow.session import written
from dealflow.sources import fixtures, readers


class Review:
    """Sources and derived frames of one review, keyed by an as-of date in ``cfg``."""

    def __init__(self, spark: SparkSession, deals: DataFrame, owners: DataFrame | None,
                 sentiment: DataFrame | None, cfg: ReviewConfig = DEFAULT_CONFIG,
                 goals: DataFrame | None = None, snapshots: DataFrame | None = None,
                 actions: DataFrame | None = None, state_by_rule: bool = False,
                 observations: dict[str, Observation] | None = None):
        self.spark = spark
        self.deals = deals
        self.owners = owners
        self.sentiment = sentiment
        self.cfg = cfg
        self.state = {"goals": goals, "snapshots": snapshots, "actions": actions}
        self.state_by_rule = state_by_rule
        #: Counters of rejected numbers for the scans "qtd", "open" and "won" (see readers.counting_rejects).
        self.observations = observations or {}

    @classmethod
    def from_tables(cls, spark: SparkSession, deals: str, owners: str | None = None,
                    sentiment: str | None = None, goals: str | None = None, snapshots: str | None = None,
                    actions: str | None = None, cfg: ReviewConfig = DEFAULT_CONFIG,
                    fmt: str = "parquet") -> "Review":
        """A review over stored tables (paths or catalog names; FIXTURES.md §1-2 schemas).
        An absent owner or sentiment source is an empty lookup (S6); an absent state table is empty."""
        def read(t):
            if t is None:
                return None
            return spark.read.format(fmt).load(t) if "/" in t else spark.table(t)
        return cls(spark, read(deals), read(owners), read(sentiment), cfg,
                   goals=read(goals), snapshots=read(snapshots), actions=read(actions))

    @classmethod
    def from_test_tables(cls, spark: SparkSession, sf_dir: str,
                         cfg: ReviewConfig = DEFAULT_CONFIG) -> "Review":
        """The review over the test tables under ``sf_dir``; its goals, snapshots and actions
        follow from the deals by rule (sources/state_fixtures.py)."""
        return cls(spark, fixtures.deals(spark, sf_dir), fixtures.owners(spark, sf_dir),
                   fixtures.sentiment(spark, sf_dir), cfg, state_by_rule=True)

    @property
    def pacing(self) -> Pacing:
        return pacing(self.cfg.today)

    # ---- top of funnel -------------------------------------------------------------
    @cached_property
    def qtd_base(self) -> DataFrame:
        return readers.qtd_base(self.deals, self.cfg, seen=self.observations.get("qtd"))

    @cached_property
    def enriched(self) -> DataFrame:
        from dealflow.operators.funnel import enrich_qtd
        return enrich_qtd(self.qtd_base, self.cfg)

    @cached_property
    def enriched_wow(self) -> DataFrame:
        """The enriched quarter base plus the deals created in the two WoW weeks (one scan
        for reports that need both the funnel and the WoW counts)."""
        from dealflow.operators.funnel import enrich_qtd
        return enrich_qtd(readers.qtd_base(self.deals, self.cfg, with_wow_window=True), self.cfg)

    @cached_property
    def clean(self) -> DataFrame:
        return readers.clean_deals(self.deals, self.cfg)

    # ---- booking review ------------------------------------------------------------
    @cached_property
    def owner_dim(self) -> DataFrame:
        return readers.owner_dim(self.owners, self.spark)

    @cached_property
    def deal_sentiment(self) -> DataFrame:
        return readers.deal_sentiment(self.sentiment, self.spark)

    @cached_property
    def open_core(self) -> DataFrame:
        """Scored open deals without the call-sentiment columns."""
        from dealflow.operators.scoring import score_open_deals
        return score_open_deals(readers.open_deals_scan(self.deals, self.cfg, self.observations.get("open")), self.owner_dim, self.cfg)

    @cached_property
    def open_scored(self) -> DataFrame:
        """Scored open deals with call sentiment (J2); queries that read no sentiment column
        lose the join in optimisation (left join on a unique key, nothing referenced)."""
        from dealflow.operators.scoring import finish_scoring
        return finish_scoring(self.open_core, self.deal_sentiment, self.cfg)

    @cached_property
    def pod_rows(self) -> DataFrame:
        """What the pod views read of the scored open deals, written once: they read it twice."""
        return written(self.open_core.select(*pods.COLUMNS))

    # What the aggregates read: rows here, cells in plans/whole.py.
    @property
    def open_cells(self) -> DataFrame:
        return self.open_core

    @property
    def quality_cells(self) -> DataFrame:
        return self.open_scored

    @property
    def won_cells(self) -> DataFrame:
        return self.won

    @cached_property
    def tof_rows(self) -> DataFrame:
        from dealflow.operators.funnel import tof_rows
        return tof_rows(self.clean, self.cfg)

    @cached_property
    def pod_detail(self) -> DataFrame:
        return pods.pod_detail(self.pod_rows)

    def sentiment_for(self, deals: DataFrame) -> DataFrame:
        """A10 restricted to some deals (e.g. a top-N, whose known size makes Spark broadcast the
        ids): a semi-join before the aggregation, so only their calls are aggregated."""
        if self.sentiment is None:
            return self.deal_sentiment
        ids = deals.select(F.col("deal_id").cast("string").alias("deal_id"))
        return readers.deal_sentiment(self.sentiment.join(ids, "deal_id", "left_semi"), self.spark)

    @cached_property
    def won(self) -> DataFrame:
        from dealflow.operators.wins import closed_won
        return closed_won(readers.closed_won_scan(self.deals, self.cfg, self.observations.get("won")), self.owner_dim)

    # ---- state tables (stored, else empty, else by rule for the test tables) ------------
    def _state(self, name: str, kind: T.StructType, by_rule) -> DataFrame:
        if self.state[name] is not None:
            return self.state[name]
        return by_rule() if self.state_by_rule else self.spark.createDataFrame([], kind)

    @cached_property
    def goals(self) -> DataFrame:
        from dealflow.sources.state_fixtures import derived_goals
        return self._state("goals", schema.GOALS, lambda: derived_goals(self.clean))

    @cached_property
    def hist(self) -> DataFrame:
        from dealflow.operators.trends import historical_snapshots
        return historical_snapshots(self.enriched, self.cfg).select(
            "snapshot_date", "metric", F.col("value").cast("double").alias("value"))

    @cached_property
    def snapshot_seed(self) -> DataFrame:
        """The stored weekly snapshots before this run."""
        from dealflow.sources.state_fixtures import snapshot_seed
        return self._state("snapshots", schema.SNAPSHOTS, lambda: snapshot_seed(self.open_core, self.cfg))

    @cached_property
    def snapshot_store(self) -> DataFrame:
        """The weekly snapshots after this run's sync (reconstructed Fridays are added only if
        one of their dates is missing)."""
        from dealflow.operators.state import sync
        return sync(self.snapshot_seed, self.hist)

    @property
    def has_prior_snapshot(self) -> Column:
        """Whether a snapshot from before the as-of date is stored: one that was there, or a Friday
        that this run's sync adds. Friday rows are all of the quarter's so far, whatever the deals are,
        so the dates decide."""
        past = any(day < self.cfg.today for day in fridays(self.cfg))
        return F.lit(True) if past else self.snapshot_seed.where(F.col("snapshot_date") < F.lit(self.cfg.today)).exists()

    @cached_property
    def actions(self) -> DataFrame:
        from dealflow.sources.state_fixtures import derived_actions
        return self._state("actions", schema.ACTIONS, lambda: derived_actions(self.open_core))


def to_output(df: DataFrame) -> DataFrame:
    """Result boundary: exact decimal money becomes DOUBLE (2 dp after the final sum)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
