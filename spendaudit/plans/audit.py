"""The whole audit as a job: canonical tables in, finished tables out."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendaudit.config import AuditConfig
from spendaudit.functions.frames import one_row
from spendaudit.operators.duplicates import Duplicates, find_duplicates
from spendaudit.operators.features import work_features
from spendaudit.operators.findings import explanations
from spendaudit.operators.forest import isolation_forest, normalized_scores
from spendaudit.operators.integrate import Integrated, integrate
from spendaudit.operators.monitors import (
    compliance,
    early_warnings,
    estimates,
    mark_duplicates,
    monitor_limits,
    overruns,
)
from spendaudit.operators.rules import RuleLimits, apply_rules, rule_limits, rule_reasons
from spendaudit.operators.scoring import REASONS, composite_scores, with_reasons
from spendaudit.operators.summary import work_summary
from spendaudit.session import materialize
from spendaudit.sources.raw import load_raw
from spendaudit.sources.tables import data_quality, with_defaults, write_tables

Model = Callable[[DataFrame, AuditConfig], Column]


def scored_works(features: DataFrame, limits: RuleLimits, config: AuditConfig, stored: bool = True) -> DataFrame:
    """Features with rule, model and composite columns; the numbers are written, the texts are columns over them.

    Where written features are scored for one reading, ``stored=False`` leaves the numbers columns as well, instead of writing
    all features a second time. The ranks, which need all works, are learned from the written features in either case.
    """
    modelled = apply_rules(features, limits, config).withColumns(normalized_scores(features))
    scored = composite_scores(modelled.drop("raw_score"), config)
    if not stored:
        return scored
    numbers = materialize(scored.drop(*REASONS), "scored")
    return with_reasons(numbers.withColumn("rule_reasons", rule_reasons(limits, config)), config).select(scored.columns)


class Audit:
    """Finished tables of one run, each made when first asked for.

    ``model`` gives the anomaly measure as a column over the features, which is computed once, when the
    features are written; the isolation forest unless another one is given. A model marked ``plain`` costs nothing
    to compute again, so its features are not written.

    The written part of ``scored`` holds no texts: reasons and member ids are columns over it, made of its numbers where
    they are asked for, so that a report of numbers does not put the reasons of all works into words. ``monitored`` is not
    written at all: a list of overruns computes no checks and estimates.
    """

    def __init__(
        self,
        works: DataFrame,
        ledger: DataFrame,
        allocation: DataFrame | None = None,
        calamity: DataFrame | None = None,
        config: AuditConfig = AuditConfig(),
        model: Model = isolation_forest,
    ):
        self.works, self.ledger = works, ledger
        self.allocation, self.calamity = allocation, calamity
        self.config, self.model = config, model

    @cached_property
    def features(self) -> DataFrame:
        features = work_features(self.works, self.ledger, self.config)
        measured = features.withColumn("raw_score", self.model(features, self.config))
        return measured if getattr(self.model, "plain", False) else materialize(measured, "features")

    @cached_property
    def limits(self) -> RuleLimits:
        return rule_limits(self.features, self.config)

    @cached_property
    def ruled(self) -> DataFrame:
        return apply_rules(self.features, self.limits, self.config)

    @cached_property
    def scored(self) -> DataFrame:
        """Features with rule, model and composite columns and the member id."""
        return with_defaults(scored_works(self.features, self.limits, self.config))

    @cached_property
    def duplicates(self) -> Duplicates:
        return find_duplicates(self.scored, self.config)

    @cached_property
    def monitored(self) -> DataFrame:
        """Scored works with duplicate flag, overrun, compliance and risk-estimate columns."""
        df = mark_duplicates(self.scored, self.duplicates.members)
        limits = monitor_limits(self.scored, self.config)
        return estimates(compliance(overruns(df, limits), limits), limits)

    @cached_property
    def warnings(self) -> DataFrame:
        return materialize(early_warnings(self.monitored), "warnings")

    @cached_property
    def explained(self) -> DataFrame:
        return materialize(explanations(self.monitored, self.duplicates.pairs, self.duplicates.members), "explained")

    @cached_property
    def summary(self) -> DataFrame:
        """Sums and counts by chamber, state, category and level; overviews and reports of groups read this small table."""
        return work_summary(self.scored)

    def quality_report(self) -> DataFrame:
        tables = {
            "works_master": (self.works, "Clean & Integrated"),
            "expenditures": (self.ledger, "Clean & Disbursed Ledger"),
            "mp_allocation": (self.allocation, "Clean Allocation Limits"),
            "calamity": (self.calamity, "Clean Calamity Consents"),
            "work_features": (self.features, "Engineered Analytical Table"),
            "anomaly_results": (self.scored, "Scored & Explainable Anomaly Table"),
        }
        return data_quality({n: t for n, t in tables.items() if t[0] is not None})


    def run_info(self) -> DataFrame:
        """Row counts of the run and the weights of the score."""
        works = self.scored.agg(F.count("*").alias("works"), F.count_if(F.col("risk_score").isNotNull()).alias("anomaly_rows"))
        master = self.works.agg(F.count("*").alias("master_rows"))
        weights = {"rule_weight": self.config.rule_weight, "ml_weight": self.config.ml_weight, "stat_weight": self.config.stat_weight}
        return one_row([works, master]).withColumns({n: F.lit(w) for n, w in weights.items()})

    def export(self, folder: str, csv: bool = False) -> dict[str, str]:
        """Write the canonical tables, the results and the quality report below ``folder``."""
        found = {
            "works_master": self.works, "expenditures": self.ledger, "mp_allocation": self.allocation, "calamity": self.calamity,
            "anomaly_results": self.scored, "monitors": self.monitored, "early_warnings": self.warnings, "explanations": self.explained,
            "duplicate_pairs": self.duplicates.pairs, "paired_works": self.duplicates.members,
            "duplicate_batches": self.duplicates.batches, "batch_works": self.duplicates.batch_works, "data_quality_report": self.quality_report(),
        }
        return write_tables({n: df for n, df in found.items() if df is not None}, folder, csv)


def audit_tables(tables: Integrated, config: AuditConfig = AuditConfig(), model: Model = isolation_forest) -> Audit:
    return Audit(
        materialize(tables.works, "works_master"),
        materialize(tables.ledger, "expenditures"),
        tables.allocation,
        tables.calamity,
        config,
        model,
    )


def audit_folder(spark: SparkSession, folder: str, config: AuditConfig = AuditConfig(), **options) -> Audit:
    """From a folder of raw exports to an audit."""
    return audit_tables(integrate(load_raw(spark, folder, **options)), config)
