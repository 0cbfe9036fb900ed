"""From raw survey to the table of included respondents and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.recode import any_of, row_sum
from tallyweave.params import Inclusion
from tallyweave.plans.codebook import FEATURES, ISSUES, KEY, enrich


def scored(survey: DataFrame) -> DataFrame:
    """Recoded survey with the issue count ``score_zw``."""
    return enrich(survey).withColumn("score_zw", row_sum(ISSUES).cast("int"))


def inclusion(rules: Inclusion = Inclusion()):
    """Condition of the vulnerable group: any of five thresholds."""
    return any_of(
        [
            F.col("GGEES203") > rules.loneliness_above,
            F.col("GGRLS202") < rules.control_below,
            F.col("GGADS201") > rules.anxiety_above,
            F.col("KLGGA207") == rules.poor_health,
            F.col("score_zw") > rules.issues_above,
        ]
    )


def feature_table(survey: DataFrame, rules: Inclusion = Inclusion()) -> DataFrame:
    """Key and the 22 features of the included respondents: one scan, no shuffle."""
    return scored(survey).where(inclusion(rules)).select(KEY, *FEATURES)
