"""Propensity-score stratification.

"Compare similar incidents across boroughs to isolate the effect of location":
a logistic model gives every incident its probability of being in the treated
group from its other characteristics; incidents are bucketed by that score
(the bucketed join of matching, without pairing rows), and the treated-minus-
control difference inside each bucket is averaged with the treated counts as
weights (average effect on the treated).  One fit, one scoring pass and one
grouped aggregation -- no pairwise matching, no cross product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from .. import config as C
from .learning import FEATURES, Preprocessor


# Columns that encode location: they determine a borough treatment exactly and
# would leave no overlap between the groups, so they are not covariates.
LOCATION_COLUMNS = ["BOROUGH", "INCIDENT_DISPATCH_AREA", "ZIPCODE"]


def propensity_strata(df: DataFrame, group_col: str, treated: Sequence[str], numeric: list[str],
                      categorical: list[str], strata: int = 20, seed: int = C.SEED,
                      exclude: Sequence[str] = tuple(LOCATION_COLUMNS)) -> DataFrame:
    """Per score stratum: treated / control counts and mean outcomes.

    Covariates are the given features minus the group column and ``exclude``.
    """
    data = df.withColumn("_treated", F.col(group_col).isin(list(treated)).cast("double"))
    numeric = [c for c in numeric if c not in exclude and c != group_col]
    cats = [c for c in categorical if c != group_col and c not in exclude]
    pre = Preprocessor(numeric, cats).fit(data)
    vec = pre.transform(data)
    model = LogisticRegression(featuresCol=FEATURES, labelCol="_treated", maxIter=100).fit(vec)
    scored = model.transform(vec).withColumn("_p", vector_to_array("probability")[1])
    s = F.least(F.floor(F.col("_p") * F.lit(strata)), F.lit(strata - 1)).cast("int")
    t = F.col(C.TARGET)
    tr = F.col("_treated") == 1.0
    return (scored.groupBy(s.alias("stratum"))
                  .agg(F.count(F.when(tr, t)).alias("treated_cases"), F.count(F.when(~tr, t)).alias("control_cases"),
                       F.avg(F.when(tr, t)).alias("treated_mean"), F.avg(F.when(~tr, t)).alias("control_mean"))
                  .orderBy("stratum"))


def att_from_strata(strata_df: DataFrame) -> DataFrame:
    """Average effect on the treated over strata holding both groups."""
    both = strata_df.where((F.col("treated_cases") > 0) & (F.col("control_cases") > 0))
    w = F.col("treated_cases").cast("double")
    return both.agg(
        (F.sum(w * (F.col("treated_mean") - F.col("control_mean"))) / F.sum(w)).alias("att_minutes"),
        F.sum("treated_cases").alias("matched_treated"), F.count(F.lit(1)).alias("strata_used"))
