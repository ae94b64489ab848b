"""Normal and chi-squared probabilities as column functions and on the driver."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STANDARD = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Vectorised over Arrow batches; null stays null."""
    return x.map(STANDARD.cdf, na_action="ignore")


def two_sided(stat: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(stat)))


def chi2_two_df(wald: Column) -> Column:
    """Upper probability of a chi-squared variable with two degrees of freedom."""
    return F.exp(-wald / 2)
