"""Every cut table of the library, and the two helpers that apply one.

A table is a list of (limit, label) tried in order, then a last label.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# |r| in the table of all pairs.
PAIR_STRENGTH = ([(0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")], "very_weak")
# |r| in the study of one pair.
STUDY_STRENGTH = ([(0.8, "very_strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak")], "negligible")
PAIR_MEANING = (
    [
        (0.9, "near linear, risk of collinearity"),
        (0.7, "strong dependence, good predictor"),
        (0.5, "visible tendency"),
        (0.3, "slight tendency"),
    ],
    "no visible link",
)
R2_QUALITY = ([(0.9, "excellent"), (0.75, "very_good"), (0.6, "good"), (0.4, "average")], "insufficient")
MAE_SHARE = ([(5.0, "very_low"), (15.0, "acceptable")], "high")
ERROR_SHARE = ([(5.0, "close"), (15.0, "moderate")], "wide")
INTERVAL_SHARE = ([(20.0, "precise"), (50.0, "moderate")], "uncertain")
P_TIER = ([(0.01, "p<0.01"), (0.05, "p<0.05"), (0.10, "p<0.10")], "p>=0.10")

COLLINEAR_PAIRS = 0.8
COLLINEAR_FEATURES = 0.7
OVERFIT_R2 = 0.95
STABLE_CV_STD = 0.05
SIGNIFICANT_P = 0.05
RELIABLE_RMSE_SHARE = 0.2


def at_least(value: Column, table: tuple) -> Column:
    """Label of the first limit that ``value`` reaches; null stays null."""
    cuts, last = table
    result = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in cuts:
        result = result.when(value >= limit, label)
    return result.otherwise(last)


def below(value: Column, table: tuple) -> Column:
    """Label of the first limit that ``value`` stays under; null stays null."""
    cuts, last = table
    result = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in cuts:
        result = result.when(value < limit, label)
    return result.otherwise(last)


def direction(r: Column) -> Column:
    """Sign of an association; anything not above zero counts as negative."""
    return F.when(r > 0, "positive").when(r.isNotNull(), "negative")


def trend(slope: Column) -> Column:
    return F.when(slope > 0, "rising").when(slope < 0, "falling").when(slope.isNotNull(), "flat")
