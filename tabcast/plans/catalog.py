"""All registered queries, and the flagship among them."""

from pyspark.sql import functions as F

from tabcast.operators import assoc, typing
from tabcast.plans import model_queries, profile_queries, run_queries  # noqa: F401  (they register queries)
from tabcast.plans.registry import QUERIES, SQL, table
from tabcast.sources.tables import columns_of_type

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark, folder):
    """Types, then banded correlations of the numeric columns, strongest first."""
    lineitem = table(spark, folder, "lineitem")
    types = typing.type_map(typing.decide_types(lineitem))
    numbers = columns_of_type(types, "continuous", "integer", "ordinal")
    pairs = assoc.pearson_pairs(lineitem, numbers)
    return pairs.orderBy(F.desc(F.abs("r")), "c1", "c2")
