"""All queries over the driver's tables, with the DuckDB SQL that checks them."""

from corvane.plans import appendix, bibliography, concordance, quality, search, statistics  # noqa: F401
from corvane.plans.base import LINES, QUERIES, SQL
from corvane.plans.concordance import entry

__all__ = ["LINES", "QUERIES", "SQL", "entry"]
