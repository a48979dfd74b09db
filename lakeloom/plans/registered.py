"""All queries of the library but those of the text operators."""

from lakeloom.plans import catalogue_queries, further_queries, lifecycle_queries, store_queries  # noqa: F401
from lakeloom.plans.registry import QUERIES, SQL  # noqa: F401
