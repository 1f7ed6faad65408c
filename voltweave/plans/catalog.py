"""All registered queries."""

from voltweave.plans import draw_queries, model_queries, panel_queries  # noqa: F401
from voltweave.plans.registry import QUERIES, SQL  # noqa: F401
