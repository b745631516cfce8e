"""All registered queries of the library proper."""

from . import grid_queries, model_queries, score_queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
