"""All queries of this package."""

from . import queries_conversations, queries_pages, queries_sets, queries_text, queries_urls  # noqa: F401
from .registry import PLANS, SQL  # noqa: F401
