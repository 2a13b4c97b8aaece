"""The registered queries and their SQL."""

from . import cards, catalog, details, proofs  # noqa: F401 - they register their queries
from .registry import QUERIES  # noqa: F401
