"""The named queries, one module for each family; importing this package registers them all."""

from . import aggregation, classification, decisions, joining, ordering, ranking, reading, scalars, state, streams  # noqa: F401
from ..registry import QUERIES, SQL  # noqa: F401
