"""Named queries over the driver tables, each with its SQL statement where one exists."""

from plantlens.plans.queries import (  # noqa: F401 - registration on import
    answers, cleaning, models, relational, series, sources, streams, texts,
)
from plantlens.plans.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
