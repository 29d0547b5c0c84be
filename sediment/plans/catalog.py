"""All registered queries."""

from __future__ import annotations

from sediment.plans import analytics, corrections, folders, loading, scalars, streams, tables  # noqa: F401
from sediment.plans.registry import QUERIES
from sediment.session import prepare


def catalog() -> dict:
    def bound(function):
        return lambda spark, folder: function(prepare(spark), folder)

    return {name: bound(function) for name, function in QUERIES.items()}
