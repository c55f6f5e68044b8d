"""All registered queries."""

from __future__ import annotations

from padron.plans import (  # noqa: F401
    answer_queries,
    indicator_queries,
    lake_queries,
    moderation_queries,
    record_queries,
    stream_queries,
    text_queries,
)
from padron.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
