"""All registered queries of the engine's own operators."""

from __future__ import annotations

from quire.plans import codecs, coding, corpus, metrics, models, quantisation, selection, sources, transforms  # noqa: F401
from quire.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
