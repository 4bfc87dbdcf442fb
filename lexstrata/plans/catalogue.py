"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from . import labels, library, relational, sampling, textual  # noqa: F401  importing registers
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
