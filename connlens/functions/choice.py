"""CASE expressions out of pairs."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def case(pairs: Iterable[tuple[Column, Any]]) -> Column:
    """The value of the first condition that holds, else null."""
    chosen = None
    for condition, value in pairs:
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
    if chosen is None:
        raise ValueError("no condition given")
    return chosen
