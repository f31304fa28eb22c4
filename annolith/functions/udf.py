"""Arrow UDFs that can be defined before a session exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F


def arrow_udf(returns: str) -> Callable:
    """Like ``pandas_udf``, but the return type is parsed at the first call."""

    def wrap(f: Callable) -> Callable:
        made = []

        @functools.wraps(f)
        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, returns))
            return made[0](*columns)

        return call

    return wrap
