"""Arrow-batched functions that are made when they are first used: their types need a session, modules must not."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_pandas_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like pandas_udf(returns), for use at module level."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made = cache(lambda: F.pandas_udf(f, returns))

        @wraps(f, assigned=("__module__", "__name__", "__qualname__", "__doc__"), updated=())
        def column(*args: Column | str) -> Column:
            return made()(*args)

        return column

    return wrap
