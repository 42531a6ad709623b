"""Errors that callers can tell apart."""

from __future__ import annotations

import re
from contextlib import contextmanager


class EngineError(ValueError):
    """A request that cannot be answered."""


class UnsupportedError(EngineError):
    """A feature of a file or of SQL that the engine refuses."""


class BudgetError(EngineError):
    """An answer beyond the row, cell or character budget; answers are never cut."""


_OWN = re.compile(r"quillgrid\.errors\.(EngineError|UnsupportedError|BudgetError): ([^\n]*)")


@contextmanager
def told():
    """Raise what Spark reports of a failed plan as an error of this package, with its message."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        yield
    except (PySparkException, Py4JError) as e:
        text = str(e)
        found = _OWN.findall(text)
        if found:
            kind, message = found[-1]
            raise {"EngineError": EngineError, "UnsupportedError": UnsupportedError, "BudgetError": BudgetError}[kind](message) from e
        first = next((x for x in text.splitlines() if x.strip()), type(e).__name__)
        raise EngineError(first[:500]) from e
