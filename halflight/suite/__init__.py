"""One query per operator over the given tables, each beside its check in plain SQL."""

from halflight.suite import (  # noqa: F401
    cleaning,
    evaluation,
    learning,
    monitoring,
    profiling,
    sampling,
    scoring,
    sources,
)
from halflight.suite.base import ORACLES, QUERIES  # noqa: F401
