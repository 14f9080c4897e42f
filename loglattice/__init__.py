"""Log, trace and query-log exploration as PySpark DataFrame operators."""

from loglattice.operators import predicates as P
from loglattice.operators.filters import Filter, apply_filters
from loglattice.operators.predicates import Predicate, filter_logs
from loglattice.view import LogView

__all__ = ["Filter", "LogView", "P", "Predicate", "apply_filters", "filter_logs"]
