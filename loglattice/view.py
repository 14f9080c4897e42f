"""Which columns of a log table play which role.

A :class:`LogView` is the only configuration the operators need.  Any role may be left unmapped;
an operator that cannot work without a role says so when the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Output names of the role columns in the narrow projection.
ROLE_ALIASES = {
    "timestamp": "__timestamp",
    "body": "__body",
    "severity": "__severity",
    "trace_id": "__traceId",
    "service": "__serviceName",
}

# How a coarse partition column may be derived from the timestamp.
PARTITION_UNITS = ("second", "minute", "hour", "day")


@dataclass(frozen=True)
class LogView:
    """Role -> column name.  ``None`` means the table has no such column."""

    timestamp: str | None = None
    body: str | None = None
    severity: str | None = None
    trace_id: str | None = None
    service: str | None = None
    span_attributes: str | None = None
    #: column holding ``timestamp`` truncated to ``partition_by`` in UTC; filtered along with it
    partition_col: str | None = None
    partition_by: str = "day"
    #: columns that make a row unique, used to break ties in sorted limits
    row_id: tuple[str, ...] = ()
    #: STRING columns that hold JSON text (VARIANT columns are recognised by type)
    json_columns: tuple[str, ...] = ()
    #: discovered JSON leaves as ``Column.path`` (what ``json_paths`` returns)
    json_leaves: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.partition_by not in PARTITION_UNITS:
            raise ValueError(f"partition_by must be one of {PARTITION_UNITS}, not {self.partition_by!r}")
        for name in ("row_id", "json_columns", "json_leaves"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, (value,))

    @classmethod
    def otel(cls, **overrides) -> "LogView":
        """Mapping of the OpenTelemetry logs table."""
        base = cls(
            timestamp="Timestamp",
            body="Body",
            severity="SeverityText",
            trace_id="TraceId",
            service="ServiceName",
            span_attributes="SpanAttributes",
        )
        return replace(base, **overrides)

    def with_(self, **changes) -> "LogView":
        return replace(self, **changes)

    def require(self, *roles: str) -> None:
        missing = [r for r in roles if not getattr(self, r)]
        if missing:
            raise ValueError(f"the view maps no column to: {', '.join(missing)}")

    @property
    def mapped_roles(self) -> dict[str, str]:
        return {r: getattr(self, r) for r in ROLE_ALIASES if getattr(self, r)}
