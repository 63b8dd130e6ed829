"""Errors of the SQL engine."""


class SqlError(Exception):
    """Base of all."""


class ParseError(SqlError):
    """The text is not a statement."""


class PlanError(SqlError):
    """Names or types don't fit; the transaction goes on."""


class ExecutionError(SqlError):
    """Failed while running or writing; aborts the transaction."""
