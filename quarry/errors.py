"""Errors that a statement can end with."""


class EngineError(Exception):
    """Anything a client is told instead of a result."""


class SqlSyntaxError(EngineError):
    """The statement is not of the dialect."""


class FencedError(EngineError):
    """Another engine has taken over as the writer."""
