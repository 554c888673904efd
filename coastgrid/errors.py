"""Errors raised by the operators."""


class CoastgridError(Exception):
    """Base class."""


class ValidationError(CoastgridError, ValueError):
    """A parameter or a table breaks an operator's contract."""


class CoverageError(CoastgridError, ValueError):
    """A time axis or an extent does not cover what was asked of it."""


class MissingRecordError(CoastgridError, LookupError):
    """A record, river, variable or file that was asked for does not exist."""


def require(condition: bool, message: str) -> None:
    """Raise ``ValidationError`` unless a driver-side parameter check holds."""
    if not condition:
        raise ValidationError(message)
