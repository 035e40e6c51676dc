"""The one error type of the engine: input that cannot be trusted."""


class DataQualityError(Exception):
    """Raised when an input is inconsistent; no partial result is ever returned."""
