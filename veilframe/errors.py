"""What can go wrong, by kind, and what a caller may make of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VeilError(Exception):
    """A failure with no name of its own."""


class PolicyViolation(VeilError):
    """The policy blocks a value of a text that was to leave."""


class ProviderFailure(VeilError):
    """A model or a service behind it can't be reached."""


class DetectionFailure(VeilError):
    """A pass failed; nothing was given on."""


class BadConfiguration(VeilError, ValueError):
    """A setting names something that doesn't exist."""


class StorageFailure(VeilError):
    """Mappings, rulings or records can't be read or written."""


#: Fixed values: (kind, status of a reply, exit code, outcome, whether to try again).
CATALOGUE = (
    (PolicyViolation, 422, 2, "refused", False),
    (ProviderFailure, 502, 3, "unavailable", True),
    (DetectionFailure, 500, 1, "failed", False),
    (BadConfiguration, None, 1, "failed", False),
    (StorageFailure, 500, 1, "failed", False),
    (VeilError, 500, 1, "failed", False),
)


def described(error: BaseException) -> tuple[str, int | None, int, str, bool]:
    """(kind, status, exit code, outcome, retryable) of an error: those of the nearest kind it is one of."""
    for kind, *rest in CATALOGUE:
        if isinstance(error, kind):
            return kind.__name__, *rest
    return type(error).__name__, 500, 1, "failed", False


def catalogue(spark: SparkSession) -> DataFrame:
    """(kind, status, exit_code, outcome, retryable, detail), a row a kind."""
    rows = [(k.__name__, status, code, outcome, again, k.__doc__) for k, status, code, outcome, again in CATALOGUE]
    return spark.createDataFrame(rows, "kind string, status int, exit_code int, outcome string, retryable boolean, detail string")
