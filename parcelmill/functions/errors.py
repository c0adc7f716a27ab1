"""Categories of failed external calls."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(kind: Column, status: Column) -> Column:
    return (
        F.when((kind == "rate") | (status == 429), "rate_limit")
        .when(kind == "timeout", "timeout")
        .when(kind == "connection", "network")
        .when(status.isin(401, 403), "authentication")
        .when(status.isin(400, 404, 409, 422), "invalid_request")
        .when(status >= 500, "server_error")
        .when(status.isNotNull(), "api_error")
        .when(kind == "parse", "malformed_response")
        .otherwise("unexpected")
    )


def retryable(kind: Column, status: Column) -> Column:
    return F.coalesce(kind.isin("rate", "timeout", "connection") | (status == 429) | (status >= 500), F.lit(False))


def backoff(attempt: Column) -> Column:
    """Seconds before the next try, without the random part."""
    return F.least(F.lit(4.0), 0.5 * F.pow(F.lit(2.0), attempt - 1))
