"""Names for one's own filters, alert rules, payload detectors and data sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_filters: dict[str, Callable[[], Column]] = {}
_rules: dict[str, Callable[[], Column]] = {}
_detectors: dict[str, Callable[[], Column]] = {}


def register_filter(name: str, make: Callable[[], Column]) -> None:
    """make() gives a boolean column over packets."""
    _filters[name] = make


def register_rule(name: str, make: Callable[[], Column]) -> None:
    """make() gives an alert struct (see operators.alerts.alert) or null."""
    _rules[name] = make


def register_detector(name: str, make: Callable[[], Column]) -> None:
    """make() gives a struct of protocol and confidence, or null."""
    _detectors[name] = make


def filter_named(name: str) -> Column:
    return _filters[name]()


def rules() -> list[Column]:
    return [make() for make in _rules.values()]


def detect(first: Column) -> Column:
    """The built-in classification, then one's own detectors in order."""
    return F.coalesce(first, *[make() for make in _detectors.values()])


def register_functions(spark: SparkSession) -> None:
    """SQL names of the functions that need Python: dns_query_name."""
    from .names import dns_query_name

    spark.udf.register("dns_query_name", dns_query_name)
