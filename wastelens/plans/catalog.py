"""Imports every query module so that the registry is complete."""

from wastelens.plans import registry
from wastelens.session import ship_package
from wastelens.plans import (  # noqa: F401
    q_audit, q_dashboards, q_detect, q_entries, q_io, q_models, q_reports, q_stream)


def _shipped(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries():
    """Registered queries; each first makes the package importable on the workers."""
    return {k: _shipped(v) for k, v in registry.QUERIES.items()}


def oracle_sql():
    return dict(registry.ORACLE)
