"""Query catalogue: every registered query is ``fn(spark, sf_dir) -> DataFrame``;
most carry a DuckDB oracle SQL string computing the same result independently."""

from tessera.plans.common import ORACLES, QUERIES


def load_all():
    # importing a module registers its queries
    from tessera.plans import cleaning  # noqa: F401
    for mod in ("profiling", "correlation", "outliers", "modeling", "monitoring", "neighbors", "training",
                "sources", "streams"):
        try:
            __import__(f"tessera.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"tessera.plans.{mod}":
                raise
    return QUERIES, ORACLES
