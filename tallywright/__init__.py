"""Ledger analytics on Spark: DataFrame operators, sources, functions, plans and streams."""

import os

_TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark) -> None:
    """Lets Python workers of a local session import this package from where the driver did; a cluster has it installed."""
    if spark.sparkContext.master.startswith("local"):
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if _TOP not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_TOP, *filter(None, paths)])
