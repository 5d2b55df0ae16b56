"""The engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from chronolane.plans import images, recording, sensors, storage, trajectories  # noqa: F401 - registers its queries

    return recording.QUERIES


def oracle_sql() -> dict[str, str]:
    from chronolane.plans import images, recording, sensors, storage, trajectories  # noqa: F401 - registers its queries

    return recording.ORACLES
