"""Registry of driver queries: imports every query module so they register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession

from panelcraft.plans import inputs as _registry
from panelcraft.plans import q_features as _q_features  # noqa: F401  (registers)
from panelcraft.plans import q_misc as _q_misc  # noqa: F401  (registers)
from panelcraft.plans import q_model as _q_model  # noqa: F401  (registers)
from panelcraft.plans import q_select as _q_select  # noqa: F401  (registers)
from panelcraft.plans import q_stats as _q_stats  # noqa: F401  (registers)
from panelcraft.plans import q_storage as _q_storage  # noqa: F401  (registers)
from panelcraft.plans import queries as _q_panel  # noqa: F401  (registers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_registry.ORACLE)
