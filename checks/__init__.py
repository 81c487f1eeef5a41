"""Every registered query over the parquet tables, with its oracle SQL."""

import importlib
import pkgutil

from checks.base import ORACLE, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name.endswith("_checks"):
        importlib.import_module(f"checks.{_module.name}")

__all__ = ["ORACLE", "QUERIES"]
