"""All queries by name, and their SQL."""

import importlib
import pkgutil

from tessera import plans
from tessera.registry import ORACLE_SQL, QUERIES

for _module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_module.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
