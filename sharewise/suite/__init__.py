"""All registered queries and their SQL twins."""

import importlib
import pkgutil

from sharewise.suite.common import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
