"""Every registered query and its SQL."""

import importlib

from commitlore.registry.base import QUERIES, SQL

_MODULES = ["quality", "activity", "selection", "expressions", "features", "baskets", "clusters", "models", "sources"]
for _name in _MODULES:
    importlib.import_module(f"{__name__}.{_name}")
