"""Every registered query. Importing a module registers its plans."""

import importlib
import pkgutil

from . import registry
from .registry import PLANS, SQL  # noqa: F401

_package = __package__
for _module in pkgutil.iter_modules(importlib.import_module(_package).__path__):
    if _module.name.startswith("on_"):
        importlib.import_module(f"{_package}.{_module.name}")
