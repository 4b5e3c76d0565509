"""Queries by operator, each with its SQL; importing this package registers them all."""

import importlib
import pkgutil

for _found in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_found.name}")
