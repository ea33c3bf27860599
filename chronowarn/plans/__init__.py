"""Queries over the provided tables, one module per family of operators."""

import importlib
import pkgutil


def load_plans() -> None:
    """Import every plan module once so that its queries are registered."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
