"""Query catalogue and the end-to-end detection plan."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
