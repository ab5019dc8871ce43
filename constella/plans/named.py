"""Classes and functions by name, as text configuration gives them."""

from __future__ import annotations

import importlib
import logging


def named(name, default):
    """What a dotted name (``package.module.attribute``) stands for; ``default`` where there is none, with a warning.

    Anything that isn't text stands for itself. Only a missing module or attribute of that name falls back: errors inside a module are raised.
    """
    if not isinstance(name, str):
        return default if name is None else name
    module, _, attribute = name.rpartition(".")
    if not module:
        return default
    try:
        return getattr(importlib.import_module(module), attribute)
    except ModuleNotFoundError as missing:
        if not (missing.name and f"{module}.".startswith(f"{missing.name}.")):
            raise
    except AttributeError:
        pass
    logging.getLogger(__name__).warning("%s is not known, %s is taken", name, getattr(default, "__name__", default))
    return default
