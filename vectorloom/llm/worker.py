"""Things a Python worker keeps between its tasks.

Functions of this library travel to the workers by value, so a module-level variable would be
new in each task. A module object of the worker itself lives as long as the worker.
"""

from __future__ import annotations

import sys
import types


def kept(key, make):
    """What ``make()`` returned the first time this worker asked for ``key``."""
    store = sys.modules.setdefault("vectorloom_kept", types.ModuleType("vectorloom_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
