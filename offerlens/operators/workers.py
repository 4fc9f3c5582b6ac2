"""What a Python worker keeps between tasks.

The cache lives in an importable module: a function sent to the workers
refers to it by name, where a dictionary in its closure would be a new, empty
one for every task.
"""

from __future__ import annotations

_LOADED: dict = {}


def load_once(key: str, load_fn):
    """``load_fn()``, called once per worker and key."""
    if key not in _LOADED:
        _LOADED[key] = load_fn()
    return _LOADED[key]
