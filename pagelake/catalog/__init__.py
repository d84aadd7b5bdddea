"""Every operator as a registered query plus, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_GROUPS = ["sizing", "intake", "layout", "bilevel", "color", "detect", "objects", "profile", "flow", "output"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for group in _GROUPS:
        part = getattr(import_module(f"{__name__}.{group}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def checks() -> dict[str, str]:
    return _collect("SQL")
