"""Registered queries over the reference tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("spatial", "text", "build", "more", "streams", "names", "formats", "extra", "searching")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
