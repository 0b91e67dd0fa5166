"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("texts", "structure", "matching", "jobs", "quality", "files", "streams", "projects")


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"bookflow.plans.{name}")
    return import_module("bookflow.plans.registry")
