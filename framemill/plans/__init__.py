"""The registered queries, a module for each family."""

from __future__ import annotations

from importlib import import_module

#: Modules of queries, in the order of registration.
MODULES = ("windows", "filters", "stats", "samples", "texts", "streams", "more", "problems", "choices", "surface")


def registries():
    return [import_module(f"framemill.plans.{m}").R for m in MODULES]
