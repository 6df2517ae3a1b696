"""Registered queries over fixture views."""

import importlib

MODULES = ["social_queries", "text_queries", "spatial_queries", "raster_queries", "command_queries", "stream_queries", "live_queries"]


def load():
    """The registry with all query modules imported."""
    for name in MODULES:
        importlib.import_module(f"wayfarer.plans.{name}")
    return importlib.import_module("wayfarer.plans.registry")
