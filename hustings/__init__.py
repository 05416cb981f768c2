"""Hustings: a PySpark-native engine for candidate, coverage and corpus analytics.

The names below are loaded when they are first asked for, so importing the package costs nothing.
"""

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "hustings.config": ("DEFAULTS", "OUTLETS", "Settings"),
    "hustings.functions.text": ("aliases", "event_query", "generic_query", "normalize_match", "normalize_name", "strip_html"),
    "hustings.functions.url": ("canonical_url",),
    "hustings.operators.news": ("articles", "discoveries", "query_audit"),
    "hustings.plans.flows": ("Run", "Source", "backfill_flow", "benchmark_flow", "daily_flow", "news_flow", "sampling_flow"),
    "hustings.plans.lineage": ("Lineage",),
    "hustings.session": ("session",),
    "hustings.sources.files": ("read_benchmark_manifest", "read_cases"),
    "hustings.sources.providers": ("Found", "curated", "curated_bundle", "event_index", "search_api", "search_outlets"),
}
_MODULE_OF = {name: module for module, names in _WHERE.items() for name in names}
__all__ = ["__version__", *sorted(_MODULE_OF)]


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    # a name may be a module's as well (session): what was asked for wins
    value = globals()[name] = getattr(import_module(_MODULE_OF[name]), name)
    return value
