"""Registered queries, one module per operator group."""

import importlib

GROUPS = (
    "sources", "urls", "numbers", "labels", "scores", "filters", "extraction",
    "replies", "joins", "aggregates", "windows", "ordering", "records", "streams", "pipeline",
)


def load_all() -> None:
    for group in GROUPS:
        try:
            importlib.import_module(f"statloom.plans.q_{group}")
        except ModuleNotFoundError as missing:
            if missing.name != f"statloom.plans.q_{group}":
                raise
