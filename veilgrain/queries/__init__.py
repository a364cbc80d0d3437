"""Registered queries. ``load`` imports every module and returns the two registries."""

from __future__ import annotations

import importlib

from veilgrain.queries.registry import ORACLES, QUERIES, QueryFn

MODULES = (
    "sources",
    "gates",
    "transforms",
    "joins",
    "aggregates",
    "history",
    "ledger",
    "scoring",
    "lifecycle",
    "measured",
    "central",
    "local_shuffle",
    "governance",
    "streams",
)


def load() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
