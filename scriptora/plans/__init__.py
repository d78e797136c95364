"""Query plans: each module registers the queries of one part of the operator inventory."""

from __future__ import annotations

import importlib

MODULES = ("text_plans", "corpus_plans", "archive_plans", "detail_plans", "export_plans", "streaming_plans")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"scriptora.plans.{m}")
