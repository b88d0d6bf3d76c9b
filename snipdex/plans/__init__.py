"""Queries over the given tables, each with its SQL check."""

from __future__ import annotations

import importlib

from snipdex.plans.catalog import QUERIES, SQL

MODULES = ["vectors", "texts", "paths", "registries", "jobs", "configurations", "maintenance", "changes", "snippets", "coverage", "stored"]


def all_queries():
    for name in MODULES:
        importlib.import_module(f"snipdex.plans.{name}")
    return dict(QUERIES)


def all_sql():
    all_queries()
    return dict(SQL)
