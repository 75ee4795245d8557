"""Named queries over the project's tables, registered in one catalog."""

from __future__ import annotations

import importlib

from tracewell.catalog import Catalog

CATALOG = Catalog()

for _module in ("curation", "reports", "geometry", "figures", "texts", "extras"):
    importlib.import_module(f"tracewell.plans.{_module}")
