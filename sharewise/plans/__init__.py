"""How plans are put together: small state tables, checked lookups, global order."""

from sharewise.plans.ordering import dense_index, running_before
from sharewise.plans.state import attach, by_rows, discard, lookup, materialize, shared_path, spread_rows, store

__all__ = [
    "attach",
    "by_rows",
    "dense_index",
    "discard",
    "lookup",
    "materialize",
    "running_before",
    "shared_path",
    "spread_rows",
    "store",
]
