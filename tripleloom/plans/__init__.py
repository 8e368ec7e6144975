"""Named queries over the tables of a data folder, each with the SQL it must agree with."""

from importlib import import_module

FLAGSHIP = "a01_path_index"
MODULES = ["training_data", "graph", "text", "evaluate", "rows", "tables_io", "more"]


def load_all() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        import_module(f"tripleloom.plans.{name}")
