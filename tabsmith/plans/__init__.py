"""Plans: the registered queries and the end-to-end preparation, search, training and scoring runs."""

import importlib

_MODULES = ["profiling", "preparation", "modelling", "scoring", "storage", "charts", "flagship"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
