"""All registered queries."""


def load_all():
    """Import every topic module; returns the queries and their SQL twins."""
    from importlib import import_module

    from . import core

    for topic in TOPICS:
        import_module(f"{__name__}.{topic}")
    return dict(core.QUERIES), dict(core.ORACLES)


TOPICS = ["graph", "lists", "texts", "tables"]
