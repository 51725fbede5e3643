"""Operators for building training corpora. Nothing else in the library imports this package."""


def load_all():
    """The queries of this package and their SQL twins."""
    from importlib import import_module

    from . import core

    for topic in TOPICS:
        import_module(f"{__name__}.{topic}")
    return dict(core.QUERIES), dict(core.ORACLES)


TOPICS = ["exact_dedup", "mixing", "bpe", "language", "near_dedup", "metric_search", "html_text", "secrets", "licenses", "suffix_dedup", "simhash", "whitening", "conversations"]
