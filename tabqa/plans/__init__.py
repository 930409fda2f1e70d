"""Named queries over the test tables, one module per operator family."""

from tabqa.plans.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every plan module so its queries register."""
    from tabqa.plans import batch, controls, corpus, datasets, functions, instance_scoring, relational, render, sampling, scoring, traces  # noqa: F401
