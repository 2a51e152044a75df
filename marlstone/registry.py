"""Names of what can be plugged in: record sources, forecasting methods, model ports."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from marlstone.plans import experiment
from marlstone.sources import projections

#: Record sources: a function of raw rows.
SOURCES: dict[str, Callable[..., Any]] = {"news": projections.news, "reddit": projections.reddit, "arxiv": projections.arxiv, "substack": projections.posts}
METHODS: dict[str, Callable[..., Any]] = dict(experiment.METHODS)
ALIASES = {"bm25_rag": "direct", "naive_rag": "direct", "flex": "remembering", "reasoningbank": "remembering"}


def method(name: str) -> Callable[..., Any]:
    key = ALIASES.get(name, name)
    if key not in METHODS:
        raise KeyError(f"no method {name!r}; there are {', '.join(sorted({*METHODS, *ALIASES}))}")
    return METHODS[key]


def default_mode(available: set[str]) -> str:
    """The best retrieval mode of those that have an index."""
    for mode in ("hybrid", "dense", "bm25"):
        if mode in available:
            return mode
    raise ValueError("no index is there")
