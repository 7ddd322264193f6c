"""What a result leaves open, as data: the state of the index and the counts that ask for a look."""

from __future__ import annotations


def index_state(state: dict) -> str:
    return "fresh" if state["indexed"] and state["fresh"] else "stale" if state["indexed"] else "missing"


def open_points(state: dict, **counts: int) -> dict:
    """{"index": missing, stale or fresh, "to_check": the counts above zero}."""
    return {"index": index_state(state), "to_check": {name: n for name, n in counts.items() if n}}
