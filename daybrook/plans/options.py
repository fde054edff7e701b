"""Options of the write-up jobs: one table of fields, read by one loader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from ..constants import BUDGET_FREE, BUDGET_FRONTIER, BUDGET_OTHER, FRONTIER_MARKERS


def number(least: int, otherwise: int) -> Callable[[Any], int]:
    """Whole numbers of at least ``least``; zero and what is no number give ``otherwise``."""
    def read(value: Any) -> int:
        try:
            return max(least, int(value) or otherwise)
        except (TypeError, ValueError):
            return otherwise
    return read


def one_of(*allowed: str) -> Callable[[Any], str]:
    """One of a few words, in any case; the first for anything else."""
    known = {word: word for word in allowed}
    return lambda value: known.get(str(value).strip().lower(), allowed[0])


def tier_budget(model: str) -> int:
    """Input tokens that a model's tier takes."""
    tiers = [((":free",), BUDGET_FREE), (FRONTIER_MARKERS, BUDGET_FRONTIER), (("",), BUDGET_OTHER)]
    return next(size for marks, size in tiers if any(mark in model.lower() for mark in marks))


def option(default: Any, read: Callable[[Any], Any]) -> Any:
    return field(default=default, metadata={"read": read})


@dataclass(frozen=True)
class WriteUpOptions:
    write_entries: bool = option(True, bool)
    entry_max_tokens: int = option(1500, number(1, 1500))
    entry_period: str = option("month", one_of("month", "week"))
    summary_cadence: str = option("off", one_of("off", "weekly", "monthly"))
    skip_unchanged: bool = option(False, bool)
    entry_batch: str = option("day", one_of("day", "week", "adaptive"))
    max_input_tokens: int = option(0, number(0, 0))
    max_batch_days: int = option(7, number(1, 7))


def options_from(config: dict) -> WriteUpOptions:
    """The ``synthesis`` part of a configuration; a budget of ``auto`` follows the model's tier."""
    given = {"max_input_tokens": 0, **(config.get("synthesis") or {})}
    if str(given["max_input_tokens"]).strip().lower() == "auto":
        given["max_input_tokens"] = tier_budget((config.get("llm") or {}).get("model") or "")
    return WriteUpOptions(**{f.name: f.metadata["read"](given[f.name]) for f in fields(WriteUpOptions) if f.name in given})
