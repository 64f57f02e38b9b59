"""The self-report history columns as rows of a description, and selections on it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from dayloom.vocab import ACTIVITY_FEATURES, CALENDAR_COLUMNS, HISTORY_STATS, PRODUCTION_FEATURES, TARGETS


class HistoryColumn(NamedTuple):
    """A column and what it describes; calendar columns describe no target."""

    name: str
    target: str | None = None
    stat: str | None = None


HISTORY = (
    *(HistoryColumn("__".join(("history", t, s)), t, s) for t in TARGETS for s in HISTORY_STATS),
    *(HistoryColumn(c) for c in CALENDAR_COLUMNS),
)
HISTORY_COLUMNS = [c.name for c in HISTORY]
RUNTIME_COLUMNS = ["user_id", "timestamp", *ACTIVITY_FEATURES, *HISTORY_COLUMNS]
_NAMES = {(c.target, c.stat): c.name for c in HISTORY}

#: What a set takes of other targets' history.
SHARED_STATS = ("last", "mean", "last_minus_mean")


def history_name(target: str, stat: str) -> str:
    """The column of one statistic of one target."""
    return _NAMES[target, stat]


def _others(column: HistoryColumn) -> bool:
    return column.stat in SHARED_STATS


def _nothing(column: HistoryColumn) -> bool:
    return False


def _direct(feature: str) -> bool:
    return "_state_" not in feature


def _every(feature: str) -> bool:
    return True


#: Set name: which history of other targets it has, and which activity features.
SETS: dict[str, tuple[Callable[[HistoryColumn], bool], Callable[[str], bool]]] = {
    "history_core_aw25": (_nothing, _every),
    "history_vector_aw25": (_others, _every),
    "history_core_direct16": (_nothing, _direct),
}


def columns_of_set(name: str, target: str) -> list[str]:
    """A target's own history and the calendar, then others' history, then activity."""
    shared, activity = SETS[name]
    own = [c.name for c in HISTORY if c.target in (target, None)]
    return [
        *own,
        *(c.name for c in HISTORY if shared(c) and c.name not in own),
        *filter(activity, PRODUCTION_FEATURES),
    ]
