"""A small fixed forest over the action minutes, as a JSON text that the engine reads, and as SQL."""

from __future__ import annotations

import json

from dayloom.vocab import ACTION_COLUMNS

#: Three trees: (feature, threshold, left, right) or a leaf's value.
_TREES = [
    ("action_minutes_development", 7.5, ("action_minutes_media", 6.0, 0.16, 0.1), ("action_minutes_personal_distraction", 4.25, 0.3, ("action_minutes_research", 3.0, 0.2, 0.26))),
    ("action_minutes_writing", 5.5, ("action_minutes_other", 12.0, 0.14, 0.08), ("action_minutes_communication", 8.0, 0.22, 0.18)),
    ("action_minutes_personal_distraction", 2.25, 0.24, ("action_minutes_development", 12.5, 0.1, 0.19)),
]


def forest_json(intercept: float = 0.0) -> str:
    """The trees as flat arrays."""
    cells = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def add(node) -> int:
        at = len(cells["feature"])
        leaf = not isinstance(node, tuple)
        row = (-1, 0.0, 0, 0, node) if leaf else (ACTION_COLUMNS.index(node[0]), node[1], 0, 0, 0.0)
        for k, v in zip(cells, row, strict=True):
            cells[k].append(v)
        if not leaf:
            cells["left"][at] = add(node[2])
            cells["right"][at] = add(node[3])
        return at

    roots = [add(t) for t in _TREES]
    return json.dumps({"features": list(ACTION_COLUMNS), "roots": roots, "weights": [1.0] * len(roots), **cells, "intercept": intercept})


def forest_sql(columns: dict[str, str], intercept: float = 0.0) -> str:
    """The same trees as nested cases over SQL expressions of the columns."""

    def case(node) -> str:
        if not isinstance(node, tuple):
            return f"{node!r}::DOUBLE"
        return f"CASE WHEN ({columns[node[0]]}) <= {node[1]!r} THEN {case(node[2])} ELSE {case(node[3])} END"

    return f"({intercept!r}::DOUBLE + " + " + ".join(case(t) for t in _TREES) + ")"
