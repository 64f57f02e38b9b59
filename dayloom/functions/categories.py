"""Rule-based activity categories.

A rule set is a parameter: rules are (path, pattern, ignore_case); the deepest
matching path wins, the first in file order on ties. The default is the whole table of
``category_rules.json``; an installation's own file is read with
:func:`dayloom.sources.configs.load_rules`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayloom.functions.text import category_slug, let, normalize_text
from dayloom.vocab import TAXONOMY_CATEGORY


@dataclass(frozen=True)
class Rule:
    """One taxonomy rule; ``pattern`` None never matches (a grouping node)."""

    path: tuple[str, ...]
    pattern: str | None = None
    ignore_case: bool = True

    @property
    def category(self) -> str:
        slug = category_slug(list(self.path))
        return TAXONOMY_CATEGORY.get(slug, slug)

    @property
    def java_pattern(self) -> str:
        return f"{'(?iud)' if self.ignore_case else '(?d)'}{self.pattern}"


def rules_from_json(path: str | Path) -> tuple[Rule, ...]:
    """``{"categories": [{"name": [...], "rule": {"type", "regex", "ignore_case"}}]}``."""
    rules = []
    for item in json.loads(Path(path).read_text(encoding="utf-8"))["categories"]:
        rule = item["rule"]
        pattern = rule.get("regex") if rule.get("type") == "regex" else None
        rules.append(Rule(tuple(item["name"]), pattern or None, bool(rule.get("ignore_case", False))))
    return tuple(rules)


DEFAULT_RULES = rules_from_json(Path(__file__).with_name("category_rules.json"))


def categorize(parts: list[Column], rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """H5: category of the text ``parts`` joined by line breaks.

    Rules are tried deepest first, so the first hit ends the search; the cleaned text
    is made once for all of them.
    """
    text = F.concat_ws("\n", *[normalize_text(p) for p in parts])
    ordered = sorted(
        (r for r in rules if r.pattern), key=lambda r: -len(r.path)
    )
    other = F.lit(TAXONOMY_CATEGORY["uncategorized"])
    return let(
        text,
        lambda t: F.coalesce(*[F.when(t.rlike(r.java_pattern), F.lit(r.category)) for r in ordered], other),
    )


def categorize_window(app: Column, title: Column, url: Column, rules=DEFAULT_RULES) -> Column:
    """Category of an application window event."""
    return categorize([app, title, url], rules)


def categorize_web(url: Column, title: Column, rules=DEFAULT_RULES) -> Column:
    """Category of a browser tab event."""
    return categorize([title, url], rules)
