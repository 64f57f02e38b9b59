"""URL filters: host rules by longest match, then pattern rules found by their rarest literal token.

A pattern rule names the literal tokens (runs of letters and digits of the URL) that any match
must contain. The index keeps each rule under the one of its tokens that the fewest URLs have.
A URL's tokens fetch the candidate rules; no other regular expression runs on it.

Rule sets of any size are cut into blocks of bounded size. A block travels to the tasks as look-up
tables (host suffix and path length for host rules, rarest token for patterns), every URL meets
every block, and the blocks' answers are combined in the row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, free_name

#: Rules and characters that travel to a task in one block, and compiled patterns a task keeps.
BLOCK_RULES, BLOCK_CHARS, COMPILED = 50_000, 8_000_000, 4096


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL, and literal tokens every match contains."""

    pattern: str
    literals: tuple[str, ...]


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
#: Gambling, medicines, adult pages, advertising and link farms, as words of host or path.
PATTERN_RULES = (
    PatternRule(r"[/.]casino(-[a-z]+)?[./]", ("casino",)),
    PatternRule(r"[/.](free|best)-bets[./]", ("bets",)),
    PatternRule(r"[/.]cheap-pills[./]", ("cheap", "pills")),
    PatternRule(r"[/.]pills-(online|shop)[./]", ("pills",)),
    PatternRule(r"[/.]adult-[a-z]+[./]", ("adult",)),
    PatternRule(r"[/.]ads-track[./]", ("ads", "track")),
    PatternRule(r"[/.]spam-farm[./]", ("spam", "farm")),
    PatternRule(r"[/.]poker(-[a-z]+)?[./]", ("poker",)),
    PatternRule(r"[/.]xxx(-[a-z]+)?[./]", ("xxx",)),
    PatternRule(r"[/.]porn(-[a-z]+)?[./]", ("porn",)),
    PatternRule(r"[/.]warez[./]", ("warez",)),
    PatternRule(r"/affiliate/.*[?&]click=", ("affiliate", "click")),
)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))


def read_rules(spark: SparkSession, path: str) -> tuple[list[HostRule], list[PatternRule]]:
    """Both rule tables of a JSON file: ``{"hosts": [[host, path, verdict], ...], "patterns":
    [[pattern, [literal, ...]], ...]}``; a table that is not there is empty."""
    tables = json.loads(spark.read.text(path, wholetext=True).first()[0])
    patterns = [PatternRule(p, tuple(literals)) for p, literals in tables.get("patterns", [])]
    return [HostRule(*r) for r in tables.get("hosts", [])], patterns


def rule_blocks(rules: Sequence, size) -> Iterator[tuple[int, Sequence]]:
    """Consecutive rules in blocks of bounded number and characters, each with its first number."""
    begin, chars = 0, 0
    for number, rule in enumerate(rules):
        if number > begin and (number - begin >= BLOCK_RULES or chars + size(rule) > BLOCK_CHARS):
            yield begin, rules[begin:number]
            begin, chars = number, 0
        chars += size(rule)
    if begin < len(rules):
        yield begin, rules[begin:]


class HostTable:
    """Host to its rules by path, and the path lengths that occur, so a URL costs a few look-ups."""

    def __init__(self, first: int, rules: Sequence[HostRule]):
        self.longest = max(len(r.host) for r in rules)
        self.hosts: dict[str, tuple[list[int], dict[str, tuple[int, str, str]]]] = {}
        for number, r in enumerate(rules, first):
            self.hosts.setdefault(r.host, ([], {}))[1][r.path] = (number, r.name, r.verdict)
        for lengths, paths in self.hosts.values():
            lengths.extend(sorted({len(p) for p in paths}, reverse=True))

    def best(self, host: str, path: str) -> tuple[int, int, str | None, str | None]:
        """Length, number, name and verdict of the longest rule that fits, of equal ones the last."""
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        tail = host[-self.longest - 1 :]
        suffixes = [tail[m.end() :] for m in re.finditer(r"\.", tail)]
        if len(host) <= self.longest:
            suffixes.append(host)
        for suffix in suffixes:
            lengths, paths = self.hosts.get(suffix, ((), {}))
            fits = next((paths[path[:n]] for n in lengths if path[:n] in paths), None)
            if fits and (len(fits[1]), fits[0]) > best[:2]:
                best = (len(fits[1]), *fits)
        return best


def longest_rule(first: int, rules: Sequence[HostRule]):
    """A pandas UDF over host and path: the answer of one block of host rules."""

    @F.pandas_udf("length int, number int, name string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = HostTable(first, rules)
        for hosts, paths in batches:
            found = [known.best(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["length", "number", "name", "verdict"])

    return match


def rarest_literals(urls: DataFrame, url: str, rules: Sequence[PatternRule]) -> dict[str, list[int]]:
    """Token to rule numbers: each rule under the literal that the fewest of all URLs have.

    Counts come from a grouping that keeps only tokens of the rule set, so at most one row per
    literal reaches the driver, which holds the rules anyway.
    """
    tokens = urls.select(F.explode(url_tokens(col(url))).alias("token"))
    seen: dict[str, int] = {}
    for _, some in rule_blocks(sorted({t for r in rules for t in r.literals}), len):
        # a block is bounded in rows and characters, so it is broadcast and no token is shuffled uncounted
        wanted = F.broadcast(urls.sparkSession.createDataFrame(pd.DataFrame({"token": some}, dtype=object), "token string"))
        counts = tokens.join(wanted, "token", "left_semi").groupBy("token").count()
        seen.update({r["token"]: r["count"] for r in counts.collect()})
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        rarest = min(rule.literals, key=lambda t: (seen.get(t, 0), t))
        index.setdefault(rarest, []).append(number)
    return index


def first_pattern(index: dict[str, list[int]], rules: Sequence[PatternRule], first: int = 0):
    """A pandas UDF: the first of a block's rules whose pattern a URL matches, else null.

    ``index`` numbers the rules of the whole table, of which the block begins at ``first``.
    """
    patterns = [r.pattern for r in rules]
    block = range(first, first + len(rules))
    index = {t: own for t, numbers in index.items() if (own := [n - first for n in numbers if n in block])}

    @F.pandas_udf("string")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = lru_cache(COMPILED)(lambda number: re.compile(patterns[number]))
        split = re.compile("[^a-z0-9]+").split

        def one(url: str | None) -> str | None:
            if url is None:
                return None
            url = url.lower()
            for number in sorted({n for t in set(split(url)) if t in index for n in index[t]}):
                if compiled(number).search(url):
                    return patterns[number]
            return None

        for urls in batches:
            yield pd.Series([one(u) for u in urls], dtype=object)

    return match


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``pattern`` and ``verdict`` to every row.

    A host rule decides where one fits (the longest wins, of equally long ones the last); else a
    matching pattern blocks and anything else is allowed. A null URL, or one without ``://``, has
    empty host and path, so only a rule without host can fit it, and may match a pattern if not
    null. Rows are neither dropped nor merged; where the table has a column of one of these names,
    the new one gets underscores in front. Either rule table may be empty, and of any size.
    """
    if any(not r.literals for r in pattern_rules):
        raise ValueError("every pattern rule needs a literal token")
    bounded_batches(pages.sparkSession)
    source = col(url)
    names = {}
    for wanted in ("host", "path", "rule", "pattern", "verdict"):
        names[wanted] = free_name(pages, wanted)
    out = pages.withColumns({names["host"]: url_host(source), names["path"]: url_path(source)})
    host, path = col(names["host"]), col(names["path"])
    none = F.lit(None).cast("string")
    fits = F.struct(F.lit(-1).alias("length"), F.lit(-1).alias("number"), none.alias("name"), none.alias("verdict"))
    fits = reduce(
        F.greatest,
        [longest_rule(k, rules)(host, path) for k, rules in rule_blocks(host_rules, lambda r: len(r.name))],
        fits,
    )
    index = rarest_literals(pages, url, pattern_rules) if pattern_rules else {}
    found = [
        first_pattern(index, rules, k)(source)
        for k, rules in rule_blocks(pattern_rules, lambda r: len(r.pattern) + sum(map(len, r.literals)))
    ]
    fit = free_name(out, "fit")
    out = out.withColumns({fit: fits, names["pattern"]: F.coalesce(none, *found)})
    method = F.when(col(names["pattern"]).isNotNull(), "block").otherwise("allow")
    return out.select(
        *[col(c) for c in (*pages.columns, names["host"], names["path"])],
        col(fit)["name"].alias(names["rule"]), col(names["pattern"]),
        F.coalesce(col(fit)["verdict"], method).alias(names["verdict"]),
    )
