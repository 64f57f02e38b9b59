"""A1 for exports of any size: one JSON document read by many tasks.

An export is one JSON value, often on one line, so a line reader gives all of it to one task. Here
a file is cut into byte ranges. A first pass counts, per range, how it changes the place in the
document (inside a string or not, nesting depth); summed up in order, that tells where every range
begins. Then each range finds the events that begin in it and cuts their text out, and Spark's own
JSON functions parse it. Buckets and their attributes come from a third pass that returns only
members outside the events, and are joined by their place in the file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.session import cut_lineage
from dayloom.sources.buckets import EVENT

#: Bytes of a range, and of what is read beyond it at first to finish its last value.
RANGE_BYTES, AHEAD_BYTES = 32 << 20, 1 << 20
#: Longest member name outside events, as written.
NAME_BYTES = 1 << 16
#: Nesting depth inside the root, the buckets, one bucket, and its list of events.
ROOT, BUCKETS, BUCKET, EVENTS = 1, 2, 3, 4

_STEP = np.zeros(256, dtype=np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "{}[]:,"]] = True


def _open_file(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    scheme = "s3" if parts.scheme in ("s3a", "s3n") else parts.scheme
    system, name = fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}{parts.path}")
    return system.open_input_file(name)


def _escapes_first(data: bytes) -> bool:
    """Whether text that ends like ``data`` escapes the byte that follows."""
    return (len(data) - len(data.rstrip(b"\\"))) % 2 == 1


@dataclass
class Marks:
    """Structural bytes of a piece of JSON text: positions, bytes, and the depth after each."""

    at: np.ndarray
    byte: np.ndarray
    depth: np.ndarray


def quotes_of(data: bytes, escaped: bool) -> np.ndarray:
    """Positions of the quotes that open or close a string; ``escaped``: the first byte is."""
    a = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(a == ord('"'))
    hidden = [
        m.end() for m in re.finditer(rb"\\+", data)
        if (m.end() - m.start() + (escaped and m.start() == 0)) % 2
    ]
    if escaped and not data.startswith(b"\\"):
        hidden.append(0)
    return quotes[~np.isin(quotes, hidden)] if hidden else quotes


def marks_of(data: bytes, quotes: np.ndarray, in_string: bool, depth: int) -> Marks:
    """The structural bytes outside strings."""
    a = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(_MARK[a])
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    return Marks(at, a[at], depth + np.cumsum(_STEP[a[at]]))


def _changes(path: str, lo: int, hi: int) -> tuple[int, int, int]:
    """Quotes of a range, and how it changes the depth if it begins outside or inside a string."""
    with _open_file(path) as f:
        data, escaped = _read(f, lo, hi)
    quotes = quotes_of(data, escaped)
    ends = [marks_of(data, quotes, inside, 0).depth for inside in (False, True)]
    return len(quotes), *[int(d[-1]) if len(d) else 0 for d in ends]


def _read(f, lo: int, hi: int) -> tuple[bytes, bool]:
    """The bytes of a range, and whether what stands before escapes the first of them."""
    before, back = b"", 64
    while lo and not before.strip(b"\\") and len(before) < lo:
        before = f.read_at(min(lo, back), lo - min(lo, back))
        back *= 16
    return f.read_at(hi - lo, lo), _escapes_first(before)


class Range:
    """A byte range of a file with its marks, read on as far as its last value goes."""

    def __init__(self, path: str, lo: int, hi: int, size: int, in_string: bool, depth: int):
        self.path, self.lo, self.hi, self.size = path, lo, hi, size
        self.in_string, self.depth = in_string, depth

    def load(self, ahead: int) -> bool:
        """Read the range and ``ahead`` bytes; tells whether the file ends there."""
        end = min(self.size, self.hi + ahead)
        with _open_file(self.path) as f:
            self.data, escaped = _read(f, self.lo, end)
            self.before = f.read_at(min(self.lo, NAME_BYTES), max(0, self.lo - NAME_BYTES))
        self.marks = marks_of(self.data, quotes_of(self.data, escaped), self.in_string, self.depth)
        return end == self.size

    def name_before(self, at: int) -> str:
        """The member name in front of the colon at ``at``, as written."""
        text = (self.before + self.data[max(0, at - NAME_BYTES) : at] if at < NAME_BYTES else self.data[at - NAME_BYTES : at]).rstrip()
        end = len(text) - 1
        begin = text.rfind(b'"', 0, end)
        while begin > 0 and _escapes_first(text[:begin]):
            begin = text.rfind(b'"', 0, begin)
        return text[begin : end + 1].decode("utf-8")

    def close_of(self, k: int, depth: int) -> int | None:
        """The first mark after mark ``k`` that closes a value inside ``depth``, else None."""
        m = self.marks
        found = np.flatnonzero((m.depth[k + 1 :] == depth) & (_STEP[m.byte[k + 1 :]] < 0))
        return k + 1 + int(found[0]) if len(found) else None

    def events(self) -> list[tuple[int, int, str]] | None:
        """(place, place of the last colon of a bucket before, text) of events that begin here.

        None if the text that was read does not hold the end of the last one.
        """
        m = self.marks
        opens = np.flatnonzero((m.depth == EVENTS + 1) & (_STEP[m.byte] > 0))
        opens = opens[m.at[opens] < self.hi - self.lo]
        closes = np.flatnonzero((m.depth == EVENTS) & (_STEP[m.byte] < 0))
        colons = m.at[(m.depth == BUCKET) & (m.byte == ord(":"))]
        last = np.searchsorted(closes, opens, "right")
        if len(last) and last[-1] >= len(closes):
            return None
        out = []
        for begin, end in zip(m.at[opens].tolist(), m.at[closes[last]].tolist(), strict=True):
            if self.data[begin] == ord("{"):
                k = int(np.searchsorted(colons, begin))
                member = self.lo + int(colons[k - 1]) if k else -1
                out.append((self.lo + begin, member, self.data[begin : end + 1].decode("utf-8")))
        return out

    def members(self) -> list[tuple[int, int, str | None, str | None, bool]] | None:
        """(place, depth, name, value, is a list of events) of members outside events; depth 0: a root."""
        m, out = self.marks, []
        inside = m.at < self.hi - self.lo
        roots = inside & (m.depth == ROOT) & (m.byte == ord("{"))
        named = inside & (m.depth <= BUCKET) & (m.byte == ord(":"))
        for k in np.flatnonzero(roots | named).tolist():
            at, depth = int(m.at[k]), int(m.depth[k])
            if m.byte[k] == ord("{"):
                out.append((self.lo + at, 0, None, None, False))
                continue
            name, value, listed = self.name_before(at), None, False
            if depth != BUCKETS:
                if k + 1 >= len(m.at):
                    return None
                after = int(m.at[k + 1])
                nested = _STEP[m.byte[k + 1]] > 0
                listed = depth == BUCKET and m.byte[k + 1] == ord("[") and json.loads(name) == "events"
                if not nested:
                    value = self.data[at + 1 : after].decode("utf-8").strip()
                elif depth == BUCKET and not listed:
                    end = self.close_of(k + 1, depth)
                    if end is None:
                        return None
                    value = self.data[after : int(m.at[end]) + 1].decode("utf-8")
            out.append((self.lo + at, depth, name, value, listed))
        return out

    def whole(self, what: str, ahead: int) -> list[tuple]:
        """``events`` or ``members``, with as much text read beyond the range as they need."""
        while True:
            at_end = self.load(ahead)
            found = getattr(self, what)()
            if found is not None:
                return found
            if at_end:
                raise ValueError(f"{self.path} ends inside a value")
            ahead *= 4


_PLACE = "path string, lo long, hi long, size long"


def _spread(ranges: DataFrame) -> DataFrame:
    """One task for every few ranges."""
    return ranges.repartition(max(1, min(100_000, ranges.count())), "path", "lo")


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The byte ranges of all files under ``path``, with the place in the document each begins at."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    ranges = listed.filter("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("lo")
    ).select("path", "lo", F.least(F.col("lo") + range_bytes, "size").alias("hi"), "size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*r, *_changes(*r[:3])) for r in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["path", "lo", "hi", "size", "quotes", "outside", "inside"])

    counted = _spread(ranges).mapInPandas(run, f"{_PLACE}, quotes long, outside long, inside long")
    earlier = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda value: F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return (
        counted.withColumn("in_string", F.pmod(sum_of("quotes"), F.lit(2)) == 1)
        .withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
        .withColumn("depth", sum_of("change"))
        .select("path", "lo", "hi", "size", "in_string", "depth")
    )


def _scan(ranges: DataFrame, what: str, fields: str, ahead: int) -> DataFrame:
    names = ["path", "lo", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                found = Range(*row).whole(what, ahead)
                for a in range(0, len(found), 10_000):
                    yield pd.DataFrame([(row[0], row[1], *f) for f in found[a : a + 10_000]], columns=names)

    return _spread(ranges).mapInPandas(run, f"path string, lo long, {fields}")


def _text(value: Column) -> Column:
    """A JSON value as text: strings without quotes, all else as written."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]


def read_exports(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, ahead_bytes: int = AHEAD_BYTES
) -> DataFrame:
    """Raw events (``RAW_SCHEMA``) of exports ``{"user_id": ..., "buckets": {id: {..., "events": [...]}}}``.

    Files hold one export or several, one after the other, on one line or on many. A task holds a
    range of ``range_bytes`` and what the last event in it needs beyond. ``seq`` is the event's place
    in its file, so it is in input order as in :func:`~dayloom.sources.buckets.read_buckets`, though
    not the same number; nested ``data`` may be spaced otherwise. An attribute that a bucket has twice counts with its last value; missing ones
    are null. Empty files and lists give no rows; a file that ends inside a value is an error. The two
    first passes run when this is called; ranges and members are kept by a checkpoint.
    Member names outside events are at most ``NAME_BYTES`` long. Files must be UTF-8 and uncompressed.
    """
    ranges = cut_lineage(file_ranges(spark, path, range_bytes))
    members = cut_lineage(
        _scan(ranges, "members", "at long, level int, name string, value string, listed boolean", ahead_bytes)
    )
    begins = ranges.select("path", F.col("lo").alias("at"), "lo", F.lit(-1).alias("level"))
    upto = Window.partitionBy("path").orderBy("at", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda value, level: F.last(F.when(F.col("level") == level, value), ignorenulls=True).over(upto)
    placed = members.unionByName(begins, allowMissingColumns=True).select(
        "path", "lo", "at", "level", "name", "value", "listed",
        last(F.col("at"), 0).alias("root_at"), last(F.col("name"), ROOT).alias("section"),
        last(F.col("at"), BUCKETS).alias("bucket_at"), last(F.col("name"), BUCKETS).alias("bucket"),
        last(F.col("at"), BUCKET).alias("running"),
    )
    name = _text(F.col("name"))
    attribute = lambda n: F.max_by(F.col("value"), F.when(name == n, F.col("at")))
    users = placed.filter(F.col("level") == ROOT).groupBy("path", "root_at").agg(
        _text(attribute("user_id")).alias("user_id")
    )
    inside = placed.filter((F.col("level") == BUCKET) & (_text(F.col("section")) == "buckets"))
    buckets = inside.groupBy("path", "root_at", "bucket_at").agg(
        _text(F.max("bucket")).alias("bucket"), _text(attribute("type")).alias("type"),
        _text(attribute("hostname")).alias("hostname"), _text(attribute("data")).alias("bucket_data"),
        F.collect_list(F.when(F.col("listed"), F.col("at"))).alias("lists"),
    )
    # Spark takes rows found in a range for as small as the range's own row: it would broadcast them all
    known = buckets.join(users.hint("merge"), ["path", "root_at"], "left").withColumn("list_at", F.explode("lists")).drop("lists")
    # a range meets the list that runs into it and those that begin in it: no key holds more than a range
    met = placed.filter("listed").select("path", "lo", F.col("at").alias("member"), F.col("at").alias("list_at")).unionByName(
        placed.filter("level = -1").select("path", "lo", F.lit(-1).cast("long").alias("member"), F.col("running").alias("list_at"))
    )
    lists = met.join(known.hint("merge"), ["path", "list_at"]).select("path", "lo", "member", "user_id", "bucket", "type", "hostname", "bucket_data")
    events = _scan(ranges, "events", "at long, member long, event string", ahead_bytes)
    return events.withColumn("e", F.from_json("event", EVENT)).join(lists.hint("merge"), ["path", "lo", "member"]).select(
        "user_id", "bucket", "type", "hostname", "bucket_data", F.col("at").alias("seq"), "e.timestamp", "e.duration", "e.data"
    )
