"""J3 and D8 day by day: what a run needs of the past is read from summaries, not from events.

The store keeps, by day: events as they came, the resolved timeline (category runs of each user and
hour), exact hourly totals, and the readings of every instant that a request or one of its prior
times asked for. A run adds events and instants, derives the timeline and totals of the days that
the new events touch, and reads again the instants that can see those days: a look-back is 60 minutes
and seven days. Events themselves are scanned for the derived days and the day before only, since
none is longer than twelve hours.

Rows are put together when they are read, so a reading that late events changed reaches every
later request that has it among its last three.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.state_model import DEFAULT_STATE_MODEL, StateModel
from dayloom.functions.times import HOUR_US, from_us, to_us
from dayloom.operators.bins import bin_width
from dayloom.operators.states import behavior_of_totals, hourly_totals, state_columns, state_readings
from dayloom.operators.timeline import activity_union, resolve_bins
from dayloom.operators.window_features import KEY, feature_readings
from dayloom.plans.production import rows_of_readings, wanted_instants
from dayloom.sources.store import DayStore, with_missing
from dayloom.vocab import ACTIVITY_FEATURES, MAX_EVENT_SECONDS, WINDOW_MINUTES

_EVENT = {"seq": "bigint", "user_id": "string", "timestamp": "timestamp_ntz", "event_end": "timestamp_ntz"}
EVENTS = {
    "window": {**_EVENT, "source_type": "string", "app": "string", "category": "string"},
    "web": {**_EVENT, "source_type": "string", "category": "string"},
    "input": {**_EVENT, "duration_seconds": "double", "presses": "double", "clicks": "double", "mouse_distance": "double", "scroll_abs": "double"},
}
INSTANTS = {"user_id": "string", "timestamp": "timestamp_ntz", "requested": "boolean", "prior": "boolean"}
#: Days after an event whose instants can see it: seven days and the hour before, floored to an hour.
SEEN_DAYS = {"window": 8, "web": 8, "input": 1}
_DAY = dt.timedelta(days=1)


class Extension(NamedTuple):
    """What a run did: its number, the event days beyond the mark and before it, and the instants' days read again."""

    run: int
    new_days: list[dt.date]
    late_days: list[dt.date]
    read_days: list[dt.date]


def _after(days: set[dt.date], n: int) -> set[dt.date]:
    return {d + k * _DAY for d in days for k in range(n + 1)}


def _before(days: set[dt.date], n: int) -> set[dt.date]:
    return {d - k * _DAY for d in days for k in range(n + 1)}


class ActivityStore:
    """Events, summaries and readings of all users under ``path``.

    ``recut`` cuts switches and inputs at the request, as runtime rows do. Events are prepared ones
    (B2); one longer than twelve hours fails the run. An event counts once a run that holds it; runs
    are not compared with each other, but equal copies collapse in the timeline as in a single run.
    """

    def __init__(self, spark: SparkSession, path: str, model: StateModel = DEFAULT_STATE_MODEL, recut: bool = False):
        self.spark, self.model, self.recut = spark, model, recut
        self.store = DayStore(spark, path, appended=[*EVENTS, "instants"])

    @property
    def mark(self) -> dt.date | None:
        """The high-water mark: the last day with events."""
        return max((d for name in EVENTS for d in self.store.days(name)), default=None)

    def _events(self, days: set[dt.date] | None, pending: int | None = None) -> dict[str, DataFrame]:
        out = {}
        for name, columns in EVENTS.items():
            found = self.store.read(name, days, pending)
            if found is None:
                found = self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
            out[name] = found.select(*columns)
        return out

    def _written(self, run: int, name: str, rows: DataFrame) -> set[dt.date]:
        """Write events of one stream by their day of begin; returns the days they touch."""
        plain = with_missing(rows, EVENTS[name])
        plain = plain.withColumn("seq", F.coalesce("seq", F.lit(0)))
        if "source_type" in EVENTS[name]:
            plain = plain.withColumn("source_type", F.coalesce("source_type", F.lit(name)))
        length = to_us("event_end") - to_us("timestamp")
        fits = F.when(length <= MAX_EVENT_SECONDS * 1_000_000, F.to_date("timestamp")).otherwise(
            F.raise_error(F.lit(f"{name}: an event is longer than {MAX_EVENT_SECONDS} seconds")).cast("date")
        )
        days = self.store.write(run, name, plain.withColumn("date", fits))
        return _after(days, 1)  # an event reaches into the next day at most

    def extend(
        self, window: DataFrame | None = None, web: DataFrame | None = None, inputs: DataFrame | None = None,
        requests: DataFrame | None = None, prior: DataFrame | None = None, batch: str | None = None,
    ) -> Extension:
        """Add events, requests and prior times (``prior`` None: the requests themselves) and commit.

        Rows may be of any day: days before the mark are late, and what they change is derived anew.
        ``batch`` names the run: one of a name that was committed before changes nothing.
        """
        mark, store = self.mark, self.store
        run = store.begin()
        if batch is not None and store.holds(batch):
            return Extension(run - 1, [], [], [])
        given = {"window": window, "web": web, "input": inputs}
        touched = {name: self._written(run, name, rows) for name, rows in given.items() if rows is not None}
        began = {d for name in touched for d in store.pending[name]}

        asked = [(requests, True, prior is None), (prior, False, True)]
        parts = [
            t.select("user_id", "timestamp").distinct().withColumn("requested", F.lit(r)).withColumn("prior", F.lit(p))
            for t, r, p in asked if t is not None
        ]
        if parts:
            both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            store.write(run, "instants", with_missing(both, INSTANTS).withColumn("date", F.to_date("timestamp")))

        derived = touched.get("window", set()) | touched.get("web", set())
        if derived:
            self._derive(run, derived)
        stale = {d for name, days in touched.items() for d in _after(days, SEEN_DAYS[name])}
        read_days = (store.days("instants") & stale) | store.pending.get("instants", set())
        if read_days:
            self._read(run, read_days)
        store.commit(run, batch)
        late = sorted(d for d in began if mark is not None and d <= mark)
        return Extension(run, sorted(began - set(late)), late, sorted(read_days))

    def _derive(self, run: int, days: set[dt.date]) -> None:
        """Timeline and hourly totals of whole days, from their events and those of the day before."""
        events = self._events(_before(days, 1), run)
        activity = activity_union(events["window"], events["web"])
        width = bin_width(WINDOW_MINUTES)
        wanted = F.col("date").isin(sorted(days))
        runs = resolve_bins(activity, width, "category").withColumn("date", F.to_date(from_us(F.col("bin") * width)))
        self.store.write(run, "runs", runs.filter(wanted))
        hours = hourly_totals(activity).withColumn("date", F.to_date(from_us(F.col("hour_no") * HOUR_US)))
        self.store.write(run, "hours", hours.filter(wanted))

    def _read(self, run: int, days: set[dt.date]) -> None:
        """Readings of all instants of the given days."""
        instants = self.store.read("instants", days, run).select("user_id", to_us("timestamp").alias("req_us")).distinct()
        rows = self._readings(instants, days, run)
        self.store.write(run, "readings", rows.withColumn("date", F.to_date(from_us("req_us"))))

    def _readings(self, instants: DataFrame, days: set[dt.date], run: int | None) -> DataFrame:
        events = self._events(_before(days, 1), run)
        activity = activity_union(events["window"], events["web"])
        past = _before(days, max(SEEN_DAYS.values()))
        runs, hours = self.store.read("runs", past, run), self.store.read("hours", past, run)
        runs = resolve_bins(activity.filter("false"), bin_width(WINDOW_MINUTES), "category") if runs is None else runs.drop("date")
        hours = hourly_totals(activity.filter("false")) if hours is None else hours.drop("date")
        own = feature_readings(events["window"], events["web"], events["input"], instants, context=True, recut=self.recut, runs=runs)
        states = state_readings(activity, instants, self.model, totals=hours)
        return own.join(states, KEY)

    def features(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """The contract columns of the requests of the given days (all without)."""
        empty = self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in INSTANTS.items()))
        instants = self.store.read("instants")
        instants = empty if instants is None else instants
        readings = self.store.read("readings")
        if readings is None:
            readings = self._readings(empty.select("user_id", to_us("timestamp").alias("req_us")), set(), None)
        requests = instants.filter("requested").select("user_id", "timestamp").distinct()
        for day, keep in ((first, lambda d: F.to_date("timestamp") >= F.lit(d)), (last, lambda d: F.to_date("timestamp") <= F.lit(d))):
            requests = requests if day is None else requests.filter(keep(day))
        wanted = wanted_instants(requests, instants.filter("prior").select("user_id", "timestamp").distinct())
        rows = rows_of_readings(readings, wanted, state_columns(self.model.n_states))
        return rows.select("user_id", from_us("req_us").alias("timestamp"), *ACTIVITY_FEATURES)

    def hourly(self) -> DataFrame:
        """D8 from the hourly totals."""
        hours = self.store.read("hours")
        if hours is None:
            events = self._events(set())
            hours = hourly_totals(activity_union(events["window"], events["web"]))
        return behavior_of_totals(hours)
