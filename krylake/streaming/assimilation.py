"""Streams with typed state: trails by key, latest-wins snapshots, expiring incidents, settings from commands, windows.

State is one value of typed columns and arrays a key, of a size that doesn't grow with the stream. It is read and written once
for the rows that a batch has of the key, and rows come as rows: a call to the state's server and a frame of pandas cost
as much as some hundred rows. What a key's state says depends on the rows, not on how they were cut into batches: rows are
ordered by (ts, event_id), and those of an earlier time that a later batch brings are put in their place.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from krylake.streaming.replay import drained

PANELS_EACH, MOST_PANELS = 20, 500
KEPT_COMMANDS = MOST_PANELS // PANELS_EACH  # more of them change nothing: the number of panels is clamped


NO_TIME = -(1 << 63)  # of rows without ts: before all others


def at(ts: str = "ts"):
    """Microseconds of a time."""
    return F.coalesce(F.unix_micros(ts), F.lit(NO_TIME)).alias("at")


class Trails(StatefulProcessor):
    """The last `keep` (time, event, value) of a key."""

    def __init__(self, key: str, keep: int):
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at array<long>, event_id array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        both = [(r["at"], r["event_id"], r["value"]) for r in rows]
        if (old := self.held.get()) is not None:
            both = [*zip(*old, strict=True), *both]
        both = sorted(both, key=lambda r: r[:2])[-self.keep :]
        self.held.update(tuple(list(x) for x in zip(*both, strict=True)))
        values = [v for _, _, v in both if v is not None]
        yield Row(**{self.key: key[0], "n": len(both), "newest": both[-1][1], "mean": sum(values) / len(values) if values else None})

    def close(self) -> None:
        pass


def trails(events: DataFrame, key: str, keep: int = 80) -> DataFrame:
    """(key, n, newest, mean) of each key that a batch has rows of: of its last `keep` values, whatever order they come in."""
    rows = events.select(key, at(), "event_id", F.col("value").cast("double"))
    return rows.groupBy(key).transformWithState(Trails(key, keep), f"{key} long, n long, newest long, mean double", "Update", "None")


def latest_wins(events: DataFrame, key: str) -> DataFrame:
    """The last snapshot of each key: a batch hands on only its newest rows, those between are dropped."""

    def newest(df: DataFrame, _: int) -> DataFrame:
        return df.groupBy(key).agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))

    return drained(events, each=newest).groupBy(key).agg(F.max("m").alias("m")).select(key, F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


class Incidents(StatefulProcessor):
    """The incidents of a key (event and time of its beginning) since its last clearing, whose time goes along; a timer frees them once the last has ended."""

    def __init__(self, key: str, starts: str, clears: str, seconds: int):
        self.key, self.starts, self.clears, self.span = key, starts, clears, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "newest long, cleared long, cleared_by long, event_id array<long>, at array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, cleared, events, times, timer = 0, (-(1 << 62), -1), [], [], -1
        if (old := self.seen.get()) is not None:
            newest, *cleared, events, times, timer = old
        begun, cleared = dict(zip(events, times, strict=True)), tuple(cleared)
        for r in rows:
            newest = max(newest, r["at"])
            if r["event_type"] == self.clears:
                cleared = max(cleared, (r["at"], r["event_id"]))
            if r["event_type"] == self.starts:
                begun[r["event_id"]] = r["at"]
        begun = {e: t for e, t in begun.items() if (t, e) > cleared and t > newest - self.span}
        ends = -(-(max(begun.values(), default=-self.span) + self.span) // 1000)
        if begun and ends != timer:  # one a key
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
            timer = ends
        self.seen.update((newest, *cleared, list(begun), list(begun.values()), timer))
        yield Row(**{self.key: key[0], "at": newest, "active": len(begun)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Incidents that have lasted go, also where a key has no more events; what has been told of the key at its newest event stands."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        newest, cleared, cleared_by, events, times, timer = self.seen.get()
        left = [(e, t) for e, t in zip(events, times, strict=True) if t + self.span > now * 1000]
        self.seen.update((newest, cleared, cleared_by, [e for e, _ in left], [t for _, t in left], -1 if timer == now else timer))
        return iter([])

    def close(self) -> None:
        pass


def active_incidents(events: DataFrame, key: str, starts: str, clears: str, seconds: int, delay: str = "1 day") -> DataFrame:
    """(key, at, active) of each key that a batch has rows of: at its newest event, the incidents that began after its last clearing and haven't lasted `seconds` yet.

    A clearing that comes late ends what began before it; an incident that comes late counts unless it was cleared since. Timers by event time,
    under a watermark of `delay`, free the state of keys without further events."""
    timed = events.withWatermark("ts", delay).select(key, "ts", at(), "event_id", "event_type")
    return timed.groupBy(key).transformWithState(Incidents(key, starts, clears, seconds), f"{key} long, at long, active long", "Update", "EventTime")


class Settings(StatefulProcessor):
    """A shape's newest commands since it was removed (event and value), and when that was. Older ones are forgotten once they can't change a clamped setting."""

    def __init__(self, key: str, removes: str, ttl_ms: int | None):
        self.key, self.removes, self.ttl = key, removes, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.commands = handle.getValueState("commands", "removed long, event_id array<long>, value array<double>", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        gone, events, values = -1, [], []
        if (old := self.commands.get()) is not None:
            gone, events, values = old
        held = dict(zip(events, values, strict=True))
        for r in rows:
            if r["action"] == self.removes:
                gone = max(gone, r["event_id"])
            else:
                held[r["event_id"]] = r["value"]
        kept = sorted(e for e in held if e > gone)[-KEPT_COMMANDS:]
        self.commands.update((gone, kept, [held[e] for e in kept]))
        yield Row(**{self.key: key[0], "event_id": max([gone, *kept]), "alive": bool(kept), "value": held[kept[-1]] if kept else None, "n": len(kept)})

    def close(self) -> None:
        pass


def settings(commands: DataFrame, key: str, removes: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, event_id, alive, value, n) of each shape that a batch commands: whether it is there, its last value and its commands since it was removed, up to KEPT_COMMANDS.

    commands: key, event_id, action, value; event_id orders them. `ttl_ms`: forget shapes without commands for so long."""
    rows = commands.select(key, "event_id", "action", F.col("value").cast("double"))
    return rows.groupBy(key).transformWithState(Settings(key, removes, ttl_ms), f"{key} long, event_id long, alive boolean, value double, n long", "Update", "ProcessingTime" if ttl_ms else "None")


def windowed(events: DataFrame, width: str, delay: str, every: str | None = None) -> DataFrame:
    """Counts and sums by window of `width` (a new one `every` so often, which may overlap) and type; late events beyond `delay` are dropped, windows are given once closed."""
    w = F.window("ts", width, every) if every else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def last_of(updates: DataFrame, key: str, *columns: str) -> DataFrame:
    """What the last batch that has a row of a key says of it."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in columns])
