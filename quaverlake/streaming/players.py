"""State of players in a stream: plays and skips counted once, and radio queues that refill.

Both run with ``transformWithState``, keyed by player; the state lies in the query's
checkpoint, so that a restarted query goes on where it was.
"""

from __future__ import annotations

import contextlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.lists import ENERGY_WIDTH, arc
from ..operators.shared import kept

#: A play is half of an item or so many seconds; a skip leaves after some seconds and before a third.
PLAYED_SHARE, PLAYED_SECONDS, SKIP_AFTER, SKIP_SHARE = 0.5, 240.0, 3.0, 0.33
OUTCOME = "player long, item long, started timestamp, kind string, at timestamp"
#: Outcomes as the processor gives them: times in microseconds.
TOLD = "player long, item long, started long, played boolean, at long"
#: The reports of a player that wait are one binary value of such records.
REPORT = np.dtype([("event_id", "<i8"), ("at", "<i8"), ("item", "<i8"), ("position", "<f8"), ("duration", "<f8")])
#: Stands for a null ``event_id``: such reports come last of their time, and none of them repeats another.
NO_ID = 2**63 - 1
START = "item long, started long, last long, position double, duration double, played boolean"


def is_played(position: float, duration: float) -> bool:
    return duration > 0 and position >= min(duration * PLAYED_SHARE, PLAYED_SECONDS)


def is_skipped(position: float, duration: float) -> bool:
    return duration > 0 and SKIP_AFTER < position < duration * SKIP_SHARE


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that ``transformWithState`` needs, for queries started meanwhile."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class PlayCounter(StatefulProcessor):
    """Reports of a player wait until the watermark has passed them, and are then taken in order of time.

    What stays of a player is the reports that wait, and the item that plays: a start,
    with the last position and whether it counts as played already.  A start ends with
    a report of another item, or when nothing is reported for ``idle`` milliseconds,
    for which a timer stands.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("reports", "packed binary")
        self.start = handle.getValueState("start", START)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = np.array([(r.event_id, r.at, r.item, r.position, r.duration) for r in rows], dtype=REPORT)
        reports = np.concatenate([self._waiting(), new])
        first = reports["event_id"] == NO_ID
        first[np.unique(reports["event_id"], return_index=True)[1]] = True
        self._wait(reports[first])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, told = timerValues.getCurrentWatermarkInMs(), []
        reports = self._waiting()
        past = reports["at"] // 1000 <= now
        ready = reports[past]
        start = self.start.get()
        for _, at, item, position, duration in ready[np.lexsort((ready["event_id"], ready["at"]))].tolist():
            if start and (start[0] != item or (at - start[2]) // 1000 > self.idle):
                told += self._left(start)
                start = None
            item, started, _, _, _, played = start or (item, at, at, position, duration, False)
            if not played and is_played(position, duration):
                told.append((item, started, True, at))
                played = True
            start = (item, started, at, position, duration, played)
        if start and start[2] // 1000 + self.idle < now:
            told += self._left(start)
            start = None
        if start:
            self.start.update(start)
            self.handle.registerTimer(start[2] // 1000 + self.idle + 1)
        else:
            self.start.clear()
        self._wait(reports[~past])
        return (Row(player=key[0], item=item, started=started, played=played, at=at) for item, started, played, at in told)

    def _waiting(self) -> np.ndarray:
        found = self.waiting.get()
        return np.frombuffer(found[0] if found else b"", dtype=REPORT)

    def _wait(self, reports: np.ndarray) -> None:
        if len(reports):
            self.waiting.update((reports.tobytes(),))
            self.handle.registerTimer(int(reports["at"].min()) // 1000)
        else:
            self.waiting.clear()

    @staticmethod
    def _left(start: tuple) -> list[tuple]:
        item, started, last, position, duration, played = start
        return [(item, started, False, last)] if not played and is_skipped(position, duration) else []

    def close(self) -> None:
        pass


def plays_and_skips(reports: DataFrame, late: str = "1 hour", idle_seconds: int = 43200) -> DataFrame:
    """Plays and skips of a stream of reports (``event_id``, ``ts``, ``player``, ``item``, ``position``, ``duration``).

    A start (reports of one item in a row, without a pause of ``idle_seconds``) counts as
    played once, at the first report that is far enough; a start that does not, and is
    left early, as skipped.  Repeated reports have one ``event_id`` and count once;
    reports may come up to ``late`` after others of later time.  Reports without a
    player, item or time are left out.

    What waits of a player is written and read as one value: as a list state, each
    report is a row that travels by itself to and from the store, at every batch.
    """
    whole = reports.where("player IS NOT NULL AND item IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = whole.select("player", "ts", F.coalesce("event_id", F.lit(NO_ID)).alias("event_id"), F.unix_micros("ts").alias("at"), F.col("item").cast("long").alias("item"), *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("position", "duration")])
    told = rows.groupBy("player").transformWithState(PlayCounter(idle_seconds * 1000), TOLD, "append", "eventTime")
    kind = F.when(F.col("played"), "played").otherwise("skipped")
    return told.select("player", "item", F.timestamp_micros("started").alias("started"), kind.alias("kind"), F.timestamp_micros("at").alias("at"))


QUEUE_STEP = "player long, event_id long, item long, place int, upcoming int, added array<long>, arc int, outcome string"
QUEUE = "items array<long>, place int, arc int, last long, last_event long"
CANDIDATE = "array<struct<id:bigint,artist:string,energy:double,toss:double,toss2:double>>"
#: Candidates of so many items in so many packed bytes at most are part of the processor, which Spark sends whole to each task (up to 1 MB); those of other items travel with their reports.
MOST_HEADS, HELD_BYTES = 4096, 600_000


def radio_picks(head: list[dict], size: int, spacing: int, variety: float, kind: str, position: int, excluded: set[int]) -> list[int]:
    """The ids that one refill takes of candidates in order: a coin for variety, one for energy against the arc, and artist spacing."""
    taken, artists = [], []
    for c in head:
        if len(taken) >= size:
            break
        if c["id"] in excluded:
            continue
        if variety > 0:
            if c["toss"] >= 1.0 / (1.0 + variety):
                continue
            if c["energy"] is not None and not np.isnan(c["energy"]):
                z = (c["energy"] - arc(kind, len(taken), position)) / ENERGY_WIDTH
                if c["toss2"] >= np.exp(-z * z / 2):
                    continue
        if c["artist"] and c["artist"] in (artists[-spacing:] if spacing else artists):
            continue
        taken.append(c["id"])
        artists.append(c["artist"])
    return taken


def packed(head: list) -> bytes:
    return zlib.compress(pickle.dumps([tuple(c) for c in head]))


def unpacked(head: bytes) -> list[dict]:
    return [dict(zip(("id", "artist", "energy", "toss", "toss2"), c, strict=True)) for c in pickle.loads(zlib.decompress(head))]


class RadioQueue(StatefulProcessor):
    """A player's queue, the place in it, and how far its arc has come.

    A report of an item that is coming up moves the place there; any other item starts
    what comes after it anew.  With fewer than ``low`` items from the place on, up to
    ``size`` are added that the last ``remembered`` items don't hold.
    """

    def __init__(self, held: dict[int, bytes], size: int, low: int, remembered: int, spacing: int, variety: float, kind: str):
        self.held = held  # packed candidates by item
        self.size, self.low, self.remembered, self.spacing, self.variety, self.kind = size, low, remembered, spacing, variety, kind

    def init(self, handle) -> None:
        self.queue = handle.getValueState("queue", QUEUE)
        self.heads = {item: unpacked(head) for item, head in self.held.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items, place, position, last, last_event = tuple(self.queue.get()) if self.queue.exists() else ([], -1, 0, -1, -1)
        items, out = list(items), []
        reports = [r for frame in rows for r in frame.to_dict("records")]
        for r in sorted(reports, key=lambda r: (r["at"], r["event_id"])):
            if (r["at"], r["event_id"]) <= (last, last_event):
                continue  # repeated, or older than what is known to play
            last, last_event, item = r["at"], r["event_id"], r["item"]
            if item in items[place + 1 :]:
                place = items.index(item, place + 1)
            elif place < 0 or items[place] != item:
                items, place = [*items[: place + 1], item], place + 1
            outcome, added = "enough", []
            if len(items) - place < self.low:
                head = self.heads.get(item, r.get("head"))
                head = head if head is not None else []
                # the last items alone are passed over by the walk; what the queue holds anyway is not added again
                picks = radio_picks(head, self.size, self.spacing, self.variety, self.kind, position, {item, *items[-self.remembered :]})
                have = set(items)
                added = [i for i in picks if i not in have]
                items += added
                position += len(added)
                outcome = "added" if added else "nothing more"
            out.append((key[0], r["event_id"], item, place, len(items) - place - 1, added, position, outcome))
        # what lies further back than is remembered has no bearing on anything to come
        cut = max(0, min(place, len(items) - self.remembered))
        items, place = items[cut:], place - cut
        if last >= 0:
            self.queue.update((items, place, position, last, last_event))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in QUEUE_STEP.split(", ")]).astype({"outcome": object})

    def close(self) -> None:
        pass


def radio_queues(reports: DataFrame, heads: DataFrame, size: int = 20, low: int = 5, remembered: int = 100, spacing: int = 3, variety: float = 3.0, kind: str = "flat") -> DataFrame:
    """A row for each report (``event_id``, ``ts``, ``player``, ``item``) with what it does to the player's queue.

    ``heads`` has for each item (``seed_id``) the candidates to refill from, ``head``, an
    array of ``CANDIDATE`` in order.  A report that repeats, or is older than one taken
    before, says nothing about what plays now and is passed over.  A place counts from
    the queue's first remembered item of its batch.

    Candidates that the coin for variety passes over are left out beforehand, as it
    depends on the item and the candidate alone.  What is left of the first items,
    up to ``HELD_BYTES``, is held by each task, so that their reports shuffle without it.
    """
    rows = reports.where("player IS NOT NULL AND item IS NOT NULL AND ts IS NOT NULL").select("player", "event_id", F.unix_micros("ts").alias("at"), F.col("item").cast("long").alias("item"))
    candidates = F.col("head").cast(CANDIDATE)
    if variety > 0:
        candidates = F.filter(candidates, lambda c: ~(c["toss"] >= 1.0 / (1.0 + variety)))
    possible = kept(heads.select(F.col("seed_id").cast("long").alias("item"), candidates.alias("head")), "heads")
    held, size_held = {}, 0
    for r in possible.orderBy("item").limit(MOST_HEADS).toLocalIterator():
        head = packed(r["head"] or [])
        size_held += len(head)
        if size_held > HELD_BYTES:
            break
        held[r["item"]] = head
    rest = possible.where(F.col("item") > max(held, default=-(2**63)))
    met = rows if rest.isEmpty() else rows.join(rest, "item", "left")
    processor = RadioQueue(held, size, low, remembered, spacing, variety, kind)
    return met.groupBy("player").transformWithStateInPandas(processor, QUEUE_STEP, "append", "none")


def radio_heads(ranking: DataFrame, energy: DataFrame | None, length: int) -> DataFrame:
    """``heads`` for ``radio_queues``: the first ``length`` candidates of each seed of a ranking, with their tosses."""
    from ..functions import text

    rows = ranking.where(F.col("rank") <= length)
    rows = rows.withColumn("energy", F.lit(None).cast("double")) if energy is None else rows.join(energy.select("id", "energy"), "id", "left")
    one = F.struct(
        "rank", F.col("id").cast("bigint").alias("id"), F.col("artist").cast("string").alias("artist"), F.col("energy").cast("double").alias("energy"),
        text.hash_unit(F.lit("radio"), F.col("seed_id"), F.col("id")).alias("toss"), text.hash_unit(F.lit("energy"), F.col("seed_id"), F.col("id")).alias("toss2"),
    )
    ordered = rows.groupBy("seed_id").agg(F.array_sort(F.collect_list(one)).alias("head"))
    return ordered.select("seed_id", F.transform("head", lambda c: F.struct(*[c[n].alias(n) for n in ("id", "artist", "energy", "toss", "toss2")])).alias("head"))


def written(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream of appended rows over all that is there, into Parquet files."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
