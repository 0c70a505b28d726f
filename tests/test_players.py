"""Keyed state of players: once-only plays, late and repeated reports, restarts, radio queues."""

from __future__ import annotations

import datetime
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quaverlake import registry
from quaverlake.operators import lists
from quaverlake.operators.shared import shared_folder
from quaverlake.streaming import players

BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "event_id long, ts timestamp, player long, item long, position double, duration double"


def report(event, minutes, player, item, position, duration=200.0):
    return (event, BEGIN + datetime.timedelta(minutes=minutes), player, item, None if position is None else float(position), duration)


def plain_outcomes(rows, idle_minutes=60):
    """Plays and skips of reports that are all known at once."""
    out = []
    for player in {r[2] for r in rows}:
        starts = []
        for _, ts, _, item, position, duration in sorted({r for r in rows if r[2] == player}, key=lambda r: (r[1], r[0])):
            if not starts or starts[-1]["item"] != item or ts - starts[-1]["last"] > datetime.timedelta(minutes=idle_minutes):
                starts.append({"item": item, "started": ts, "played": None})
            s = starts[-1] | {"last": ts, "position": position, "duration": duration}
            if s["played"] is None and position >= min(duration / 2, 240):
                s["played"] = ts
            starts[-1] = s
        for s in starts:
            if s["played"] is not None:
                out.append((player, s["item"], s["started"], "played", s["played"]))
            elif 3 < s["position"] < s["duration"] * 0.33:
                out.append((player, s["item"], s["started"], "skipped", s["last"]))
    return sorted(out)


@pytest.fixture
def run(spark, tmp_path):
    """Appends files of reports, and runs the stream over what is new; a new query each time, from one checkpoint."""
    (tmp_path / "in").mkdir()

    def go(*batches):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        players.written(players.plays_and_skips(stream, "30 minutes", 3600), f"{tmp_path}/out", f"{tmp_path}/progress")
        found = spark.read.schema(players.OUTCOME).parquet(f"{tmp_path}/out").collect()
        return sorted((r.player, r.item, r.started.astimezone(datetime.UTC), r.kind, r.at.astimezone(datetime.UTC)) for r in found)

    return go


def test_once_only_late_and_repeated(run):
    first = [report(1, 0, 1, 7, 5), report(2, 2, 1, 7, 110), report(3, 3, 1, 7, 190), report(4, 5, 1, 8, 4)]
    late = [report(5, 4, 1, 7, 199), report(2, 2, 1, 7, 110), report(6, 6, 1, 9, 250, 1000.0), report(6, 6, 1, 9, 250, 1000.0)]
    end = [report(7, 600, 2, 1, 1)]
    got = run(first, late, end)
    assert got == plain_outcomes(first + late)  # the last player's report still waits
    assert [(item, kind) for _, item, _, kind, _ in got] == [(7, "played"), (8, "skipped"), (9, "played")]


def test_idle_starts_anew_and_restart_keeps_state(run):
    rng = random.Random(5)
    rows = [report(k, rng.randrange(0, 4000), rng.randrange(3), rng.randrange(2), rng.choice([1.0, 20.0, 70.0, 130.0])) for k in range(120)]
    rows.sort(key=lambda r: r[1])
    run(rows[:40])
    run(rows[40:80])
    got = run(rows[80:], [report(999, 9000, 9, 1, 1)])
    assert got == plain_outcomes(rows)


def test_nulls_are_left_out(run):
    rows = [report(1, 0, None, 7, 150), report(2, 0, 1, None, 150), report(3, 0, 1, 5, None), report(4, 1, 1, 5, 150), (5, None, 1, 5, 150.0, 200.0)]
    assert [(p, i, k) for p, i, _, k, _ in run(rows, [report(9, 900, 9, 1, 1)])] == [(1, 5, "played")]


class OneValue:
    """A value state that counts its writes."""

    def __init__(self):
        self.value, self.writes = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


class Handle:
    """Values and timers of one player; there is no list state."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.values.setdefault(name, OneValue())

    def registerTimer(self, at):
        self.timers.append(at)


def test_waiting_reports_are_one_value():
    """However many reports of a player come or wait, they are one write; those without an id repeat nothing."""
    from pyspark.sql import Row

    def rows(ids):
        return iter([Row(event_id=k, at=1000 * (5 + n), item=7, position=float(n), duration=100.0) for n, k in enumerate(ids)])

    counter, handle = players.PlayCounter(60_000), Handle()
    counter.init(handle)
    none = players.NO_ID
    for ids in (range(500), [*range(400, 600), none, none]):
        assert list(counter.handleInputRows((1,), rows(ids), None)) == []
    assert sorted(v.writes for v in handle.values.values()) == [0, 2]
    assert len(counter._waiting()) == 602
    assert handle.timers == [5, 5]


def plain_queue(rows, heads, size=20, low=5, remembered=100):
    out, state = [], {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        items, place, position = state.get(r.player, ([], -1, 0))
        if r.item in items[place + 1 :]:
            place = items.index(r.item, place + 1)
        elif place < 0 or items[place] != r.item:
            items, place = [*items[: place + 1], r.item], place + 1
        added = []
        if len(items) - place < low:
            head = [c.asDict() for c in heads.get(r.item, [])]
            picks = players.radio_picks(head, size, 3, 3.0, "wave", position, {r.item, *items[-remembered:]})
            added = [i for i in picks if i not in items]
        items = items + added
        position += len(added)
        out.append((r.player, r.event_id, r.item, len(items) - place - 1, tuple(added), position))
        # only the remembered end of a queue can still exclude anything
        state[r.player] = (items, place, position)
    return sorted(out)


def test_radio_queues(spark):
    """One batch, so that nothing is forgotten between."""
    got = registry.queries()["stream_radio_queues"](spark, SF)
    from quaverlake.plans.registry import pool
    from quaverlake.plans.similarity import seed_pool_scores

    rows = pool(spark, SF)
    heads = players.radio_heads(lists.ranked(seed_pool_scores(rows, rows)), rows.select("id", F.element_at("vector", 1).alias("energy")), 200)
    heads = {r.seed_id: r.head for r in heads.collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", F.col("user_id").alias("player"), F.get_json_object("props", "$.k").cast("long").alias("item")).collect()
    want = plain_queue(events, heads)
    assert sorted((r.player, r.event_id, r.item, r.upcoming, tuple(r.added), r.arc) for r in got.collect()) == want
    assert any(w[4] for w in want)


def test_radio_picks_without_variety_is_a_spaced_walk():
    head = [{"id": k, "artist": "ab"[k % 2], "energy": None, "toss": 0.99, "toss2": 0.99} for k in range(8)]
    assert players.radio_picks(head, 3, 1, 0.0, "flat", 0, {0}) == [1, 2, 3]
    assert players.radio_picks(head, 3, 2, 0.0, "flat", 0, set()) == [0, 1]
    assert players.radio_picks(head, 3, 1, 3.0, "flat", 0, set()) == []


def test_reports_shuffle_without_candidates(spark, monkeypatch):
    """Candidates of a few items are held by the tasks; those of more travel with the reports, with the same queues."""
    reports = spark.createDataFrame([(k, BEGIN + datetime.timedelta(minutes=k), k % 2, k % 3) for k in range(24)], "event_id long, ts timestamp, player long, item long")
    heads = spark.createDataFrame([(s, [(100 * s + k, "abcd"[k % 4], None, k % 5 / 5, 0.1) for k in range(90)]) for s in range(3)], f"seed_id long, head {players.CANDIDATE}")
    folders = [str(shared_folder(spark, name)).removeprefix("file://") for name in ("reports", "one", "two")]
    reports.write.parquet(folders[0])
    got = []
    for most, folder in zip((4096, 1), folders[1:], strict=True):
        monkeypatch.setattr(players, "MOST_HEADS", most)
        steps = players.radio_queues(spark.readStream.schema(reports.schema).parquet(folders[0]), heads)
        assert ("Join" in steps._jdf.queryExecution().analyzed().toString()) == (most == 1)
        players.written(steps, folder, shared_folder(spark, "progress"))
        got.append(sorted((r.event_id, r.place, r.upcoming, tuple(r.added)) for r in spark.read.parquet(folder).collect()))
    assert got[0] == got[1]
    assert len(got[0]) == 24
    assert any(r[3] for r in got[0])
