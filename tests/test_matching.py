"""Entity matching against a plain loop over all candidates."""

from __future__ import annotations

import random
import re

import pytest

from quaverlake.operators import matching

SCHEMA = "id long, path string, artist string, title string, album string, seconds double"
VERSION = re.compile(r"\b(live|remix|karaoke|instrumental|acoustic|demo|edit)\b")


def key(s):
    plain = re.sub(r"[^a-z0-9]+", " ", re.sub(r"\(.*?\)", " ", (s or "").lower())).strip()
    return re.sub(r"^(the|a|an) ", "", plain)


def plain(source, catalog):
    out = []
    for i, path, artist, title, album, seconds in source:
        base, a, t, al = path.split("/")[-1].lower(), key(artist), key(title), key(album)
        tiers = (
            [c for c in catalog if c[1].split("/")[-1].lower() == base],
            [c for c in catalog if a and t and key(c[2]) == a and key(c[3]) == t],
            [c for c in catalog if a and t and key(c[3]) == t and key(c[2]) and (a in key(c[2]) or key(c[2]) in a)],
        )
        best = None
        for k, found in enumerate(tiers):
            ranked = []
            for c in found:
                drift = abs(c[5] - seconds) if (c[5] or 0) > 0 and (seconds or 0) > 0 else 999.0
                penalty = -2.0 * (al != "" and key(c[4]) == al) + 1.5 * (key(c[2]) == "various artists") + bool(VERSION.search(key(c[3])))
                ranked.append((0 if drift <= 2 else 1 if drift <= 8 else 2, penalty, drift, c[1], c[0]))
            ranked.sort()
            if not ranked:
                continue
            bucket, penalty, drift, _, match = ranked[0]
            ties = sum(r[0] == bucket and r[1] == penalty and abs(r[2] - drift) < 0.5 for r in ranked[1:])
            grade = ("exact", "strong", "probable")[k] if bucket == 0 else "probable" if bucket == 1 else "weak"
            if best is None or bucket == 0 or drift < best[0]:
                best = (drift, match, matching.TIERS[k], grade, ties)
            if bucket == 0:
                break
        out.append((i, *((best[1], best[2], best[3], round(best[0], 2), best[4]) if best else (None,) * 5)))
    return sorted(out, key=repr)


def catalogs(seed):
    rng = random.Random(seed)
    artists = ["Abba", "Abba Gold", "Various Artists", "The Who", "Who", "", None, "B"]
    titles = ["Song", "Song (x) Live", "Intro", "Other live", "", None]
    albums = ["One", "Two", "", None]
    seconds = lambda: rng.choice([None, 0.0, 100.0, 100.25, 101.0, 102.5, 105.0, 108.5, 130.0, 131.0, 163.0, 300.0, 1100.0, 1099.25, 20.0])
    rows = lambda n: [(k, f"d{rng.randrange(3)}/f{rng.randrange(12)}.mp3", rng.choice(artists), rng.choice(titles), rng.choice(albums), seconds()) for k in range(n)]
    return rows(60), rows(150)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resolve(spark, seed):
    source, catalog = catalogs(seed)
    got = matching.resolve(*(spark.createDataFrame(rows, SCHEMA) for rows in (source, catalog)))
    found = sorted(map(tuple, got.select("id", "match_id", "tier", "grade", "drift", "ties").collect()), key=repr)
    assert found == plain(source, catalog)


def test_no_pairs_of_a_title(spark):
    """A title of many rows makes as many rows as there are, not their square."""
    rows = lambda p: [(k, f"{p}{k}", "A", "Same", "One", 100.0 + k % 300) for k in range(3000)]
    one, other = (spark.createDataFrame(rows(p), SCHEMA) for p in "pq")
    asks, offers = matching.scopes(matching.keyed(one), matching.keyed(other))
    assert asks.count() <= 3 * 3000
    assert offers.count() <= 3 * 3000
    assert matching.resolve(one, other).where("ties <> 9 OR match_id % 300 <> id % 300").count() == 0


def test_report(spark):
    source = [(1, "a.mp3", "A", "T", "", 100.0), (2, "b/a.mp3", "A", "T", "", 100.0), (3, "zz.mp3", "Q", "None", "", 9.0), (4, "c.mp3", "A", "U", "", 200.0)]
    catalog = [(10, "x/a.mp3", "A", "T", "", 101.0), (11, "y/c2.mp3", "A", "U", "", 300.0)]
    one, other = (spark.createDataFrame(r, SCHEMA) for r in (source, catalog))
    rows = matching.report(one, matching.resolve(one, other))
    got = {r.id: (r.outcome, r.flagged, r.same_as, r.grade) for r in rows.collect()}
    assert got[1] == ("resolved", False, None, "exact")
    assert got[2][0] == "duplicate"
    assert got[2][2] == "a.mp3"
    assert got[3][0] == "residue"
    assert got[4][:2] == ("resolved", True)
    c = matching.report_counts(rows).first()
    assert (c.source, c.resolved, c.residue, c.flagged, c.dupes, c.exact, c.weak) == (4, 2, 1, 1, 1, 1, 1)


def test_no_table_that_grows_is_broadcast(spark):
    """Files of repeated names are a small part of the size of their rows, so the size of files must not decide on a broadcast."""
    rows = [(k, f"p{k % 5}", "A", f"T{k % 3}", "One", 100.0 + k % 7) for k in range(200)]
    one, other = (spark.createDataFrame(rows, SCHEMA) for _ in "pq")
    told = matching.report(one, matching.resolve(one, other))
    assert told.count() == 200
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
