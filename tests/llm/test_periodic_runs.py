"""Periodic runs against a plain search of every period."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from quaverlake.llm import periodic_runs, registry


def plain_runs(w, least=12):
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, 2 * p):
                found.setdefault((start, length), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def odd_words(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 150))
    w = rng.integers(0, rng.integers(1, 6), n)
    if seed % 2 and n > 10:
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 14))
        w = np.array([w[k] if k < a else w[min(n - 1, a + (k - a) % p)] for k in range(n)])
    return w


@pytest.mark.parametrize("short", [periodic_runs.SHORT, 0])
def test_runs_of_small_alphabets(monkeypatch, short):
    """Both with the table of points and by ranges of periods."""
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    for seed in range(700):
        w = odd_words(seed)
        assert periodic_runs.periodic_runs(w) == plain_runs(w.tolist()), w.tolist()


def test_many_points_survive(monkeypatch):
    """More points than are extended without further tests, in pieces."""
    monkeypatch.setattr(periodic_runs, "PIECE", 50)
    rng = np.random.default_rng(3)
    for w in (rng.integers(0, 2, 900), np.tile([0, 1, 0, 0, 1], 160), np.concatenate([np.tile([0, 1, 2], 90), np.tile([0, 1, 2, 0, 1], 70)])):
        assert periodic_runs.periodic_runs(w) == plain_runs(w.tolist())


def wanted(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    start, length, period = best[0] if best else (None, None, None)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), start, length, period, 1000 * length // period if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


ORDER = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("which", ["odd", "table", "empty"])
def test_query(spark, tmp_path, which):
    if which == "table":
        folder = SF
    else:
        folder = f"{tmp_path}/sf"
        texts = [None, "", " \t", "a", "a " * 40, "a b c d " * 9, "x\x0by\x0cz\r" * 10, "ä ö " * 30 + "ü " * 30, "  b" * 12, "a b c d e f " * 2, "a b c d e f " * 2 + "a", "nb sp " * 12]
        rows = [(k, t) for k, t in enumerate(texts * 8)] + [(3, "a"), (3, "a"), (None, "q r " * 20)]
        spark.createDataFrame(rows if which == "odd" else [], "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, registry.queries()["op13_periodic_runs"](spark, folder).select(*ORDER).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got == sorted((wanted(*r) for r in rows), key=repr)


def test_long_text_and_clashing_columns(spark):
    text = "w" + " w" * 700_000 + " " + " ".join(f"u{k}" for k in range(20_000))
    df = spark.createDataFrame([(1, text, "kept", "replaced")], "doc_id long, text string, other string, start string")
    row = periodic_runs.find_runs(df).drop("text").first()
    assert (row.other, row.n_runs, row.start, row.length, row.period) == ("kept", 1, 0, 700_001, 1)
    from pyspark.sql import functions as F

    short = df.select(periodic_runs.without_repeats(F.col("text")).alias("t")).first().t
    assert short == "w " + " ".join(f"u{k}" for k in range(20_000))
