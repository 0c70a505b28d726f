"""Substring dedup against a search of every window."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF

from quaverlake.llm import registry, substring_dedup
from quaverlake.llm.substring_dedup import Parse, Texts

SCHEMA = "doc_id long, text string"
LAST = float("inf")


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept words) of each (doc_id, text)."""
    order = lambda d: LAST if d is None else d
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, LAST), order(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < order(d):
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def passages(seed, docs=60, alphabet=4, most=60):
    """Texts that share stretches of a few base texts, in small alphabets and with runs and short periods."""
    rng = random.Random(seed)
    base = [str(rng.randrange(alphabet)) for _ in range(300)] + ["r"] * 40 + ["p", "q"] * 30
    rows = []
    for d in range(docs):
        words = []
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(base))
            words += base[a : a + rng.randrange(most)] + [str(rng.randrange(alphabet)) for _ in range(rng.randrange(4))]
        rows.append((d, " ".join(words)))
    return rows + rows[3:6] + [(None, rows[4][1]), (None, rows[7][1]), (70, None), (71, ""), (72, " \t\n"), (5, "x y z")]


def test_equal_windows_have_equal_keys():
    """What stands for a window depends on its words alone, whatever lies around it."""
    rng = np.random.default_rng(0)
    for _ in range(150):
        how = Parse(int(rng.integers(8, 20)), int(rng.integers(2, 8)), int(rng.integers(0, 5)))
        texts = [t.encode() for _, t in passages(int(rng.integers(1 << 30)), 8, int(rng.integers(1, 6)), 40) if t]
        t = Texts(texts, how)
        keys = dict(zip(zip(t.places.tolist(), t.is_own.tolist(), strict=True), t.keys().tolist(), strict=True))
        known = {}
        for s in np.flatnonzero(t.is_window).tolist():
            a, k = int(t.anchor[s]), int(t.text_of[s])
            found = (0, keys[s, True]) if a < 0 else (a - s, keys[a, False])
            begin = s - int(t.begin[k])
            assert known.setdefault(tuple(t.words[k][begin : begin + how.window]), found) == found


@pytest.mark.parametrize(("seed", "how"), [(1, Parse(8, 3, 2)), (2, Parse(12, 4, 3)), (3, Parse(20, 6, 4)), (4, Parse(5, 1, 1)), (5, Parse(1, 1, 0))])
def test_small_windows(spark, seed, how):
    rows = passages(seed, alphabet=2 + seed)
    got = substring_dedup.removed_words(spark.createDataFrame(rows, SCHEMA).repartition(3), how=how)
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr)
    assert found == plain(rows, how.window)


@pytest.mark.parametrize("which", ["odd", "table", "empty"])
def test_query(spark, tmp_path, which):
    folder = SF
    if which != "table":
        folder = f"{tmp_path}/sf"
        rng = random.Random(9)
        text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
        shared, run = text(400), "r " * 130
        rows = [(3, text(60) + " " + shared), (1, shared[:900] + " " + text(30)), (2, run + shared), (4, run), (4, run), (None, shared), (9, "a\x0bb " * 60), (8, "a \tb\n" * 60), (7, text(49)), (6, None)]
        rows += [(20 + k, shared + " " + text(k)) for k in range(6)]
        if which == "empty":
            rows = []
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.queries()["op11_substring_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in plain(rows, 50)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    words = [f"{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words), "x", 0), (2, "new " + " ".join(words[50_000:150_000]) + " end", "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, __doc int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.removed_words(df).collect()}
    assert got[1][:2] == (200_000, 0)
    assert got[2] == (100_002, 100_000, "new end")
