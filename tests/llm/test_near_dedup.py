"""The pipeline's near-dedup against brute-force Jaccard groups."""

from __future__ import annotations

import numpy as np
import pytest

from quaverlake.llm import simhash_dedup


def jaccard(a, b):
    a, b = (set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} for w in ((x or "").lower().split() for x in (a, b)))
    return len(a & b) / len(a | b)


def kept_by_brute_force(rows):
    """Indexes into ``rows`` (id, text) of the least of each group of near copies."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    root = {k: k for k in order}
    for x, i in enumerate(order):
        for j in order[:x]:
            if root[i] != root[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                low, high = sorted((root[i], root[j]), key=order.index)
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def edited(words, at):
    out = list(words)
    for k in at:
        out[k] = f"edit{k}"
    return out


def stars(seed=1, groups=6, copies=6):
    """Near copies of originals that are unlike each other; the original's id is not the least."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in rng.integers(0, 5000, 300)]
        rows += [" ".join(edited(base, range(7 + 40 * c, 47 + 40 * c, 8))) for c in range(copies)]
        rows.append(" ".join(base))
    return list(enumerate(rows))


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash_dedup.keep_one_per_group(df, **options).collect()]
    assert sorted(got, key=str) == sorted((rows[k] for k in kept_by_brute_force(rows)), key=str)


@pytest.mark.parametrize("max_bucket", [2, 64])
def test_star_shaped_groups(spark, max_bucket):
    rows = stars()
    assert jaccard(rows[0][1], rows[6][1]) >= 0.8 > jaccard(rows[0][1], rows[1][1])
    check(spark, rows, max_bucket=max_bucket)


def test_a_star_beyond_a_bucket(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = [" ".join(edited(base, rng.choice(300, 5, replace=False))) for _ in range(400)]
    check(spark, list(enumerate([*rows, " ".join(base)])))


def test_copies_far_from_their_hub_make_few_candidates(spark, monkeypatch):
    """Copies share most shingles with all others; those far from the original are told apart by what they changed."""
    rng, made = np.random.default_rng(8), []
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = [[f"c{c}{w}" if w.startswith("edit") else w for w in edited(base, rng.choice(300, 9, replace=False))] for c in range(200)]
    rows += [edited(words, rng.choice(300, 2, replace=False)) for words in rows[:30]]
    rows += [base[:220], base[:216], base[60:], base[64:], base + [f"n{k}" for k in range(90)], base + [f"n{k}" for k in range(95)]]
    verified = simhash_dedup.NearCopies.verified
    monkeypatch.setattr(simhash_dedup.NearCopies, "verified", lambda self, links: made.append(links.count()) or verified(self, links))
    check(spark, list(enumerate(" ".join(words) for words in [*rows, base])))
    assert made[-1] <= 5 * len(rows)


def test_equal_fingerprints_of_different_texts(spark):
    rows = [(k, "row " * 120 + " ".join(f"d{k}w{j}" for j in range(60))) for k in range(4)]
    assert len({simhash_dedup.fingerprint(t, 2) for _, t in rows}) == 1
    check(spark, rows)


def test_repeated_ids_nulls_and_empty_texts(spark):
    words = [f"w{k}" for k in range(100)]
    near, other = " ".join(edited(words, [99])), " ".join(f"x{k}" for k in range(100))
    rows = [(1, " ".join(words)), (2, near), (2, other), (3, None), (4, ""), (5, " "), (6, other), (6, other)]
    df = spark.createDataFrame([*rows, (None, near), (None, near)], "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in simhash_dedup.keep_one_per_group(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], (None, near), (None, near)], key=str)
    twice = spark.createDataFrame([rows[0], rows[0]], "doc_id long, text string")
    assert simhash_dedup.keep_one_per_group(twice).count() == 1
    assert simhash_dedup.keep_one_per_group(df.limit(0)).count() == 0


def test_near_copies_by_each_kind_of_edit(spark):
    """At 0.8 and a little more; by one fingerprint about half of the block edits are missed."""
    rng, rows = np.random.default_rng(4), []
    for g in range(60):
        base = [f"g{g}w{k}" for k in rng.integers(0, 5000, 300)]
        cut_at, at = int(rng.integers(0, 240)), rng.integers(0, 8)
        copies = [base[:cut_at] + base[cut_at + 54 :], edited(base, range(int(at), 290, 46)), base + [f"g{g}n{k}" for k in range(60)]]
        rows += [" ".join(base), " ".join(copies[g % 3])]
    check(spark, list(enumerate(rows)))


def test_words_longer_than_a_piece():
    """A word is one word however long, with the hash that it would have in one piece."""
    from quaverlake.llm.simhash_dedup import PIECE, word_hashes

    long = "ab" * PIECE
    assert len(word_hashes("x" * 300_000)) == 1
    for before in ("", "y ", "some words " * 30_000):
        got = word_hashes(before + long + " z " + long + "c")
        assert len(got) == len(before.split()) + 3
        assert got[-2] == word_hashes("z")[0]
        assert got[-3] == word_hashes(long)[0] != got[-1]
    exact = "q" * PIECE
    assert [len(word_hashes(t)) for t in (exact, exact + " ", " " + exact, exact + "q", exact + " q")] == [1, 1, 1, 1, 2]
    assert word_hashes(" " + exact)[0] == word_hashes(exact + " ")[0] == word_hashes(exact)[0]
    assert word_hashes(exact + "q")[0] != word_hashes(exact)[0]
    # a plain sum over the bytes of a word that spans two pieces
    from quaverlake.llm import simhash_dedup as m

    text, total, power, mask = "z" * (PIECE + 7), 0, 1, (1 << 64) - 1
    for b in text.encode():
        total = (total + int(m.BYTE_VALUES[b]) * power) & mask
        power = power * int(m.MULTIPLIERS[0]) & mask
    assert int(word_hashes(text)[0]) == (total ^ total >> 32) * int(m.MIX) & mask
