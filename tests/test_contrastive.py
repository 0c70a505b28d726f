"""A contrastive head: its gradient, what it learns on held-out lists, and its nulls."""

import numpy as np
import pytest

from quaverlake.operators import contrastive


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    head = contrastive.Head.fresh(5, 4, 3, 1)
    a, p, lists = rng.normal(size=(6, 5)), rng.normal(size=(6, 5)), np.array(list("xxyzzw"), dtype=object)
    flat, (_, g) = head.flat(), contrastive.loss_and_gradient(head, a, p, lists, 0.3)
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        up, down = (contrastive.loss_and_gradient(head.like(flat + d), a, p, lists, 0.3)[0] for d in (step, -step))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-4, k


@pytest.fixture(scope="module")
def planted(spark):
    """Lists share 4 of 20 components; the 16 others are stronger noise."""
    rng = np.random.default_rng(3)
    rows, members = [], []
    for g in range(40):
        centre = rng.normal(0, 1, 4)
        for _ in range(8):
            members.append((f"l{g}", len(rows)))
            rows.append((len(rows), [float(x) for x in np.concatenate([centre + rng.normal(0, 0.25, 4), rng.normal(0, 1, 16)])]))
    pool = spark.createDataFrame([*rows, (999, None)], "id long, vector array<double>")
    return pool, spark.createDataFrame([*members, members[0], (None, 5), ("l0", None), ("l0", 999), ("l0", 5000), ("alone", 0)], "list string, id long")


def test_pairs_stay_in_their_lists_and_folds(spark, planted):
    pairs = contrastive.training_pairs(planted[1].where("id < 320"), 2, 8192, 0).collect()
    of = {}
    for r in planted[1].collect():
        of.setdefault(r.list, set()).add(r.id)
    own = [r for r in pairs if r.model == "trained"]
    assert own and all({r.anchor, r.positive} <= of[r.list] for r in own)
    lists = [{r.list for r in own if r.fold == f} for f in (0, 1)]
    assert not lists[0] & lists[1] and len(lists[0] | lists[1]) == 40
    mixed = [r for r in pairs if r.model == "shuffled"]
    assert sum({r.anchor, r.positive} <= of[r.list] for r in mixed) < len(mixed) / 4
    assert 40 < len(contrastive.training_pairs(planted[1].where("id < 320"), 2, 100, 0).where("model = 'trained'").collect()) <= 140


def test_held_out_lists_are_found_above_the_nulls(planted):
    rows = contrastive.head_report(*planted, k=7).collect()
    got = {v: np.mean([r.recall for r in rows if r.version == v]) for v in ("plain", "trained", "shuffled", "prior")}
    print(got)
    assert got["trained"] > 1.3 * got["plain"] and got["trained"] > 2 * got["shuffled"] and got["prior"] == 0
    assert all(sum(r.seeds for r in rows if r.version == v) == 320 for v in got)


def test_no_rows(planted):
    pool, members = planted
    assert contrastive.head_report(pool.limit(0), members).count() == 0
    rows = contrastive.head_report(pool.where("id < 9"), members.where("list = 'none'"), k=3).collect()
    assert {(r.version, r.recall, r.seeds) for r in rows} == {("plain", None, 0), ("prior", None, 0)}
