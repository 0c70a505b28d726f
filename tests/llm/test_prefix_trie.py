"""The prefix trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest import SF

from quaverlake.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string"
ORDER = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(sequences):
    """The nodes of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[x] for x in children.get(node, []))
        leaves[node] = sum(leaves[x] for x in children.get(node, [])) or 1
    return sorted(
        (
            (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
            for node, m in members.items()
        ),
        key=repr,
    )


def plain_rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda t: t[:2])] for c, t in turns.items()}
    out = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = whole.get(c - c % 100, [])[:h] + own[h:]
    return out


def odd_rows(seed, convs=160, words=("a", "b", "", None, "é中"), longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), convs):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, None if turn == 0 and rng.random() < 0.3 else turn, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice(words)))
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def read(df):
    return sorted((tuple(r) for r in df.select(*ORDER).collect()), key=repr)


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_odd_conversations(spark, block_rows):
    """Blocks of a few rows, so that most nodes reach over borders of blocks."""
    rows = odd_rows(block_rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = read(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), block_rows))
    assert got == plain_trie(plain_rebuilt(rows))


def test_stairs_of_prefixes(spark):
    """Each conversation begins the next one, and many are alike: values only grow over all blocks."""
    rows = [(100 * c + 7, t, "user", f"t{t}") for c in range(40) for t in range(c % 30)] + [(5, t, "user", f"t{t % 3}") for t in range(400)] + [(6, t, "user", f"t{t % 3}") for t in range(390)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {}
    for c, _, r, x in rows:
        whole.setdefault(c, []).append((r, x))
    assert read(prefix_trie.prefix_trie(prefix_trie.sequences(df), 2)) == plain_trie(whole)


@pytest.mark.parametrize("which", ["table", "one", "turnless", "empty"])
def test_query(spark, tmp_path, which):
    folder = SF
    if which != "table":
        folder = f"{tmp_path}/sf"
        rows = {"one": [(3, 0, "user", "x" * 2_000_000)], "turnless": [(c, 0, "user", "q") for c in range(901, 940)], "empty": []}[which]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = read(registry.queries()["op12_prefix_trie"](spark, folder))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain_trie(plain_rebuilt(rows))


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, 0, "user", "a", "x", 5)] * 3 + [(2, 0, "user", "a", "y", 6)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, n_convs int")
    got = read(prefix_trie.prefix_trie(prefix_trie.sequences(df)))
    assert got == plain_trie({c: [("user", "a")] * 3 for c in (1, 2)})
