import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from headway.llm.prefix_trie import contracted, conversation_trie, list_ranks

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def truncated(c, n):
    return abs(c) % n * (1 if c >= 0 else -1)


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - truncated(c, 5), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        gain = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), leaves, gain, sha))
    return sorted(out, key=str)


def found(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), (1 << 63) - 1, -(1 << 63)]:
        if c % 7 == 3:
            continue
        for k in range(rng.randint(1, 12) if c != 20 else 300):
            text = rng.choice(["a", "bé", "", None]) if rng.random() < 0.6 else f"t{rng.randint(0, 3)}"
            rows.append((c, rng.choice([k, k, k, None]) if c % 2 else k, rng.choice(["user", "user", None]), text))
        if c % 9 == 0:
            rows.append(rows[-1])
    rows += [(None, 1, "user", "lost"), (40, 0, "user", "a"), (40, 0, "user", "a")]
    # ties of turn and role are ordered by a hash, so equal turns get equal texts here
    seen = {}
    rows = [(c, turn, role, seen.setdefault((c, turn, role or ""), text) if c is not None else text) for c, turn, role, text in rows]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    expected = brute(rows)
    assert found(conversation_trie(frame)) == expected
    assert found(conversation_trie(frame, block=16)) == expected


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(conversation_trie(empty)) == []
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 1, "user", "gone")]
    assert found(conversation_trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_many_copies_of_one_conversation(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(3000) for k in range(3)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = found(conversation_trie(frame, block=64))
    assert len(out) == 4 and [r[3] for r in sorted(out, key=lambda r: r[1])] == [3000] * 4


def test_lists_of_random_order_are_ranked(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 2000)
    rows = [(a, b, 0, 0) for a, b in zip(ids, [*ids[1:], -1], strict=True)]
    arcs = spark.createDataFrame(rows, "arc long, to long, leaf long, gain long")
    chains = contracted(arcs, block=512)
    ranks = list_ranks(chains.where("length is not null").selectExpr("head item", "leads to", "length weight"), few=100)
    placed = chains.join(ranks, chains["head"] == ranks["item"]).selectExpr("arc", "rank + offset as rank").collect()
    assert {r.arc: r["rank"] for r in placed} == {a: k for k, a in enumerate(ids)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(conversation_trie(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("partitions", [5, 23])
def test_what_blocks_hand_on(spark, partitions):
    """The same over many blocks, so that conversations, families and counts run on from one to the next."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(partitions)
        rows = [(c, k, "user", rng.choice(["a", "b"]) if k > 1 else "a") for c in range(40) for k in range(rng.randint(1, 6))] + [(41, k, "user", "long" if k % 3 else "a") for k in range(400)] + [(k, 0, "user", "other") for k in range(42, 300)]
        assert found(conversation_trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), block=64)) == brute(rows)
        if partitions == 5:
            table = spark.read.parquet(f"{SF}/conversations.parquet")
            assert found(conversation_trie(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
