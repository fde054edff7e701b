import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from daybrook.llm import prefix_trie
from tests.llm.rows import sentence

DDL = "conv_id LONG, turn LONG, role STRING, text STRING, path STRING, part STRING, n LONG, depth STRING, low_id STRING"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "y", 1, "z", "w") for row in rows], DDL)


def brute(rows):
    """Every prefix of every rebuilt conversation, one after the other."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [turn[3:] for turn in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def got(spark, rows):
    return sorted(map(tuple, prefix_trie.prefix_trie(frame(spark, rows)).collect()))


def talks(pick, families, long=0):
    rows = []
    for c in range(families * 100):
        if pick.random() < 0.4:
            first = pick.choice(["hello", "hi", "one opening"])
            for turn in range(pick.choice([1, 2, 3, 5, 8])):
                rows.append((c, turn, pick.choice(["user", "bot"]), first if turn == 0 else pick.choice(["yes", "no", sentence(pick, 3)])))
    rows += [(50_000 + k, turn, "user", f"turn {turn}") for k in range(3) for turn in range(long)]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_equals_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = talks(random.Random(parts), 3, 60)
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_group_holds_most_conversations(spark, monkeypatch):
    """Equal conversations over several ranges: their ids pass in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 200)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, turn, "user", f"same {turn}") for c in range(900) for turn in range(6)] + talks(random.Random(5), 1)
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_awkward_rows(spark):
    long = sentence(random.Random(1), 20_000)
    rows = [(None, 0, "a", "b"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 3, "é", "😀 né"), (100, 0, None, long), (150, 0, "user", long),
            (-7, 0, "u", "minus"), (-7, None, "u", "first"), (199, 0, "user", "gone, the family has no first one" * 3), (300, 1, "r", "x"), (300, 1, "r", "y")]
    rows += [(c, 0, "u", "only turn") for c in range(601, 640)]
    assert got(spark, rows) == brute(rows)
    assert any(row[1] == 0 and row[7] != hashlib.sha256(b"").hexdigest() for row in got(spark, rows))


def test_empty_table(spark):
    assert got(spark, []) == []
