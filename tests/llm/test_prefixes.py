"""The prefix trie against a plain one, and its fingerprints."""

import hashlib
import random
import re
import zlib

import pytest

from lagwise.llm import prefixes
from tests.llm.conftest import rows_of

SCHEMA = "conv_id long, turn long, role string, text string, conv long, at long, digest string, k0 int"


def trie_by_loop(rows):
    """rows (conv_id, turn, role, text)"""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))

    def digest(role, text):
        return hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode()).digest()

    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda v: (*v[:3], digest(*v[2:])))] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len([w for w in re.split(r"[\x20\x09-\x0D]+", n[-1][1]) if w]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(rebuilt[c]) == len(node)))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, count):
    turns = [(rng.choice(["user", "assistant", None]), " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, 4)))) for _ in range(4)]
    rows = []
    for _ in range(count):
        c = rng.choice([rng.randrange(200), rng.randrange(40), -rng.randrange(60)])
        rows += [(c, rng.choice([i, i, i, None, 1]), *rng.choice(turns)) for i in range(rng.randint(1, 5))]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_loop(spark, seed):
    rng = random.Random(seed)
    rows = conversations(rng, 150)
    rows += [(300, i, "user", "same words again") for i in range(40)] + [(320, i, "user", "same words again") for i in range(40)]
    rows += [(None, 0, "user", "nobody"), (400, None, None, None), (400, None, None, None), (401, 0, "user", "x " * 5000)]
    got = prefixes.prefix_nodes(frame(spark, rows))
    assert rows_of(got) == trie_by_loop(rows)


def test_conversations_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert rows_of(prefixes.prefix_nodes(df)) == trie_by_loop([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert prefixes.prefix_nodes(df.limit(0)).count() == 0


def test_products_carry_over_tasks(spark):
    """One conversation over many tasks has the products of a plain loop."""
    rows = [(7, i, "user", f"turn {i}") for i in range(300)] + [(8, 0, "user", "x")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixes.turn_prefixes(prefixes._normal(frame(spark, rows, 8), "conv_id", "turn", "role", "text")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r for r in got if r.conv == 7), key=lambda r: r["at"])
    products, power, words = [0, 0, 0], [1, 1, 1], 0
    for i, r in enumerate(got):
        digest = hashlib.sha256((hashlib.sha256(b"user").hexdigest() + f"turn {i}").encode()).digest()
        turn = [int.from_bytes(digest[4 * k:4 * k + 4], "little") % prefixes.PRIME for k in range(3)]
        products = [(p * b + e) % prefixes.PRIME for p, b, e in zip(products, prefixes.BASES[0], turn)]
        power = [p * b % prefixes.PRIME for p, b in zip(power, prefixes.BASES[0])]
        assert (r["at"], r.before, [r.k0, r.k1, r.k2], [r.p0, r.p1, r.p2]) == (i + 1, words, products, power)
        words += 2


def test_equal_products_of_different_sequences_are_noticed(spark):
    """Bases 1 make the product blind to order: the verification takes the next ones, or fails."""
    rows = [(c, i, "user", text) for c, texts in ((20, "ab"), (40, "ba"), (60, "abc")) for i, text in enumerate(texts)]
    blind = ((1, 1, 1),)
    df = frame(spark, rows)
    assert rows_of(prefixes.prefix_nodes(df, bases=blind + prefixes.BASES[:1])) == trie_by_loop(rows)
    with pytest.raises(ValueError):
        prefixes.prefix_nodes(df, bases=blind)


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE_IDS", 3)
    rows = [(1000 + 20 * i, 0, "user", "one") for i in range(50)]
    assert rows_of(prefixes.prefix_nodes(frame(spark, rows))) == trie_by_loop(rows)
