"""Exact and near duplicates, repeated strings."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lagwise.llm import exact, simhash, suffixes
from lagwise.llm.components import components
from tests.llm.conftest import rows_of

BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def exact_by_loop(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANKS.sub(b" ", (t or "").encode()), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(text).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("map_bytes,table_bytes", [(1 << 20, 1 << 20), (1, 1), (40, 2_000)])
def test_exact_groups(odd, documents, map_bytes, table_bytes):
    """Small tables force flushes on the map side and several levels of spill files."""
    for df in (odd, documents, odd.limit(0)):
        got = exact.exact_groups(df, map_bytes=map_bytes, table_bytes=table_bytes).drop("row")
        assert rows_of(got) == exact_by_loop([(r.doc_id, r.text) for r in df.collect()])


def test_open_table_compares_contents():
    table = exact.OpenTable()
    digest = b"\0" * 32  # one digest for all: only contents tell entries apart
    for i in range(3000):
        entry, slot = table.find(digest, b"%d" % i)
        assert entry < 0
        table.insert(digest, b"%d" % i, slot)
    assert all(table.find(digest, b"%d" % i)[0] == i for i in range(0, 3000, 500))


def print_by_loop(text):
    words = [w for w in BLANKS.split(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_loop(prints, budget=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_near_groups(odd, documents):
    for df in (odd, documents, odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        prints = [print_by_loop(t) for _, t in rows]
        roots = roots_by_loop(prints)
        least = {}
        for r, (i, _) in zip(roots, rows):
            least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
        want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots)), key=repr)
        assert rows_of(simhash.near_groups(df).drop("component", "row")) == want


@pytest.mark.parametrize("crowded", [10**6, 30])
def test_trie_join_with_crowded_nodes(spark, crowded):
    rng = np.random.default_rng(1)
    one = np.uint64(1)
    values = {int(b ^ (one << np.uint64(rng.integers(64))) ^ (one << np.uint64(rng.integers(64)))) for b in rng.integers(0, 2**63, 8, dtype=np.uint64) for _ in range(40)}
    prints = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    place = {v: i for i, v in enumerate(signed)}
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "bits long").repartition(4), 3, crowded).collect()
    assert all((prints[place[a]] ^ prints[place[b]]).bit_count() < 64 for a, b in links)
    frame = spark.createDataFrame([(place[a], place[b]) for a, b in links], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == roots_by_loop(prints)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert all(root == (0 if node < 500 else 1000) for node, root in got.items()) and len(got) == 399


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(500):
        text = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffixes.suffix_order([]) == []


def repeats_by_loop(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p:p + width] for _, b in texts for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if count[b[p:p + width]] > 1:
                gone[p:p + width] = b"\1" * width
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowded", [2_000, 3])
def test_remove_repeats(spark, odd, crowded):
    rng = random.Random(crowded)
    base = ["".join(rng.choice("ab é") for _ in range(60)) for _ in range(3)]
    rows = [(None, None), (1, ""), (2, "ab" * 60)]
    for i in range(40):
        cut = rng.choice(base)[rng.randint(0, 10):rng.randint(30, 60)]
        noise = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2)]
        rows.append((rng.choice([i, None, 3]), noise[0] + cut + noise[1]))
    df = spark.createDataFrame(rows + rows[:6], "doc_id long, text string").repartition(3)
    assert rows_of(suffixes.remove_repeats(df, width=20, crowded=crowded)) == repeats_by_loop(rows + rows[:6], 20)
    if crowded > 3:
        assert rows_of(suffixes.remove_repeats(odd)) == repeats_by_loop([(r.doc_id, r.text) for r in odd.collect()], 200)
        assert suffixes.remove_repeats(odd.limit(0)).count() == 0
