"""Periodic runs against a loop over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lagwise.llm import periodic
from tests.llm.conftest import rows_of


def runs_by_loop(words):
    """Maximal stretches of every period, without those that have a smaller one."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        x = 0
        while x < len(words) - q:
            y = x
            while y < len(words) - q and words[y] == words[y + q]:
                y += 1
            stretch = words[x:y + q]
            if y > x and len(stretch) >= 4 * q and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((x, len(stretch), q))
            x = max(y, x + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    signs = rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(signs) for _ in range(rng.randint(0, 100))]
    for _ in range(rng.randint(0, 4)):
        base = [rng.randrange(signs) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(words))
        words[at:at] = (base * 7)[:rng.randint(len(base), 6 * len(base))]
    return words[:rng.randint(1, 12)] * rng.randint(2, 6) + words if rng.random() < 0.3 else words


@pytest.mark.parametrize("seed", range(4))
def test_find_runs(seed):
    rng = random.Random(seed)
    for _ in range(400):
        words = periodic_words(rng)
        assert periodic.find_runs(np.array(words, dtype=np.int64)) == runs_by_loop(words)


def test_sets_are_sparse_and_synchronised():
    """Positions of a set depend on 2t words, lie at most t apart, and are some 2n/t in random words."""
    rng = np.random.default_rng(3)
    row = rng.integers(0, 1000, 400)
    row = np.concatenate((row, row, row))
    windows = periodic._mix(row.astype(np.uint64), np.uint64(1))
    scale = 1
    while scale < 64:
        windows = periodic._mix(windows[:-scale], windows[scale:])
        scale *= 2
        chosen = periodic._selected(windows, scale, np.zeros(len(windows), dtype=bool))
        inside = chosen[chosen < 400]
        assert np.isin(inside + 400, chosen).all() and np.diff(chosen).max() <= scale
        assert len(chosen) <= 4 * len(row) / scale


def document_by_loop(doc_id, text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [r for r in runs_by_loop(words) if r[1] >= 6]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_by_loop(spark, odd):
    rng = random.Random(9)
    rows = [(rng.choice([i, i, None, 5]), " ".join("abcde"[w] for w in periodic_words(rng))) for i in range(400)]
    rows += [(10**9 + i, "one two  three\tfour " * (i % 7) + "five six") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = periodic.periodic_runs(df, rewrite=True).drop("runs", "collapsed")
    assert rows_of(got) == sorted((document_by_loop(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10
    got = [r for r in rows_of(periodic.periodic_runs(odd, rewrite=True, whole=False).drop("runs", "collapsed")) if r[0] not in (7, 8)]
    assert got == sorted((document_by_loop(*r) for r in odd.select("doc_id", "text").collect() if r[0] not in (7, 8)), key=repr)
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


def test_long_run_and_its_text(odd):
    rows = {r.doc_id: r for r in periodic.periodic_runs(odd).collect() if r.doc_id in (7, 8, 9)}
    assert rows[7].runs == [(0, 3000, 1)] and rows[7].collapsed == "word" and rows[7].exponent_milli == 3_000_000
    assert rows[9].runs == [(0, 120, 3)] and rows[9].collapsed == "A, b. c!"
