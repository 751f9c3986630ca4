"""MinHash near-duplicates against a loop over all pairs."""

import random

import numpy as np
import pytest

from lagwise.llm import minhash
from tests.llm.conftest import rows_of
from tests.llm.test_duplicates import BLANKS


def set_by_loop(text, width=2):
    words = [w for w in BLANKS.split("".join(c.lower() if c.isascii() else c for c in text or "").encode()) if w]
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def groups_by_loop(rows, width=2, percent=80):
    sets = [set_by_loop(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(df, **options):
    return rows_of(minhash.similar_groups(df, **options).select("doc_id", "n_shingles", "component_id"))


def test_documents_and_odd_rows(odd, documents):
    for df in (odd, documents, odd.limit(0)):
        assert got(df) == groups_by_loop([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("width,options", [(2, {}), (2, {"pairs_a_class": 0, "block": 16}), (5, {"pairs_a_class": 10**9, "block": 16}), (5, {})])
def test_families(spark, width, options):
    """Chains, families around one text and families that share half of it, by centres and by blocks."""
    rng = random.Random(width)
    rows = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        chain = list(base)
        for _ in range(rng.choice([1, 12, 60])):
            kind = rng.random()
            if kind < 0.4:
                words = [f"x{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in base]
            elif kind < 0.6:
                words = base[:len(base) // 2] + [f"x{rng.randrange(10**6)}" for _ in range(len(base) // 2)]
            else:
                chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**6)}"
                words = list(chain)
            rows.append((rng.choice([len(rows), len(rows), None]), " ".join(words)))
    rows += rng.sample(rows, 20) + [(10**6, "one"), (10**6 + 1, " ONE\n"), (10**6 + 2, "Éa b"), (10**6 + 3, "éa b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, width=width, **options) == groups_by_loop(rows, width)


def test_sketches_tell_similarities():
    """Differing bits grow with the share of samples apart, and pairs at the wanted similarity stay below the bound."""
    rng = np.random.default_rng(1)
    bound = minhash.most_bits(0.8)
    bits = {}
    for shared in (0, 50, 80, 95):
        bits[shared] = []
        for _ in range(200):
            both = rng.integers(0, 2**63, 4 * shared, dtype=np.uint64)
            # of 400 hashes altogether 4 * shared are in both sets
            a, b = (np.concatenate((both, rng.integers(0, 2**63, 2 * (100 - shared), dtype=np.uint64))) for _ in range(2))
            x, y = (minhash.sampled_sketch(minhash.samples(v)) for v in (a, b))
            assert np.bitwise_count(minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).sum() <= 4 * (100 - shared)
            bits[shared].append(int(np.bitwise_count(x ^ y).sum()))
    means = {k: np.mean(v) for k, v in bits.items()}
    assert means[95] < means[80] < means[50] < means[0]
    assert max(bits[80]) <= bound < means[50] and abs(means[80] - 256 * (1 - np.exp(-2 * 2 * 96 * 0.2 / 512))) < 3
    missed = sum(not (minhash.bucket_keys(s) == minhash.bucket_keys(t)).any() for s, t in _pairs_at(rng, 0.8, 500))
    assert missed == 0


def _pairs_at(rng, similarity, count):
    for _ in range(count):
        n = int(400 * similarity)
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        yield tuple(minhash.samples(np.concatenate((both, rng.integers(0, 2**63, (400 - n) // 2, dtype=np.uint64)))) for _ in range(2))
