"""Near-duplicates by MinHash bands and odd sketches, confirmed on whole shingle sets.

Texts with the same shingle set are one class first.  Of every class ``BANDS`` times ``ROWS`` least hashes are taken: the
bands are its buckets (a pair at the similarity 0.8 shares none with a chance of 3 in a million), and all samples are
folded into an odd sketch, a bitmap in which each sample turns one bit over.  Samples that two classes share cancel
out, so the bits in which their sketches differ tell how many they don't share; pairs of one bucket whose sketches differ
in more bits than a pair at the wanted similarity ever would (a chance of one in a million) are not looked at further.
A second sketch folds the whole set: it can't differ in more bits than the sets in shingles, so for sets of up to some
thousand shingles it rules pairs out for certain.  The others are confirmed on their sets.

A bucket is not paired out.  Every class is first compared with the nearest of the centres that its buckets name, four a
bucket, which joins groups of any size.  Then the sketches of the classes still apart are compared block by block, and only
pairs that may be similar leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import discard, likely_in, map_arrow, read, release, store, utf8
from lagwise.llm.components import components
from lagwise.llm.registry import query
from lagwise.llm.simhash import words_of

SEED = 12
BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
_LANES = SKETCH_BITS // 64
#: Chance that the sketches of a pair at the wanted similarity differ in more bits than are accepted.
MISSED = 1e-6
#: Centres a bucket names, of which a class is compared with the nearest; rounds, and pairs a class down to which there is none.
CENTRES, NEAREST, ROUNDS, PAIRS_A_CLASS = 4, 4, 1, 4
#: Classes of a bucket in one block, pairs compared at once in a task, rows held by a task (more only if one group has more).
BLOCK, PAIRS, GROUP_ROWS = 512, 200_000, 50_000
#: Shingles hashed at once.
_SLICE = 4_096

_RANDOM = np.random.default_rng(SEED)
_FLIPS, _FACTORS, _MORE = (_RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1) for _ in range(3))
_PLACE = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int) -> frozenset[bytes]:
    """The distinct ``width``-word shingles; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text)
    return frozenset(b" ".join(words[i:i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1))))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``SAMPLES`` hash functions."""
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, dtype=np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), _SLICE):
        mixed = (folded[at:at + _SLICE, None] ^ _FLIPS) * _FACTORS
        mixed ^= mixed >> np.uint32(15)
        mixed *= _MORE
        mixed ^= mixed >> np.uint32(13)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def _spread(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Bitmap in which every value turns over one bit; ``_LANES`` words of 64 bits."""
    bits = (_spread(values) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SKETCH_BITS) & 1, bitorder="little").astype(np.uint8).view(np.uint64)


def sampled_sketch(least: np.ndarray) -> np.ndarray:
    """Odd sketch of the samples, each with its number."""
    return odd_sketch(least.astype(np.uint64) + _PLACE)


def bucket_keys(least: np.ndarray) -> np.ndarray:
    """One key a band; keys of different bands are different."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _spread((key << np.uint64(1)) + column.astype(np.uint64) + key * np.uint64(0x9E3779B97F4A7C15))
    return key


@lru_cache(maxsize=8)
def most_bits(similarity: float) -> int:
    """Bits such that sketches of a pair at ``similarity`` differ in more of them with a chance of ``MISSED`` at most.

    A sample that the pair doesn't share turns two bits over, one in each sketch; how many it doesn't share is binomial.
    """
    weight = np.zeros(SKETCH_BITS + 1)
    weight[0] = 1.0
    up = 1 - np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    total = np.zeros_like(weight)
    for apart in range(SAMPLES + 1):
        total += comb(SAMPLES, apart) * (1 - similarity) ** apart * similarity ** (SAMPLES - apart) * weight
        for _ in range(2):
            weight = np.concatenate(([0], (weight * up)[:-1])) + np.concatenate(((weight * (1 - up))[1:], [0]))
    beyond = np.concatenate((np.cumsum(total[::-1])[::-1][1:], [0]))
    return int(np.flatnonzero(beyond <= MISSED)[0])


_SAMPLED, _WHOLE = [f"s{i}" for i in range(_LANES)], [f"w{i}" for i in range(_LANES)]
_LANE_NAMES = _SAMPLED + _WHOLE
_PRINTS = "row long, doc_id long, content long, n long, c1 long, c2 long, " + ", ".join(f"{s} long" for s in _LANE_NAMES) + ", keys array<long>"
_PRINTS_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("row", "doc_id", "content", "n", "c1", "c2", *_LANE_NAMES)], ("keys", pa.list_(pa.int64()))])


def _prints(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    none = np.zeros(SAMPLES, dtype=np.uint32)
    digest = xxhash.xxh64_intdigest
    for whole in stream:
        for at in range(0, whole.num_rows, 1_000):
            batch = whole.slice(at, 1_000)
            sizes, names, least, wholes = [], [], [], []
            for text in utf8(batch.column(3)):
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                names.append(hashlib.sha256(b"\n".join(sorted(shingles))).digest()[:16])
                hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
                least.append(samples(hashes) if shingles else none)
                wholes.append(odd_sketch(hashes))
            name = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
            sketch = np.concatenate((np.array([sampled_sketch(v) for v in least]), np.array(wholes)), axis=1).view(np.int64)
            keys = np.concatenate([bucket_keys(v) for v in least]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys))
            yield pa.record_batch([
                batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, type=pa.int64()), *map(pa.array, np.ascontiguousarray(name.T)),
                *map(pa.array, np.ascontiguousarray(sketch.T)), lists], schema=_PRINTS_ARROW)


# --- pairs of one bucket ------------------------------------------------------------------------

def _apart(a: dict[str, Column], b: dict[str, Column], least: float) -> Column:
    """Bits in which the sketches differ; null if sizes or sketches rule out that the sets are similar."""
    sampled, whole = (reduce(lambda x, y: x + y, [F.bit_count(a[s].bitwiseXOR(b[s])) for s in names]) for names in (_SAMPLED, _WHOLE))
    fits = (F.least(a["n"], b["n"]) >= least * F.greatest(a["n"], b["n"]) - 1e-9) & (sampled <= most_bits(least))
    return F.when(fits & (whole <= (a["n"] + b["n"]) * most_apart(least)), sampled + whole)


def most_apart(similarity: float) -> float:
    """Shingles, as a share of the sizes' sum, in which two sets of that similarity differ."""
    return (1 - similarity) / (1 + similarity) + 1e-9


_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _group_pairs(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the blocks (bucket, part_i, part_j) that are in different components and may be similar."""
    columns = [c.to_numpy() for c in table.columns]
    order = np.lexsort(columns[3::-1])
    columns = [c[order] for c in columns]
    group, side, node, component, n = columns[:3], columns[3], *columns[4:7]
    sketch = np.stack(columns[7:], axis=1).view(np.uint64)
    changed = np.zeros(len(node), dtype=bool)
    changed[0] = True
    for c in group:
        changed[1:] |= np.diff(c) != 0
    lo = np.flatnonzero(changed)
    of = np.cumsum(changed) - 1
    hi = np.append(lo[1:], len(node))[of]
    ones = np.concatenate(([0], np.cumsum(side)))
    mid = hi - (ones[hi] - ones[lo[of]])
    # within a block every row meets the rows after it, of two blocks every row of the first meets the second
    own = group[1] == group[2]
    place = np.arange(len(node))
    first = np.where(own, place + 1, mid)
    meets = np.where(own | (side == 0), hi - first, 0)
    ends = np.cumsum(meets)
    at = 0
    while at < len(node):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        x = np.repeat(place[at:to], meets[at:to])
        y = np.arange(len(x)) - np.repeat(ends[at:to] - meets[at:to] - (ends[at - 1] if at else 0), meets[at:to]) + first[x]
        new = (component[x] != component[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9)
        x, y = x[new], y[new]
        bits = np.bitwise_count(sketch[x] ^ sketch[y]).reshape(-1, 2, _LANES).sum(axis=2, dtype=np.int64)
        new = (bits[:, 0] <= most_bits(least)) & (bits[:, 1] <= (n[x] + n[y]) * most_apart(least))
        x, y = node[x[new]], node[y[new]]
        if len(x):
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=_PAIRS_ARROW)
        at = to


def _block_pairs(stream: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows of a task at group borders and pair each piece."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in stream:
        if rows + batch.num_rows > GROUP_ROWS:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            borders = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            if held and (keys[:, 0] != [held[-1].column(i)[-1].as_py() for i in range(3)]).any():
                borders = np.append(borders, 0)
            if len(borders):
                cut = int(borders.max())
                yield from _group_pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]), least)
                held, rows, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if rows:
        yield from _group_pairs(pa.Table.from_batches(held), least)


def _dealt(contested: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows (bucket, part_i, part_j, side, class, component, n, sketch); a crowded bucket is cut, and every pair of parts is a group."""
    rows = contested.join(sizes.select("bucket", F.ceil(F.col("size") / block).cast("int").alias("parts")), "bucket")
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    spread = rows.withColumn("part", part)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(
        F.least("part", q).alias("part_i"), F.greatest("part", q).alias("part_j"), (F.col("part") > q).cast("int").alias("side")))
    groups = spread.select("bucket", F.explode(pairs).alias("g"), "class", "component", "n", *_LANE_NAMES).select(
        "bucket", "g.*", "class", "component", "n", *_LANE_NAMES)
    return groups.repartition("bucket", "part_i", "part_j").sortWithinPartitions("bucket", "part_i", "part_j")


# --- exact confirmation -------------------------------------------------------------------------

_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def similar(x: frozenset, y: frozenset, percent: int) -> bool:
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(stream: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    of = lru_cache(maxsize=16)(lambda text: shingle_set(text, width))
    for batch in stream:
        near = [similar(of(x), of(y), percent) for x, y in zip(utf8(batch.column(2)), utf8(batch.column(3)))]
        yield pa.record_batch([batch.column(0), batch.column(1)], schema=_LINKS_ARROW).filter(pa.array(near, type=pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, component_a, component_b) whose sets are similar, as links between components."""
    sides = [texts.select(F.col("class").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return map_arrow(both, ["component_a", "component_b", "text_a", "text_b"], lambda it: _confirm(it, width, percent), "a long, b long")


# --- classes ------------------------------------------------------------------------------------

def _joined_classes(classes: DataFrame, docs: DataFrame, width: int, percent: int, pairs_a_class: int, block: int) -> DataFrame | None:
    """(class, root) of the classes that are linked to others, None if there are none."""
    least = percent / 100
    keyed = classes.select("class", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("class").alias("size")).filter("size > 1").select("bucket")
    found = keyed.join(shared, "bucket").groupBy("class").agg(F.collect_list("bucket").alias("buckets"))
    members = store(classes.join(found, "class").select("class", "n", *_LANE_NAMES, "buckets", "rep"), "members")
    release(members.sparkSession)
    rep = members.select("class", "rep.*")
    # few texts are candidates: the others are left out before the join moves them
    named = likely_in(docs.select("doc_id", "content", "text"), ["doc_id", "content"], rep, members.count()).select(
        F.col("doc_id").alias("id"), F.col("content").alias("of"), "text")
    texts = store(
        named.join(rep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("content")))
        .groupBy("class").agg(F.first("text").alias("text")), "candidates")
    release(members.sparkSession)
    labels = None
    for turn in range(ROUNDS + 1):
        current = members.withColumn("component", F.col("class")) if labels is None else members.join(
            labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("root", "class")).drop("root")
        rows = current.select("class", "n", *_LANE_NAMES, "component", F.explode("buckets").alias("bucket"))
        centre = F.struct("class", "component", "n", *_LANE_NAMES)
        parts = rows.groupBy("bucket", "component").agg(F.count("class").alias("m"), *[
            F.min(F.struct(F.xxhash64("class", F.lit(turn * CENTRES + i)).alias("rank"), centre.alias("c"))).alias(f"c{i}") for i in range(CENTRES)])
        m = F.col("m").cast("double")
        sizes = store(parts.groupBy("bucket").agg(
            F.sum("m").alias("size"), (F.sum(m) * F.sum(m) - F.sum(m * m)).alias("across"), F.count("m").alias("parts"),
            *[F.min(f"c{i}").alias(f"c{i}") for i in range(CENTRES)]).filter("parts > 1"), "buckets")
        count, across = sizes.agg(F.sum("size"), F.sum("across")).first()
        if not count:
            discard(sizes)
            break
        last = turn == ROUNDS or across <= 2 * pairs_a_class * count
        if last:
            blocks = _dealt(rows.join(sizes.select("bucket"), "bucket"), sizes, block)
            pairs = blocks.mapInArrow(lambda it: _block_pairs(it, least), "a long, b long").distinct()
            ends = current.select("class", "component")
            pairs = pairs.join(ends.select(F.col("class").alias("a"), F.col("component").alias("component_a")), "a").join(
                ends.select(F.col("class").alias("b"), F.col("component").alias("component_b")), "b")
        else:
            own = {c: F.col(c) for c in ("n", *_LANE_NAMES)}
            near = F.filter(F.array(*[
                F.when(F.col(f"c{i}.c.component") != F.col("component"), F.struct(
                    _apart(own, {c: F.col(f"c{i}.c.{c}") for c in own}, least).alias("bits"), F.col(f"c{i}.c.class").alias("b"),
                    F.col(f"c{i}.c.component").alias("component_b"))) for i in range(CENTRES)]), lambda x: x["bits"].isNotNull())
            # at most CENTRES a bucket of the class
            found = rows.join(sizes.select("bucket", *[f"c{i}" for i in range(CENTRES)]), "bucket").select(
                F.col("class").alias("a"), F.col("component").alias("component_a"), near.alias("near")).filter(F.size("near") > 0)
            nearest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, NEAREST)
            pairs = found.groupBy("a", "component_a").agg(nearest.alias("near")).select("a", "component_a", F.inline("near")).drop("bits")
        pairs = store(pairs, "pairs")
        links = _links(pairs, texts, width, percent)
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        following = components(links)
        discard(pairs, sizes, *([labels] if labels is not None else []))
        release(members.sparkSession)
        labels = following
        if last:
            break
    discard(members, texts)
    return labels


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, width: int = 2, percent: int = 80,
    pairs_a_class: int = PAIRS_A_CLASS, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id reachable by links, plus ``row``
    (``row_col``, or null) and ``component``, which names the component even where its ids are null.

    Rows link when ``100 * shared >= percent * all`` of their distinct ``width``-word shingles.  A text of fewer words is
    one shingle; null, empty and blank texts have none, link with nothing and have a null ``component``.  Null ids are larger
    than all others, rows with one id count on their own, an empty table gives an empty result.
    """
    named = docs.select(
        F.col(row_col).cast("long").alias("row") if row_col else F.lit(None).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("content"), F.col(text_col).cast("string").alias("text"))
    prints = store(map_arrow(named, ["row", "doc_id", "content", "text"], lambda it: _prints(it, width), _PRINTS), "minhash")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    merged = prints.filter("n > 0").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("least"), F.min(rep).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        *[F.first(s).alias(s) for s in _LANE_NAMES])
    classes = store(merged.withColumn("class", F.monotonically_increasing_id()), "classes")
    labels = _joined_classes(classes, named, width, percent, pairs_a_class, block)
    names = classes.select("c1", "c2", "class", "least")
    if labels is None:
        rooted = names.select("c1", "c2", F.col("least").alias("component_id"), F.col("class").alias("component"))
    else:
        linked = names.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
            "c1", "c2", "least", F.coalesce("root", "class").alias("component"))
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        rooted = linked.join(least, "component").select("c1", "c2", "component_id", "component")
    rooted = store(rooted, "rooted")
    discard(classes, *([labels] if labels is not None else []))
    one = F.col("component").isNull()
    return prints.select("row", "doc_id", "n", "c1", "c2").join(rooted, ["c1", "c2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(one, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "row")


def joined_groups(*groups: DataFrame) -> DataFrame:
    """(row, component) for every row of ``groups`` (row, component; null for a row by itself), where rows that are together in
    any of them are in one component, named by its first row.  All of ``groups`` have the same rows."""
    stars = []
    for group in groups:
        first = group.filter("component IS NOT NULL").groupBy("component").agg(F.min("row").alias("b"), F.count("row").alias("n")).filter("n > 1")
        stars.append(group.join(first, "component").filter("row <> b").select(F.col("row").alias("a"), "b"))
    links = components(reduce(DataFrame.union, stars))
    return groups[0].select("row").join(links.withColumnRenamed("node", "row"), "row", "left").select(
        "row", F.coalesce("root", "row").alias("component"))


@query("op12_minhash_near_dedup", """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id
""")
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is kept if it has the smallest id of its component."""
    groups = similar_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
