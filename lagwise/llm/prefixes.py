"""Prefix trie of conversations, by fingerprints that compose.

A sequence of turns is an element of a monoid: a polynomial in ``LANES`` bases modulo a prime, with its power.  The product of
two elements is that of the sequences one after the other.  Turns are sorted by range partitions; each task multiplies
its own, and products of the tasks before it are carried in, so a conversation of any length is spread over tasks.  A
rebuilt conversation begins with the head of another one: its prefixes are products of that head and a piece of its own
prefixes, formed as numbers; no text is moved or joined for it.  Equal products name a node of the trie.  That they are
equal sequences is verified: all members of a node must name the same node above and turns with the same digest, and turns
with the same digest must have the same role and text, which are looked up where they are stored.

Sums over subtrees need no walk: a node is owned by its smallest member, and along a conversation it owns a node,
it owns all nodes below.  So the nodes below x that count once are, for every member of x, the end of its path from
the first node on that it owns, and all sums are sums over the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import discard, map_arrow, read, release, store
from lagwise.llm.registry import query

LANES = 3
PRIME = (1 << 31) - 1
#: Bases of the polynomials; a set is taken after the one before it has failed the verification.
BASES = ((1_103_515_245, 1_812_433_253, 69_621), (630_360_016, 742_938_285, 950_706_376), (1_226_874_159, 62_089_911, 1_343_714_438))
#: Ids of one piece of a list to be digested, and in how many parts a digest is looked up.
PIECE_IDS, PARTS = 4_096, 16
_WORD = r"[^\x20\x09-\x0D]+"
_LANES = [f"k{i}" for i in range(LANES)]


def _normal(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return named.filter(F.col("conv").isNotNull()).withColumn(
        "digest", F.unhex(F.sha2(F.concat(F.sha2(F.col("role").cast("binary"), 256).cast("binary"), F.col("text").cast("binary")), 256)))


# --- prefixes of every conversation -------------------------------------------------------------

_PREFIXES = "kind int, part int, conv long, at long, words long, before long, digest binary, d0 long, d1 long, " + ", ".join(
    f"{c}{i} int" for c in "kpe" for i in range(LANES))
_PREFIXES_ARROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("conv", pa.int64()), ("at", pa.int64()), ("words", pa.int64()), ("before", pa.int64()),
    ("digest", pa.binary()), ("d0", pa.int64()), ("d1", pa.int64()), *[(f"{c}{i}", pa.int32()) for c in "kpe" for i in range(LANES)]])


def elements(digests: np.ndarray) -> np.ndarray:
    """Turns as numbers, one row of ``LANES`` for every digest of 32 bytes."""
    return (digests.view("<u4").reshape(-1, 8)[:, :LANES] % np.uint32(PRIME)).astype(np.int64)


def _scan(stream: Iterator[pa.RecordBatch], bases: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Products of each conversation's turns in this task; at the end the products of its first and last conversation."""
    part = TaskContext.get().partitionId()
    base = np.array(bases, dtype=np.int64)
    conv, at, words_before = None, 0, 0
    product, power = np.zeros(LANES, dtype=np.int64), np.ones(LANES, dtype=np.int64)
    borders = []
    for batch in stream:
        convs, words = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw = batch.column(2).to_pylist()
        digests = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, 32)
        element = elements(np.ascontiguousarray(digests))
        checks = np.ascontiguousarray(digests[:, 16:]).view(np.int64)
        ats, before = np.empty(len(convs), dtype=np.int64), np.empty(len(convs), dtype=np.int64)
        products, powers = np.empty((len(convs), LANES), dtype=np.int64), np.empty((len(convs), LANES), dtype=np.int64)
        for i, (c, w) in enumerate(zip(convs.tolist(), words.tolist())):
            if c != conv:
                if conv is not None and not borders:
                    borders.append((conv, at, words_before, product, power))
                conv, at, words_before = c, 0, 0
                product, power = np.zeros(LANES, dtype=np.int64), np.ones(LANES, dtype=np.int64)
            at += 1
            product, power = (product * base + element[i]) % PRIME, power * base % PRIME
            ats[i], before[i], products[i], powers[i] = at, words_before, product, power
            words_before += w
        n = len(convs)
        if n:
            yield pa.record_batch([
                pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.full(n, part, dtype=np.int32)), batch.column(0), pa.array(ats), batch.column(1),
                pa.array(before), batch.column(2), *map(pa.array, np.ascontiguousarray(checks.T)),
                *[pa.array(v.astype(np.int32)) for m in (products, powers, element) for v in m.T]], schema=_PREFIXES_ARROW)
    if conv is not None:
        borders.append((conv, at, words_before, product, power))
    for i, (c, n, words, product, power) in enumerate(borders):
        alone = len(borders) == 1
        for kind in (1, 2) if alone else (1 + i,):
            yield pa.record_batch([pa.array([v], type=f.type) for v, f in zip(
                (kind, part, c, n, words, 0, None, 0, 0, *product.tolist(), *power.tolist(), *[0] * LANES), _PREFIXES_ARROW)], schema=_PREFIXES_ARROW)


def _composed(left: list[Column], right: list[Column], power: list[Column]) -> list[Column]:
    """Product of two sequences, each a polynomial; ``power`` is that of the right one."""
    return [((a.cast("long") * p.cast("long") + b.cast("long")) % PRIME) for a, b, p in zip(left, right, power)]


def _carried(borders: list) -> list[tuple]:
    """(part, conv, turns, words, product, power): what the tasks before ``part`` hold of its first conversation."""
    first, last = {r.part: r for r in borders if r.kind == 1}, {r.part: r for r in borders if r.kind == 2}
    out, conv, at, words, product, power = [], None, 0, 0, [0] * LANES, [1] * LANES
    for part in sorted(first):
        f, l = first[part], last[part]
        if f.conv == conv:
            out.append((part, conv, at, words, *product, *power))
        whole = f.conv == l.conv
        if not (whole and f.conv == conv):
            conv, at, words, product, power = l.conv, 0, 0, [0] * LANES, [1] * LANES
        own, own_power = [l[f"k{i}"] for i in range(LANES)], [l[f"p{i}"] for i in range(LANES)]
        product = [(a * p + b) % PRIME for a, b, p in zip(product, own, own_power)]
        power = [a * b % PRIME for a, b in zip(power, own_power)]
        at, words = at + l["at"], words + l.words
    return out


def turn_prefixes(turns: DataFrame, bases: tuple[int, ...] = BASES[0]) -> DataFrame:
    """One row per turn of ``_normal``: conv, at (1, 2, ...), words, before (words of the turns before it), the digest
    and its check numbers, product, power and element of the prefix that ends with the turn.  A stored table."""
    spark = turns.sparkSession
    narrow = turns.select("conv", F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))
    keys = ["conv", "known", "turn", "role", "digest"]
    ordered = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    scanned = store(map_arrow(ordered, ["conv", "words", "digest"], lambda it: _scan(it, bases), _PREFIXES), "scan")
    # two rows a task, which name what the next task has to go on with
    carried = _carried(scanned.filter("kind > 0").select("kind", "part", "conv", "at", "words", *_LANES, *[f"p{i}" for i in range(LANES)]).collect())
    rows = scanned.filter("kind = 0").drop("kind")
    if carried:
        names = ["part", "conv", "c_at", "c_words", *[f"ck{i}" for i in range(LANES)], *[f"cp{i}" for i in range(LANES)]]
        more = spark.createDataFrame(carried, "part int, conv long, " + ", ".join(f"{c} long" for c in names[2:]))
        rows = rows.join(F.broadcast(more), ["part", "conv"], "left")
        began = F.col("c_at").isNotNull()
        left = [F.coalesce(f"ck{i}", F.lit(0)) for i in range(LANES)]
        product = _composed(left, [F.col(c) for c in _LANES], [F.col(f"p{i}") for i in range(LANES)])
        power = [F.when(began, F.col(f"cp{i}") * F.col(f"p{i}") % PRIME).otherwise(F.col(f"p{i}")) for i in range(LANES)]
        rows = rows.select(
            "conv", (F.col("at") + F.coalesce("c_at", F.lit(0))).alias("at"), "words", (F.col("before") + F.coalesce("c_words", F.lit(0))).alias("before"),
            "digest", "d0", "d1", *[v.cast("int").alias(c) for v, c in zip(product, _LANES)],
            *[v.cast("int").alias(f"p{i}") for i, v in enumerate(power)], *[f"e{i}" for i in range(LANES)])
    return rows


# --- rebuilt conversations ----------------------------------------------------------------------

def _paths(prefixes: DataFrame, spread: int, most: int, bases: tuple[int, ...]) -> DataFrame:
    """One row per rebuilt conversation and depth: conv, depth, node (product), above (the product before the last turn), the
    turn's check numbers and where it is stored, words and words before, number of turns and words of the whole path."""
    inverse = [pow(b, -1, PRIME) for b in bases]
    zero = F.lit(0)
    lanes = F.struct("at", "before", "words", *_LANES, "d0", "d1", *[f"e{i}" for i in range(LANES)])
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("taken")
    base = (F.col("conv") - F.col("conv") % spread).alias("base")
    heads = prefixes.filter((F.col("at") < most) & (F.col("conv") % spread == 0)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(lanes)).alias("head"))
    last = F.max(F.struct("at", (F.col("before") + F.col("words")).alias("words"))).alias("last")
    cut = F.max(F.when(F.col("at") == F.col("taken"), F.struct("at", (F.col("before") + F.col("words")).alias("words"), *_LANES))).alias("cut")
    convs = prefixes.select("conv", "at", "before", "words", *_LANES, taken).groupBy("conv", "taken").agg(last, cut).select("*", base)
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("taken").cast("int")))
    top = F.when(F.size("head") > 0, F.element_at("head", -1))
    own = F.greatest(F.col("last.at") - F.col("taken"), zero)
    own_words = F.when(own > 0, F.col("last.words") - F.coalesce("cut.words", zero)).otherwise(0)
    head_words = F.coalesce(top["before"] + top["words"], zero)
    convs = convs.select(
        "conv", "base", "taken", "head", F.size("head").cast("long").alias("h"), (F.size("head") + own).alias("depths"),
        head_words.alias("head_words"), (head_words + own_words).alias("path_words"), F.coalesce("cut.words", zero).alias("cut_words"),
        *[F.coalesce(top[c], zero).cast("long").alias(f"h{i}") for i, c in enumerate(_LANES)],
        *[F.coalesce(f"cut.{c}", zero).cast("long").alias(f"c{i}") for i, c in enumerate(_LANES)])
    ends = ["depths", "path_words"]
    root = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in _LANES], *[F.lit(0).cast("long").alias(f"a{i}") for i in range(LANES)],
        F.lit(0).cast("long").alias("d0"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("before"), *ends)

    def above(node: list[Column], element: list[Column]) -> list[Column]:
        return [F.pmod(n - e.cast("long"), F.lit(PRIME)) * i % PRIME for n, e, i in zip(node, element, inverse)]

    def rows(df: DataFrame, depth: Column, node: list[Column], of, before: Column) -> DataFrame:
        up = above(node, [of(f"e{i}") for i in range(LANES)])
        return df.select(
            "conv", depth.cast("long").alias("depth"), *[v.cast("long").alias(c) for v, c in zip(node, _LANES)],
            *[v.alias(f"a{i}") for i, v in enumerate(up)], of("d0").alias("d0"), of("d1").alias("d1"),
            of("words").alias("words"), before.alias("before"), *ends)

    shared = convs.select("conv", F.explode("head").alias("t"), *ends)
    shared = rows(shared, F.col("t.at"), [F.col(f"t.{c}").cast("long") for c in _LANES], lambda c: F.col(f"t.{c}"), F.col("t.before"))
    # power of the piece after the cut: that of the prefix divided by that of the cut
    mine = prefixes.join(convs.drop("base", "head"), "conv").filter("at > taken")
    divided = [F.col(f"p{i}").cast("long") * F.element_at(F.array(*[F.lit(pow(v, k, PRIME)) for k in range(most)]), F.col("taken").cast("int") + 1) % PRIME for i, v in enumerate(inverse)]
    piece = [F.pmod(F.col(c).cast("long") - F.col(f"c{i}") * divided[i] % PRIME, F.lit(PRIME)) for i, c in enumerate(_LANES)]
    node = _composed([F.col(f"h{i}") for i in range(LANES)], piece, divided)
    mine = rows(mine, F.col("h") + F.col("at") - F.col("taken"), node, F.col, F.col("head_words") + F.col("before") - F.col("cut_words"))
    return root.unionByName(shared).unionByName(mine)


def _same_content(turns: DataFrame, digests: DataFrame) -> bool:
    """Whether turns with the same digest have the same role and text, for the digests that several turns have.

    A digest is looked up in ``PARTS`` parts, so that one of very many turns is not left to one task.
    """
    repeated = digests.groupBy("digest").agg(F.count("conv").alias("n")).filter("n > 1").select(
        "digest", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    content = F.struct("role", "text")
    part = F.pmod(F.xxhash64("conv", "turn"), F.lit(PARTS)).cast("int")
    found = turns.select("digest", part.alias("part"), content.alias("content")).join(repeated, ["digest", "part"])
    found = found.groupBy("digest", "part").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    return found.groupBy("digest").agg((F.min("lo") == F.max("hi")).alias("same")).filter("NOT same").isEmpty()


# --- lists of ids -------------------------------------------------------------------------------

_NODE = ["depth", *_LANES]
_PIECES = ", ".join(f"{c} long" for c in _NODE) + ", first long, ids binary"
_PIECES_ARROW = pa.schema([*[(c, pa.int64()) for c in _NODE], ("first", pa.int64()), ("ids", pa.binary())])
_SHA = ", ".join(f"{c} long" for c in _NODE) + ", ends_sha256 string"
_SHA_ARROW = pa.schema([*[(c, pa.int64()) for c in _NODE], ("ends_sha256", pa.string())])


def _join_ids(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv) as pieces of comma-joined ids."""
    node, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((*node, ids[0], b",".join(b"%d" % i for i in ids)))

    for batch in stream:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node or len(ids) == PIECE_IDS:
                close()
                node, ids = key, []
            ids.append(conv)
            if len(out) >= 1_000:
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECES_ARROW)], schema=_PIECES_ARROW)
                out.clear()
    close()
    if out:
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECES_ARROW)], schema=_PIECES_ARROW)


def _digest_ids(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each node, which come in order."""
    node, sha, out = None, None, []
    for batch in stream:
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == node:
                sha.update(b",")
            else:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256()
            sha.update(ids)
        if len(out) >= 10_000:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), _SHA_ARROW)], schema=_SHA_ARROW)
            out = []
    if node is not None:
        out.append((*node, sha.hexdigest()))
    if out:
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), _SHA_ARROW)], schema=_SHA_ARROW)


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes that are the end of a path.  Ids are sorted and joined in parts of any node; what one
    task goes through for a node are pieces of ``PIECE_IDS`` ids."""
    ends = paths.filter(F.col("depth") == F.col("depths")).select(*_NODE, "conv")
    ordered = ends.repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    pieces = ordered.mapInArrow(_join_ids, _PIECES)
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digest_ids, _SHA)


def prefix_nodes(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    spread: int = 20, most: int = 4, bases: tuple[tuple[int, ...], ...] = BASES,
) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversation c starts with the first h turns of c - c % spread, h = crc32(c) % most, and goes on with its own turns after
    its first h.  Turns are ordered by turn, null first, then by role, then by the digest of role and text; null roles and
    texts are empty.  Equal rows are turns of their own.  Rows without an id belong to no conversation; an empty table
    has no node, not even the root.  Fingerprints that fail the verification are made anew with other bases.
    """
    normal = _normal(turns, id_col, turn_col, role_col, text_col)
    for chosen in bases:
        prefixes = turn_prefixes(normal, chosen)
        paths = store(_paths(prefixes, spread, most, chosen), "paths")
        if chosen == bases[0] and not _same_content(normal, prefixes.select("digest", "conv")):
            raise ValueError("two different turns have one digest")
        checks = [*[f"a{i}" for i in range(LANES)], "d0", "d1"]
        nodes = paths.groupBy(*_NODE).agg(
            F.min("conv").alias("owner"), F.min("before").alias("before"), F.count("conv").alias("n_convs"), F.count(F.when(F.col("depth") == F.col("depths"), 1)).alias("n_ends"),
            *[F.min(c).alias(f"least_{c}") for c in checks], *[F.max(c).alias(f"most_{c}") for c in checks])
        nodes = store(nodes, "nodes")
        differ = " OR ".join(f"least_{c} <> most_{c}" for c in checks)
        if nodes.filter(differ).isEmpty():
            break
        discard(nodes, paths)
    else:
        raise ValueError("no bases tell all sequences apart")
    release(turns.sparkSession)
    # the words before a node are the same on all its paths
    owners = nodes.groupBy(F.col("owner").alias("conv")).agg(
        F.min(F.struct("depth", "before")).alias("own"), F.max(F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0)).alias("leaf")).select(
        "conv", F.col("own.depth").alias("first"), F.col("own.before").alias("first_before"), "leaf")
    marked = paths.join(owners, "conv", "left")
    below = F.col("path_words") - F.col("before")
    once = F.when(F.col("first").isNull(), 0).otherwise(F.col("path_words") - F.greatest("before", "first_before"))
    sums = marked.groupBy(*_NODE).agg(
        F.count(F.when((F.col("depths") > F.col("depth")) & (F.col("first") <= F.col("depth") + 1), 1)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum(below - once).alias("saved_tokens"))
    whole = nodes.select(*_NODE, *[F.col(f"least_a{i}").alias(f"a{i}") for i in range(LANES)], "owner", "n_convs").join(sums, _NODE).join(_ends(paths), _NODE, "left")
    up = nodes.select(F.col("depth").alias("depth_up"), *[F.col(c).alias(f"u{i}") for i, c in enumerate(_LANES)], F.col("owner").alias("parent_conv_id"))
    same = [F.col("depth") == F.col("depth_up") + 1, *[F.col(f"a{i}") == F.col(f"u{i}") for i in range(LANES)]]
    none = hashlib.sha256().hexdigest()
    return whole.join(up, same, "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


@query("op11_conversation_prefix_trie", """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
crc_lists AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_lists),
rebuilt AS (
  SELECT c.conv_id, t.pos AS pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1000000 + t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM rebuilt),
steps AS (SELECT *, dense_rank() OVER (ORDER BY role, text) AS name FROM placed),
paths AS (
  SELECT conv_id, depth, words, list(name) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depths FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(CASE WHEN depth = depths THEN conv_id END AS VARCHAR), ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth),
trie AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND n.path[:n.depth - 1] = p.path)
SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children,
       CAST(sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum((s.n_convs - 1) * s.words) AS BIGINT) AS saved_tokens, t.ends_sha256
FROM trie t JOIN trie s ON s.depth >= t.depth AND s.path[:t.depth] = t.path
GROUP BY t.path, t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children, t.ends_sha256
""")
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(read(spark, sf_dir, "conversations"))
