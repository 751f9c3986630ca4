"""Window features over the rows strictly before the current one.

A feature is a name, an expression over a window, and how many rows it looks back.  All features of
one call share a (key, order), so Spark plans one shuffle and one sort for them.  The features of this
module read the few rows before as structs, one ``lag`` a row back, instead of a frame each.  Keys that hold more
than ``max_rows`` rows are cut into blocks of row numbers; each block also receives the last
``lookback`` rows of the block before it, which is all a bounded frame can see.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lagwise.operators.ordering import HOT_ROWS, Limit, chunked, join_offsets, key_join, row_numbers, running_totals, split_frequent
from lagwise.session import compiled_methods

SEQ = "_seq"
BLOCK_ROWS = 100_000


class Past:
    """Values of the rows before the current one, all inputs of a row in one struct ``_past<i>``."""

    def __init__(self) -> None:
        self.rows, self.inputs = 0, {}

    def seen(self, i: int) -> Column:
        """Whether there is a row ``i`` rows before."""
        self.rows = max(self.rows, i)
        return F.col(f"_past{i}").isNotNull()

    def back(self, column: str | Column, i: int) -> Column:
        """The value ``i`` rows before, null where there is no such row."""
        self.rows = max(self.rows, i)
        # a column object is kept with its place, so that its id stays its own
        place = column if isinstance(column, str) else id(column)
        name, _ = self.inputs.setdefault(place, (f"_v{len(self.inputs)}", column))
        return F.col(f"_past{i}")[name]

    def numbers(self, column: str | Column, k: int) -> list[Column]:
        """The last k values as doubles, the oldest first."""
        return [self.back(column, i).cast("double") for i in range(k, 0, -1)]

    def row(self) -> Column:
        return F.struct(F.lit(True).alias("_row"), *[_col(c).alias(n) for n, c in self.inputs.values()])


@dataclass(frozen=True)
class Feature:
    """A column computed from the ``lookback`` rows before the current row: by ``over`` from a window, or by ``near``, which
    must give the same, from the rows themselves."""

    name: str
    lookback: int
    over: Callable[[WindowSpec], Column]
    near: Callable[[Past], Column] | None = None


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _last(k: int, spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(-k, -1)


def _added(values: Sequence[Column]) -> Column:
    """Sum in the order of a frame, 0 where all are null."""
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])


def _count(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("bigint") for v in values])


def _sum(values: Sequence[Column]) -> Column:
    """Sum of the known values, null where all are null."""
    return F.when(F.coalesce(*values).isNotNull(), _added(values))


def _mean(values: Sequence[Column]) -> Column:
    return _added(values) / _count(values)


def _std(values: Sequence[Column]) -> Column:
    mean = _mean(values)
    return F.sqrt(_added([(v - mean) * (v - mean) for v in values]) / _count(values))


def prev_sum(column: str | Column, k: int, name: str) -> Feature:
    """Sum of the last k earlier values; 0 without history."""
    return Feature(name, k, lambda w: F.coalesce(F.sum(_col(column)).over(_last(k, w)), F.lit(0.0)), lambda p: _added(p.numbers(column, k)))


def prev_count(column: str | Column, k: int, name: str) -> Feature:
    """Observed (non-null) values among the last k earlier rows."""
    return Feature(name, k, lambda w: F.count(_col(column)).over(_last(k, w)), lambda p: _count([p.back(column, i) for i in range(1, k + 1)]))


def prev_mean(column: str | Column, k: int, name: str) -> Feature:
    """Mean of the observed values among the last k earlier rows; 0 without any."""
    return Feature(
        name, k, lambda w: F.coalesce(F.avg(_col(column)).over(_last(k, w)), F.lit(0.0)),
        lambda p: F.when(F.coalesce(*p.numbers(column, k)).isNotNull(), _mean(p.numbers(column, k))).otherwise(0.0))


def prev_std(column: str | Column, k: int, name: str) -> Feature:
    """Population standard deviation over the last k earlier rows; 0 without history."""
    return Feature(
        name, k, lambda w: F.coalesce(F.stddev_pop(_col(column)).over(_last(k, w)), F.lit(0.0)),
        lambda p: F.when(F.coalesce(*p.numbers(column, k)).isNotNull(), _std(p.numbers(column, k))).otherwise(0.0))


def prev_value(column: str | Column, name: str) -> Feature:
    """Value of the row before, null at the first row."""
    return Feature(name, 1, lambda w: F.lag(_col(column)).over(w), lambda p: p.back(column, 1))


def window_size(k: int, name: str) -> Feature:
    """Number of earlier rows inside the k-row window."""
    return Feature(
        name, k, lambda w: F.count(F.lit(1)).over(_last(k, w)),
        lambda p: reduce(lambda a, b: a + b, [p.seen(i).cast("bigint") for i in range(1, k + 1)]))


def rate(events: str | Column, exposure: str | Column, k: int, name: str, per: float = 90.0) -> Feature:
    """per x (events / exposure) over the last k earlier rows; 0 where there is no exposure."""

    def over(w: WindowSpec) -> Column:
        total = F.sum(_col(exposure)).over(_last(k, w))
        return F.when(total > 0, F.lit(per) * F.sum(_col(events)).over(_last(k, w)) / total).otherwise(F.lit(0.0))

    def near(p: Past) -> Column:
        total = _added(p.numbers(exposure, k))
        return F.when(total > 0, F.lit(per) * _sum(p.numbers(events, k)) / total).otherwise(F.lit(0.0))

    return Feature(name, k, over, near)


def gated_rate(
    events: str | Column, exposure: str | Column, k: int, name: str,
    *, min_observations: int = 3, min_exposure: float = 180.0, per: float = 90.0,
) -> Feature:
    """Rate over the rows where the event was observed; null below either threshold."""
    gated = F.when(_col(events).isNotNull(), _col(exposure))

    def over(w: WindowSpec) -> Column:
        seen = F.count(_col(events)).over(_last(k, w))
        total = F.sum(gated).over(_last(k, w))
        enough = (seen >= min_observations) & (total >= min_exposure)
        return F.when(enough, F.lit(per) * F.sum(_col(events)).over(_last(k, w)) / total)

    def near(p: Past) -> Column:
        values, total = p.numbers(events, k), _sum(p.numbers(gated, k))
        return F.when((_count(values) >= min_observations) & (total >= min_exposure), F.lit(per) * _sum(values) / total)

    return Feature(name, k, over, near)


def trend(short: Feature, long: Feature, name: str) -> Feature:
    """Short horizon minus long horizon."""
    near = (lambda p: short.near(p) - long.near(p)) if short.near and long.near else None
    return Feature(name, max(short.lookback, long.lookback), lambda w: short.over(w) - long.over(w), near)


def days_since_previous(time: str, name: str) -> Feature:
    """Days between this row and the one before it; 0 at the first row."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return Feature(
        name, 1, lambda w: F.coalesce((micros - F.lag(micros).over(w)) / F.lit(86_400_000_000.0), F.lit(0.0)),
        lambda p: F.coalesce((micros - p.back(micros, 1)) / F.lit(86_400_000_000.0), F.lit(0.0)))


def _features(df: DataFrame, window: WindowSpec, counted: Sequence[Column], features: Sequence[Feature]) -> DataFrame:
    """All columns of ``df``, then ``counted`` and the features, from as many lags as the features look back."""
    past = Past()
    found = {f.name: f.near(past) for f in features if f.near}
    lags = [F.lag(past.row(), i).over(window).alias(f"_past{i}") for i in range(1, past.rows + 1)]
    read = df.select("*", *counted, *[f.over(window).alias(f.name) for f in features if not f.near], *lags)
    ready = [c for c in read.columns if not c.startswith("_past") and c not in {f.name for f in features if not f.near}]
    return read.select(*ready, *[found.get(f.name, F.col(f.name)).alias(f.name) for f in features])


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    features: Sequence[Feature],
    *,
    prior_count: str | None = None,
    max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """Append the features (and, if named, the number of earlier rows) to every row."""
    sort = [_col(c) for c in order]
    # dozens of features make one method of many thousand bytes
    ordinary, frequent = split_frequent(compiled_methods(df), keys, max_rows)
    window = Window.partitionBy(*keys).orderBy(*sort)
    counted = [(F.row_number().over(window) - 1).cast("bigint").alias(prior_count)] if prior_count else []
    result = _features(ordinary, window, counted, features)
    if frequent is None:
        return result
    lookback = max([f.lookback for f in features], default=1)
    size = max(BLOCK_ROWS, 10 * lookback)
    numbered = row_numbers(frequent, keys, sort, SEQ, max_rows=0)
    block = F.floor((F.col(SEQ) - 1) / size)
    is_tail = F.pmod(F.col(SEQ) - 1, F.lit(size)) >= size - lookback
    copies = F.when(is_tail, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(copies))
    blocked = Window.partitionBy(*keys, "_block").orderBy(SEQ)
    counted = [(F.col(SEQ) - 1).alias(prior_count)] if prior_count else []
    done = _features(spread, blocked, counted, features)
    return result.unionByName(done.filter("_home = _block").drop("_home", "_block", SEQ))


#: Logarithm of the weight that a block of an exponential mean may lose.
DECAY = 60.0


def _ewm_steps(value: Column, gap: Column, first: Column, alpha: float) -> tuple[Column, Column]:
    """(log of the weight kept, weight of the new value) at an observed row."""
    keep = F.pow(F.lit(1 - alpha), gap.cast("double"))
    total = keep + alpha
    kept = F.when(first, F.lit(0.0)).otherwise(F.log(keep / total))
    return F.when(value.isNotNull(), kept).otherwise(0.0), F.when(first, F.lit(1.0)).otherwise(alpha / total)


def with_ewm(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    columns: Mapping[str, str | Column],
    *,
    halflife: float | None = 2.0,
    alpha: float | None = None,
    initial: float | None = None,
    empty: float | None = 0.0,
    complete: Sequence[str] = (),
    max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """Exponentially weighted mean of the earlier values, old weight shrinking also across nulls.

    The recurrence s <- a*s + b*x is affine, so inside a block of values it is a running sum of
    b*x/(product of a) times the product of a: two ordinary window sums.  A block is long enough that
    whatever came before the previous block weighs less than 1e-26.  ``initial`` starts the state at a
    constant (every value then gets weight alpha); without it the first value seeds the state.
    Outputs named in ``complete`` have no nulls (a null there is an error), so that all of them share
    their windows.
    """
    a = alpha if alpha is not None else 1 - 0.5 ** (1 / halflife)
    length = max(8, math.ceil(60 / -math.log(1 - a)))
    sort = [_col(c) for c in order]
    full = {n: _col(c).cast("double") for n, c in columns.items() if n in complete}
    holed = {n: c for n, c in columns.items() if n not in complete}
    ordinary, frequent = split_frequent(df, keys, max_rows)
    result = _ewm_complete(ordinary, keys, sort, full, a, length, initial, empty, False) if full else ordinary
    if holed:
        result = _ewm_ordinary(result, keys, sort, holed, a, initial, empty)
    if frequent is None:
        return result
    large = _ewm_complete(frequent, keys, sort, full, a, length, initial, empty, True) if full else frequent
    if holed:
        large = _ewm_frequent(large, keys, sort, holed, a, initial, empty)
    return result.unionByName(large)


def _ewm_complete(df, keys, sort, columns, alpha, length, initial, empty, frequent):
    """Columns without nulls: the weight kept is the same at every row, so one block number serves all."""
    if frequent:
        numbered = row_numbers(df, keys, sort, "_rn", max_rows=0)
    else:
        numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)).cast("bigint"))
    place = F.pmod(F.col("_rn") - 1, F.lit(length))
    grow = F.pow(F.lit(1 / (1 - alpha)), (F.col("_j") + 1).cast("double"))
    weight = F.lit(alpha) if initial is not None else F.when(F.col("_rn") == 1, 1.0).otherwise(alpha)
    staged = numbered.withColumn("_b", F.floor((F.col("_rn") - 1) / length)).withColumn("_j", place)
    checked = {n: F.when(c.isNull(), F.raise_error(F.lit(f"null in {n}"))).otherwise(c) for n, c in columns.items()}
    staged = staged.withColumns({f"_w_{n}": weight * c * grow for n, c in checked.items()})
    block = Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    staged = staged.select("*", *[F.coalesce(F.sum(f"_w_{n}").over(block), F.lit(0.0)).alias(f"_t_{n}") for n in columns])
    end = (1 - alpha) ** length
    if frequent:
        totals = staged.groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg(*[F.sum(f"_w_{n}").alias(f"_e_{n}") for n in columns])
        staged = key_join(staged, totals, [*keys, "_b"])
    else:
        earlier = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
        staged = staged.select("*", *[F.sum(f"_w_{n}").over(earlier).alias(f"_e_{n}") for n in columns])
    seed = F.lit(0.0 if initial is None else initial)
    shrink = F.pow(F.lit(1 - alpha), F.col("_j").cast("double"))
    states = []
    for n in columns:
        state = shrink * (F.when(F.col("_b") > 0, F.col(f"_e_{n}") * end).otherwise(seed) + F.col(f"_t_{n}"))
        if initial is None:
            state = F.when(F.col("_rn") == 1, F.lit(empty).cast("double")).otherwise(state)
        states.append(state.alias(n))
    return staged.select(*df.columns, *states)


def _ewm_ordinary(df, keys, sort, columns, alpha, initial, empty):
    names = list(columns)
    history = Window.partitionBy(*keys).orderBy(*sort)
    upto = history.rowsBetween(Window.unboundedPreceding, 0)
    before = history.rowsBetween(Window.unboundedPreceding, -1)
    staged = df.select(
        "*", F.row_number().over(history).alias("_rn"),
        *[_col(c).cast("double").alias(f"_x_{n}") for n, c in columns.items()],
    )
    staged = staged.select(
        "*",
        *[F.count(f"_x_{n}").over(upto).alias(f"_i_{n}") for n in names],
        *[
            F.last(F.when(F.col(f"_x_{n}").isNotNull(), F.col("_rn")), True).over(before).alias(f"_p_{n}")
            for n in names
        ],
    )
    work = staged
    for n in names:
        work = _ewm_state(work, keys, sort, n, alpha, initial)
    start = F.lit(initial) if initial is not None else F.lit(empty)
    final = [F.coalesce(F.last(f"_s_{n}", True).over(before), start.cast("double")).alias(n) for n in names]
    return work.select(*df.columns, *final)


def _ewm_state(work: DataFrame, keys, sort, n: str, alpha: float, initial) -> DataFrame:
    """Add _s_<n>: the state right after each observed value.

    Blocks end where the weight kept since the key's start has shrunk by another ``e ** -DECAY``: what came before the
    previous block has no weight left, and the weights inside a block stay far from overflow, however many rows lie
    between two values.
    """
    x, i = F.col(f"_x_{n}"), F.col(f"_i_{n}")
    seen, first = x.isNotNull(), F.lit(False) if initial is not None else i == 1
    gap = F.col("_rn") - F.coalesce(F.col(f"_p_{n}"), F.col("_rn") - 1)
    kept, weight = _ewm_steps(x, gap, first, alpha)
    columns = work.columns
    history = Window.partitionBy(*keys).orderBy(*sort)
    upto = history.rowsBetween(Window.unboundedPreceding, 0)
    steps = work.withColumn("_k", kept)
    steps = steps.withColumn("_d", F.floor(F.sum(F.least(-F.col("_k"), F.lit(2.0 * DECAY))).over(upto) / DECAY))
    steps = steps.withColumn("_new", (F.col("_d") > F.coalesce(F.lag("_d").over(history), F.lit(0))).cast("int"))
    logs = steps.withColumn("_b", F.sum("_new").over(upto))
    inside = Window.partitionBy(*keys, "_b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
    logs = logs.withColumn("_kf", F.first(F.when(seen, F.col("_k")), True).over(inside))
    logs = logs.withColumn("_q", F.sum("_k").over(inside) - F.col("_kf"))
    logs = logs.withColumn("_t", F.sum(F.when(seen, weight * x * F.exp(-F.col("_q")))).over(inside))
    logs = logs.withColumn("_e", F.max_by(F.exp("_q") * F.col("_t"), F.when(seen, F.col("_rn"))).over(earlier))
    seed = F.coalesce(F.when(F.col("_b") > 0, F.col("_e")), F.lit(0.0 if initial is None else initial))
    state = F.when(seen, F.exp("_q") * (F.exp("_kf") * seed + F.col("_t")))
    return logs.withColumn(f"_s_{n}", state).select(*columns, f"_s_{n}")


def _ewm_frequent(df, keys, sort, columns, alpha, initial, empty):
    """The same recurrence on a key of any size: observed values are blocked on their own, the state is
    carried to later rows inside each stretch and from stretch to stretch."""
    start = float(initial if initial is not None else empty) if (initial is not None or empty is not None) else None
    numbered = row_numbers(df, keys, sort, "_rn", max_rows=0)
    base = chunked(numbered, keys, [F.col("_rn")])
    output = base
    for n, column in columns.items():
        values = base.select(*keys, "_rn", _col(column).cast("double").alias(f"_x_{n}")).filter(F.col(f"_x_{n}").isNotNull())
        indexed = row_numbers(values, keys, [F.col("_rn")], f"_i_{n}", max_rows=0)
        indexed = with_history(indexed, keys, ["_rn"], [prev_value("_rn", f"_p_{n}")], max_rows=0)
        state = _ewm_value_states(indexed, keys, n, alpha, initial)
        joined = key_join(base.select(*keys, "_rn", "_chunk"), state, [*keys, "_rn"])
        local = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
        carried = joined.select("*", F.last(f"_s_{n}", True).over(local).alias("_near"))
        lasts = joined.groupBy(*keys, "_chunk").agg(
            F.max_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col("_rn"))).alias("_end"))
        over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        far = lasts.select(*keys, "_chunk", F.last("_end", True).over(over).alias("_off_far"))
        filled = join_offsets(carried, far, keys).select(
            *keys, "_rn", F.coalesce("_near", "_off_far", F.lit(start).cast("double")).alias(n))
        output = key_join(output, filled, [*keys, "_rn"], "inner")
    return output.drop("_rn", "_chunk")


def _ewm_value_states(values: DataFrame, keys, n: str, alpha: float, initial) -> DataFrame:
    """States at observed rows only, in blocks of the same rule; sums over a key run from stretch to stretch."""
    x, i = F.col(f"_x_{n}"), F.col(f"_i_{n}")
    first = F.lit(False) if initial is not None else i == 1
    gap = F.col("_rn") - F.coalesce(F.col(f"_p_{n}"), F.col("_rn") - 1)
    kept, weight = _ewm_steps(x, gap, first, alpha)
    steps = values.withColumn("_k", kept).withColumn("_w", weight)
    sums = {"_d": F.least(-F.col("_k"), F.lit(2.0 * DECAY))}
    steps = running_totals(steps, keys, [F.col("_rn")], sums, inclusive=True, max_rows=0).withColumn("_b", F.floor(F.col("_d") / DECAY))
    steps = with_history(steps, keys, ["_rn"], [prev_value("_b", "_pb")], max_rows=0)
    inside = Window.partitionBy(*keys, "_b").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    staged = steps.withColumn("_kf", F.first("_k").over(inside)).withColumn("_before", F.first("_pb").over(inside))
    staged = staged.withColumn("_q", F.sum("_k").over(inside) - F.col("_kf"))
    staged = staged.withColumn("_t", F.sum(F.col("_w") * x * F.exp(-F.col("_q"))).over(inside))
    ends = staged.groupBy(*keys, F.col("_b").alias("_before")).agg(F.max_by(F.exp("_q") * F.col("_t"), "_rn").alias("_e"))
    seeded = key_join(staged, ends, [*keys, "_before"])
    seed = F.when(F.col("_before").isNull(), F.lit(0.0 if initial is None else initial)).otherwise(F.col("_e"))
    return seeded.select(*keys, "_rn", (F.exp("_q") * (F.exp("_kf") * seed + F.col("_t"))).alias(f"_s_{n}"))
