"""Ordered scans over keyed rows that never put one whole key into one task.

A plain window over ``(session, ordinal)`` sends a session to a single task, which fails once a
session holds a large share of the data. Here every key is cut into chunks of consecutive
ordinals. Three cheap steps replace the window:

1. an ordinary window inside each ``(key, chunk)``, bounded by ``chunk_rows`` rows;
2. a map-side combined aggregate that leaves one row per ``(key, chunk)``, and a prefix tree over
   those: up to ``FAN`` neighbouring nodes share a parent, whose value is their fold, until one
   root is left; on the way down each node gets what its parent inherits and what its siblings
   add, from a window over siblings alone. A tree of any depth has windows of ``FAN`` rows at most;
3. an equi-join of both on ``(key, chunk)`` -- the partitioning step 1 already established.

Chunks are value ranges of the ordinal, which needs no sort. Where that would leave many chunks
with few rows each (sparse ordinals), they are cut by rows instead: range partitions of the order.

All supported scans are associative (sum, min, max, first / last non-null), so the result is
exactly that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from convhist.session import materialize

CHUNK_ROWS = 65_536
#: Children of a node in the prefix tree over chunks.
FAN = 65_536
#: A tree of several levels is cut by rows if its chunks hold fewer rows than this on average.
SPARSE_ROWS = 8
_CHUNK = "_chunk"
_UP = "_up"
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Scan:
    """One scan column. ``fold``: sum | max | min | value; ``span``: rows it looks at."""

    fold: str
    expr: Column
    span: str  # upto | before | from | after | all

    @property
    def forward(self) -> bool:
        return self.span in ("upto", "before")


def running_sum(expr: Column, strict: bool = False) -> Scan:
    return Scan("sum", expr, "before" if strict else "upto")


def running_max(expr: Column, strict: bool = False) -> Scan:
    return Scan("max", expr, "before" if strict else "upto")


def running_min(expr: Column, strict: bool = False) -> Scan:
    return Scan("min", expr, "before" if strict else "upto")


def remaining_min(expr: Column, strict: bool = True) -> Scan:
    return Scan("min", expr, "after" if strict else "from")


def remaining_max(expr: Column, strict: bool = True) -> Scan:
    return Scan("max", expr, "after" if strict else "from")


def remaining_sum(expr: Column, strict: bool = True) -> Scan:
    return Scan("sum", expr, "after" if strict else "from")


def last_value(expr: Column, strict: bool = False) -> Scan:
    """Latest non-null value up to (or, if strict, before) the row."""
    return Scan("value", expr, "before" if strict else "upto")


def next_value(expr: Column, strict: bool = True) -> Scan:
    """Nearest non-null value after (or, if not strict, from) the row."""
    return Scan("value", expr, "after" if strict else "from")


def previous_row(expr: Column) -> Scan:
    """lag(1), nulls included; the result is a struct with the single field ``v``."""
    return last_value(F.struct(expr.alias("v")), strict=True)


def following_row(expr: Column) -> Scan:
    """lead(1), nulls included; the result is a struct with the single field ``v``."""
    return next_value(F.struct(expr.alias("v")), strict=True)


def position() -> Scan:
    """1-based row number."""
    return running_sum(F.lit(1).cast("bigint"))


def total_sum(expr: Column) -> Scan:
    return Scan("sum", expr, "all")


def total_max(expr: Column) -> Scan:
    return Scan("max", expr, "all")


def total_min(expr: Column) -> Scan:
    return Scan("min", expr, "all")


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _partial(scan: Scan, order: Sequence[str]) -> Column:
    if scan.fold == "sum":
        return F.sum(scan.expr)
    if scan.fold == "max":
        return F.max(scan.expr)
    if scan.fold == "min":
        return F.min(scan.expr)
    key = F.when(scan.expr.isNotNull(), _order_key(order))
    return F.max_by(scan.expr, key) if scan.forward else F.min_by(scan.expr, key)


def _windowed(scan: Scan, value: Column, window) -> Column:
    if scan.fold == "sum":
        return F.sum(value).over(window)
    if scan.fold == "max":
        return F.max(value).over(window)
    if scan.fold == "min":
        return F.min(value).over(window)
    if scan.forward:
        return F.last(value, ignorenulls=True).over(window)
    return F.first(value, ignorenulls=True).over(window)


def _combined(scan: Scan, local: Column, carry: Column) -> Column:
    if scan.fold == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if scan.fold == "max":
        return F.greatest(local, carry)
    if scan.fold == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


_LOCAL_FRAME = {"upto": (_FIRST, 0), "before": (_FIRST, -1), "from": (0, _LAST), "after": (1, _LAST)}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    columns: Mapping[str, Scan],
    chunk_rows: int | None = None,
    chunk: str | None = None,
) -> DataFrame:
    """Add ``columns`` to ``df``.

    ``order`` must be unique per key. By default it is one integer column and the chunk is
    ``order div chunk_rows`` -- at most ``chunk_rows`` rows per (key, chunk). Any other order needs
    an existing ``chunk`` column that is monotone in it (see :func:`range_chunks`).
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rows = int(chunk_rows or CHUNK_ROWS)
    base = df.withColumn(_CHUNK, F.col(chunk) if chunk else F.expr(f"`{order[0]}` div {rows}L"))
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order)

    # One row per chunk, stored: chained scans read their input once more each instead of twice as often each, and
    # Spark can split a hot key of the join below.
    summary, bounds = _stored_nodes(base.groupBy(*keys, _CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"), *[_partial(spec, order).alias(f"_p_{name}") for name, spec in columns.items()]
    ))
    if not chunk and bounds.high - bounds.low >= FAN and bounds.rows < SPARSE_ROWS * bounds.nodes:
        return scan(range_chunks(df, keys, order), keys, order, columns, rows, "_range").drop("_range")
    summary = _inherited(summary, keys, columns, bounds.low, bounds.high)

    local = base.select(
        "*",
        *[
            _windowed(spec, spec.expr, inner.rowsBetween(*_LOCAL_FRAME[spec.span])).alias(f"_l_{name}")
            for name, spec in columns.items()
            if spec.span != "all"
        ],
    )
    result = []
    for name, spec in columns.items():
        carry = F.col(f"_c_{name}")
        value = carry if spec.span == "all" else _combined(spec, F.col(f"_l_{name}"), carry)
        result.append(value.alias(name))
    kept = [F.col(c) for c in df.columns if c not in columns]
    return local.join(summary, [*keys, _CHUNK]).select(*kept, *result)


@dataclass(frozen=True)
class _Bounds:
    """Least and greatest chunk of all keys, chunks and rows."""

    low: int
    high: int
    nodes: int
    rows: int


def _stored_nodes(nodes: DataFrame) -> tuple[DataFrame, _Bounds]:
    """Nodes as a table, with bounds that the job that writes them observes. ``nodes`` has ``_rows``."""
    seen = Observation()
    facts = [F.min(_CHUNK).alias("low"), F.max(_CHUNK).alias("high"), F.count(F.lit(1)).alias("nodes"), F.sum("_rows").alias("rows")]
    stored = materialize(nodes.observe(seen, *facts))
    found = seen.get
    return stored, _Bounds(*[int(found.get(name) or 0) for name in ("low", "high", "nodes", "rows")])


def _inherited(nodes: DataFrame, keys: list[str], columns: Mapping[str, Scan], low: int, high: int) -> DataFrame:
    """(keys, chunk, ``_c_`` columns): what each node inherits from the nodes before, after or around it.

    ``nodes`` have ``_p_`` columns, the fold of what is below them. Siblings are ``FAN`` consecutive chunk numbers, so no
    window has more rows than that; the parents' own inheritance comes from the next level of the tree.
    """
    parent = F.expr(f"({_CHUNK} - ({low}L)) div {FAN}L")  # never negative
    siblings = Window.partitionBy(*keys, _UP).orderBy(_CHUNK)
    children = nodes.withColumn(_UP, parent)

    def among(name: str, spec: Scan) -> Column:
        frame = {"all": (_FIRST, _LAST)}.get(spec.span, (_FIRST, -1) if spec.forward else (1, _LAST))
        return _windowed(spec, F.col(f"_p_{name}"), siblings.rowsBetween(*frame))

    if high - low < FAN:
        return children.select(*keys, _CHUNK, *[among(name, spec).alias(f"_c_{name}") for name, spec in columns.items()])
    folds = [_partial(Scan(spec.fold, F.col(f"_p_{name}"), spec.span), [_CHUNK]).alias(f"_p_{name}") for name, spec in columns.items()]
    parents = materialize(children.groupBy(*keys, _UP).agg(*folds)).withColumnRenamed(_UP, _CHUNK)
    above = _inherited(parents, keys, columns, 0, (high - low) // FAN).withColumnRenamed(_CHUNK, _UP)
    above = materialize(above.withColumnsRenamed({f"_c_{name}": f"_u_{name}" for name in columns}))
    local = children.select(*keys, _UP, _CHUNK, *[among(name, spec).alias(f"_l_{name}") for name, spec in columns.items() if spec.span != "all"])
    whole = [
        (F.col(f"_u_{name}") if spec.span == "all" else _combined(spec, F.col(f"_l_{name}"), F.col(f"_u_{name}"))).alias(f"_c_{name}")
        for name, spec in columns.items()
    ]
    return local.join(above, [*keys, _UP]).select(*keys, _CHUNK, *whole)


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_range") -> DataFrame:
    """Number range partitions of ``(keys, order)`` so that any sort order can be scanned.

    Range partitioning splits a hot key by sampled bounds. The bounds of two evaluations may
    differ, therefore the numbered rows are materialised once before anything reads them.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, size: str | None = None) -> DataFrame:
    """1-based exact rank per key under an arbitrary unique sort order, plus the group size."""
    columns = {rank: position()}
    if size:
        columns[size] = total_sum(F.lit(1).cast("bigint"))
    return scan(range_chunks(df, keys, order), keys, order, columns, chunk="_range").drop("_range")


def runs(
    df: DataFrame, keys: Sequence[str], order: str, same: Sequence[str], run: str, chunk_rows: int | None = None
) -> DataFrame:
    """Gaps-and-islands: number maximal runs of consecutive rows with equal ``same`` columns.

    Like :func:`scan`: runs are numbered inside each chunk, and the chunk summary (first and last
    value, number of runs) tells, through the prefix tree, how many runs end before a chunk and
    whether its first run continues the one before.
    """
    keys = list(keys)
    value = F.struct(*same)
    cut = F.expr(f"`{order}` div {int(chunk_rows or CHUNK_ROWS)}L")
    nodes, bounds, local = _run_nodes(df.withColumn(_CHUNK, cut), keys, order, value)
    if bounds.high - bounds.low >= FAN and bounds.rows < SPARSE_ROWS * bounds.nodes:
        ranged = range_chunks(df, keys, [order])
        nodes, bounds, local = _run_nodes(ranged.withColumnRenamed("_range", _CHUNK), keys, order, value)
    before = _inherited(nodes, keys, {"tail": Scan("value", F.col("_p_tail"), "before")}, bounds.low, bounds.high)
    joins = F.coalesce(F.col("_c_tail") == F.col("_head"), F.lit(False))
    steps = nodes.join(before, [*keys, _CHUNK]).withColumn("_p_base", F.col("_n") + F.when(joins, 0).otherwise(1)).withColumn("_new", F.when(joins, 0).otherwise(1))
    steps = materialize(steps.select(*keys, _CHUNK, "_p_base", "_new"))
    ahead = _inherited(steps, keys, {"base": Scan("sum", F.col("_p_base"), "before")}, bounds.low, bounds.high)
    base = steps.join(ahead, [*keys, _CHUNK]).select(*keys, _CHUNK, (F.coalesce("_c_base", F.lit(0)) + F.col("_new")).alias("_base"))
    kept = [F.col(c) for c in df.columns if c != run]
    return local.join(materialize(base), [*keys, _CHUNK]).select(*kept, (F.col("_base") + F.col("_local")).alias(run))


def _run_nodes(base: DataFrame, keys: list[str], order: str, value: Column) -> tuple[DataFrame, _Bounds, DataFrame]:
    """Chunks with the runs that begin inside them, their first and last value; bounds; rows numbered inside chunks."""
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    local = base.withColumn("_fresh", F.coalesce((F.lag(value).over(inner) != value).cast("bigint"), F.lit(0)))
    local = local.withColumn("_local", F.sum("_fresh").over(inner.rowsBetween(_FIRST, 0)))
    nodes, bounds = _stored_nodes(local.groupBy(*keys, _CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_local").alias("_n"), F.min_by(value, order).alias("_head"), F.max_by(value, order).alias("_p_tail")
    ))
    return nodes, bounds, local
