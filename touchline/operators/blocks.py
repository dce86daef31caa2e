"""Ordered windows that survive a hot group.

A window ``PARTITION BY match ORDER BY time`` sends each group to one task, so a group holding a third of the table would
run on one core. ``OrderedScan`` cuts such a group into consecutive blocks along its order, runs the window per
(group, block), and hands each block what it needs from the earlier ones as a few *carry rows*. Ordinary groups stay in
block 0 and need no carry rows. Without a hot group the plan is the plain window: one exchange.

Blocks come from a sample of the order keys (as in a range partitioning); the sample decides only where a group is cut,
never which rows are kept, so results do not depend on it. The order must be total inside a group: add an id as last column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLOCK, _RANK, _SPLITS, _COARSE = "__block", "__rank", "__splits", "__coarse"
_OVERSAMPLE = 16
_FAN = 64


@dataclass(frozen=True)
class SplitPolicy:
    """A group is hot when it has more rows than both ``min_rows`` and ``total / max_blocks``.

    The second term bounds what is broadcast whatever the data size: fewer than ``max_blocks`` groups can be hot, and
    together they have at most about ``2 * max_blocks`` cut points.
    """

    min_rows: int = 2_000_000
    max_blocks: int = 4096


DEFAULT_POLICY = SplitPolicy()


@dataclass(frozen=True)
class SplitDecision:
    """Outcome of looking at the group sizes once: rows per block, or None when no group needs cutting."""

    width: float | None


def decide(df: DataFrame, by: Sequence[str], policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> SplitDecision:
    """Read the group sizes (only the key columns are scanned, counts combine map-side) and set the block width.

    This runs one small job, as a range partitioning does for its sample. A decision taken on a superset of the rows
    may be reused for several scans over the same key.
    """
    if isinstance(policy, SplitDecision):
        return policy
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    top, total = sizes.agg(F.max("__n"), F.sum("__n")).first()
    width = max(float(policy.min_rows), (total or 0) / policy.max_blocks)
    return SplitDecision(width if (top or 0) > width else None)


def decide_reduced(rows: DataFrame, reduced: DataFrame, by: Sequence[str],
                   policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> SplitDecision:
    """Decision for a table reduced from ``rows`` (say to distinct values). A group cannot be larger than its rows were, so
    the sizes of the rows, which need no other column, usually settle it; only then is the reduced table counted."""
    first = decide(rows, by, policy)
    return first if isinstance(policy, SplitDecision) or first.width is None else decide(reduced, by, policy)


def hot_groups(df: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """Groups with more rows than ``width``: fewer than ``max_blocks`` of them, by the choice of the width."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.where(F.col("__n") > F.lit(width))


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def _cut_points(df: DataFrame, by: Sequence[str], order: Sequence[str], width: float) -> DataFrame:
    hot = hot_groups(df.select(*by), by, width)
    renamed = hot.select(*[F.col(c).alias(f"__h_{c}") for c in by])
    slim = df.select(*by, *[c for c in order if c not in by])
    step = max(1, int(width / _OVERSAMPLE))
    picked = (
        slim.join(F.broadcast(renamed), _null_safe(slim, renamed, [(c, f"__h_{c}") for c in by]))
        .where(F.pmod(F.xxhash64(*by, *order), step) == 0)
        .groupBy(*[f"__h_{c}" for c in by])
        .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("__sample"))
    )
    splits = F.filter("__sample", lambda x, i: (i % _OVERSAMPLE) == _OVERSAMPLE - 1)
    return picked.select(*[f"__h_{c}" for c in by], splits.alias(_SPLITS)).withColumn(
        _COARSE, F.filter(_SPLITS, lambda x, i: (i % _FAN) == _FAN - 1)
    )


def with_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], width: float) -> DataFrame:
    """Add a block number: 0 for ordinary groups, increasing along ``order`` inside a hot one."""
    cuts = _cut_points(df, by, order, width)
    joined = df.join(F.broadcast(cuts), _null_safe(df, cuts, [(c, f"__h_{c}") for c in by]), "left")
    key = F.struct(*order)
    group = F.size(F.filter(_COARSE, lambda cut: cut <= key))
    rest = F.size(F.filter(F.slice(F.col(_SPLITS), group * _FAN + 1, F.lit(_FAN)), lambda cut: cut <= key))
    block = F.when(F.col(_SPLITS).isNull(), F.lit(0)).otherwise(group * _FAN + rest)
    return joined.withColumn(_BLOCK, block.cast("int")).withColumn("__hot", F.col(_SPLITS).isNotNull()).drop(
        _SPLITS, _COARSE, *[f"__h_{c}" for c in by]
    )


@dataclass
class _Spec:
    name: str
    kind: str
    within: tuple[str, ...]
    inclusive: bool
    helper: str
    rows: int = 0
    fn: str = "sum"


@dataclass
class OrderedScan:
    """Collects window requests over one ordering and answers them all in one pass.

    ``by`` partitions the rows, ``order`` is the total ascending order inside a group. A request may narrow the
    partition further with ``within``; it still shares the exchange on ``by``.
    """

    df: DataFrame
    by: Sequence[str]
    order: Sequence[str]
    policy: SplitPolicy | SplitDecision = DEFAULT_POLICY
    _specs: list[_Spec] = field(default_factory=list)
    _helpers: dict[str, Column] = field(default_factory=dict)

    def _add(self, name: str, kind: str, value: Column, within: Sequence[str], inclusive: bool, rows: int = 0,
             fn: str = "sum") -> OrderedScan:
        helper = f"__v{len(self._specs)}"
        self._helpers[helper] = value
        self._specs.append(_Spec(name, kind, tuple(within), inclusive, helper, rows, fn))
        return self

    def running_sum(self, name: str, value: Column, within: Sequence[str] = (), inclusive: bool = False) -> OrderedScan:
        """Sum over the earlier rows (and this one if ``inclusive``); 0 when there are none."""
        return self._add(name, "sum", value, within, inclusive)

    def row_number(self, name: str, within: Sequence[str] = ()) -> OrderedScan:
        return self._add(name, "sum", F.lit(1).cast("long"), within, True)

    def last_seen(self, name: str, payload: Column, within: Sequence[str] = (), inclusive: bool = True) -> OrderedScan:
        """Latest non-null payload so far. Make the payload null on rows that are not candidates."""
        return self._add(name, "last", payload, within, inclusive)

    def first_seen(self, name: str, payload: Column, within: Sequence[str] = ()) -> OrderedScan:
        return self._add(name, "first", payload, within, True)

    def previous_rows(self, name: str, fn: str, value: Column, rows: int) -> OrderedScan:
        """``fn`` (sum, avg or count) over the ``rows`` rows before this one; null (count: 0) when there are none."""
        return self._add(name, "tail", value, (), False, rows, fn)

    # -- carry rows ------------------------------------------------------------------------------------------

    def _state_carry(self, hot: DataFrame, within: tuple[str, ...], specs: list[_Spec]) -> DataFrame:
        part = [*self.by, *within]
        aggs = []
        for s in specs:
            v, ordered = F.col(s.helper), F.struct(*self.order)
            if s.kind == "sum":
                aggs.append(F.sum(v).alias(s.helper))
            elif s.kind == "last":
                aggs.append(F.max_by(v, F.when(v.isNotNull(), ordered)).alias(s.helper))
            else:
                aggs.append(F.min_by(v, F.when(v.isNotNull(), ordered)).alias(s.helper))
        prior = W.partitionBy(*part).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
        outs = []
        for s in specs:
            v = F.col(s.helper)
            over = {"sum": F.sum(v), "last": F.last(v, True), "first": F.first(v, True)}[s.kind].over(prior)
            outs.append(over.alias(s.helper))
        blocks = hot.groupBy(*part, _BLOCK).agg(*aggs)
        carried = blocks.select(*part, _BLOCK, *outs)
        some = F.lit(False)
        for s in specs:
            some = some | F.col(s.helper).isNotNull()
        return carried.where(some).withColumn(_RANK, F.lit(0))

    def _tail_carry(self, hot: DataFrame, specs: list[_Spec]) -> DataFrame:
        n = max(s.rows for s in specs)
        extra = [c for c in self.order if c not in self.by]
        row = F.struct(*extra, *[s.helper for s in specs])
        newest_first = W.partitionBy(*self.by, _BLOCK).orderBy(*[F.col(c).desc() for c in self.order])
        tails = (
            hot.select(*self.by, *extra, _BLOCK, *[s.helper for s in specs])
            .withColumn("__rn", F.row_number().over(newest_first))
            .where(F.col("__rn") <= n)
        )
        along = W.partitionBy(*self.by).orderBy(_BLOCK, *self.order)
        head = W.partitionBy(*self.by, _BLOCK).orderBy(*self.order)
        before = (
            tails.withColumn("__rows", F.collect_list(row).over(along.rowsBetween(-n, -1)))
            .withColumn("__first", F.row_number().over(head))
            .where(F.col("__first") == 1)
        )
        return before.select(*self.by, _BLOCK, F.explode("__rows").alias("__r")).select(
            *self.by, _BLOCK, "__r.*", F.lit(1).alias(_RANK)
        )

    # -- result ----------------------------------------------------------------------------------------------

    def result(self) -> DataFrame:
        columns = self.df.columns
        width = decide(self.df, self.by, self.policy).width
        stream = self.df.withColumns(self._helpers)
        block: list[str] = []
        rank: list[str] = []
        if width is not None:
            stream, block, rank = self._with_carries(stream, width), [_BLOCK], [_RANK]
        if any(s.within for s in self._specs):
            # one exchange on the coarse key serves the narrower partitions as well
            stream = stream.repartition(*self.by, *block)
        out = []
        for s in self._specs:
            w = W.partitionBy(*self.by, *block, *s.within).orderBy(*rank, *self.order)
            v = F.col(s.helper)
            frame = w.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1)
            if s.kind == "sum":
                total = F.sum(v).over(frame)
                out.append(F.coalesce(total, F.lit(0)).alias(s.name))
            elif s.kind == "last":
                out.append(F.last(v, True).over(frame).alias(s.name))
            elif s.kind == "first":
                out.append(F.first(v, True).over(frame).alias(s.name))
            else:
                fn = {"sum": F.sum, "avg": F.avg, "count": F.count}[s.fn]
                out.append(fn(v).over(w.rowsBetween(-s.rows, -1)).alias(s.name))
        done = stream.select(*columns, *out, *rank)
        return done.where(F.col(_RANK) == 2).drop(_RANK) if rank else done

    def _with_carries(self, df: DataFrame, width: float) -> DataFrame:
        work = with_blocks(df, self.by, self.order, width)
        hot = work.where("__hot")
        stream = work.drop("__hot").withColumn(_RANK, F.lit(2))
        state: dict[tuple[str, ...], list[_Spec]] = {}
        for s in self._specs:
            if s.kind != "tail":
                state.setdefault(s.within, []).append(s)
        carries = [self._state_carry(hot, within, specs) for within, specs in state.items()]
        tails = [s for s in self._specs if s.kind == "tail"]
        if tails:
            carries.append(self._tail_carry(hot, tails))
        for carry in carries:
            stream = stream.unionByName(carry, allowMissingColumns=True)
        return stream
