"""Joins that keep their shape under skew, and the prior joins of the enrichment step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.blocks import DEFAULT_POLICY, SplitDecision, SplitPolicy, decide, hot_groups


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Ask for a broadcast only after counting: one small job that stops at ``max_rows``. A larger table keeps the join
    strategy Spark picks from its statistics."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                spread: Sequence[str] = (), salts: int = 256,
                policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Without a hot key this is the plain join. Otherwise rows of a hot key are spread over ``salts`` partitions by a hash
    of ``spread`` (columns that differ between rows), and the matching right rows are copied to each; other keys are not
    touched. The right side must be small per key (a dimension or one row per key).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError("salting keeps the left rows apart, so it fits inner, left, semi and anti joins")
    width = decide(left, on, policy).width
    if width is None:
        return left.join(right, list(on), how)
    hot = hot_groups(left.select(*on), on, width).select(*on, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(hot), list(on), "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    ).drop("__hot")
    copies = (
        right.join(F.broadcast(hot), list(on), "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return marked.join(copies, [*on, "__salt"], how).drop("__salt")


def with_group_row(df: DataFrame, per_group: DataFrame, by: Sequence[str], constant: Sequence[str],
                   spread: Sequence[str], policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Attach the one row a group has in ``per_group``. Without real keys (``by`` empty) that is a single row in all, which
    is broadcast; with keys it is a join that splits hot groups."""
    if not by:
        return df.join(F.broadcast(per_group), list(constant))
    return salted_join(df, per_group, [*by, *constant], "inner", spread, policy=policy)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then by the other columns that can be compared, so that every run keeps the same one.
    The aggregate combines within tasks, so a key may be as hot as it likes."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    plain = [f.name for f in df.schema.fields if f.name in rest and f.name not in order and _comparable(f.dataType)]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in [*order, *plain]]))
    return df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(first.alias("__first")).select(
        *[F.col(f"`{c}`") if c in key else F.col("__first").getField(c).alias(c) for c in df.columns]
    )


def _comparable(kind: T.DataType) -> bool:
    """Whether Spark orders and hashes values of this type: anything without a map or variant in it."""
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return _comparable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; a hash of the row settles ties. For wide rows of which few repeat a key: repeats are found by
    a count over the keys alone, and only rows of such keys move whole, combined within tasks, so a key may be as hot as it likes. Null is a
    key like others. The source is read three times, so it should be a written table."""
    names = [f"__key{i}" for i in range(len(key))]
    repeated = df.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(key, names, strict=True)]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    same = [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)]
    rest = [c for c in df.columns if c not in key]
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in rest and _comparable(f.dataType)]
    place = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(F.lit(0), *hashed).alias("h"))
    first = F.min_by(F.struct(F.lit(0).alias("__any"), *[F.col(f"`{c}`") for c in rest]), place)
    copies = df.join(repeated, same, "left_semi").groupBy(*[F.col(f"`{c}`") for c in key]).agg(first.alias("__first")).select(
        *[F.col(f"`{c}`") if c in key else F.col("__first").getField(c).alias(c) for c in df.columns]
    )
    return df.join(repeated, same, "left_anti").unionByName(copies)


def attach(base: DataFrame, labels: DataFrame, key: Sequence[str], columns: Sequence[str], spread: Sequence[str] = (),
           policy: SplitPolicy | SplitDecision = DEFAULT_POLICY, order: Sequence[str] = ()) -> DataFrame:
    """Left join of one label row per key. The label table is reduced to one row per key first: the first by ``order`` (the position of the
    rows in their source, say), without it the smallest."""
    asked = [*key, *columns]
    slim = first_per_key(labels.select(*asked, *[c for c in order if c not in asked]), key, order).select(*asked)
    return salted_join(base, slim, key, "left", spread or key, policy=policy)


def attach_side_prior(shots: DataFrame, priors: DataFrame | None, name: str, opponent: bool = False,
                      match: str = "match_id", home: str = "is_home", spread: Sequence[str] = ("shot_id",),
                      policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Attach a per-side log-odds prior by (match, side), or by the other side with ``opponent``.

    Shots without a prior, or all shots when there is no prior table, get the neutral values 0 and 1.
    """
    logit, mult = f"{name}_logit", f"{name}_multiplier"
    if priors is None:
        return shots.withColumns({logit: F.lit(0.0), mult: F.lit(1.0)})
    side = ~F.col(home) if opponent else F.col(home)
    table = priors.select(match, F.col(home).alias("__side"), logit, mult)
    joined = salted_join(shots.withColumn("__side", side), table, [match, "__side"], "left", spread, policy=policy)
    return joined.drop("__side").fillna({logit: 0.0, mult: 1.0})


def attach_bucket_prior(shots: DataFrame, priors: DataFrame | None, key: Column, key_columns: Sequence[str],
                        name: str) -> DataFrame:
    """Attach a bucket prior. The table has one row per label combination; it is broadcast after its size was checked, so a
    bucket that holds most shots is never shuffled."""
    from touchline.functions.labels import bucket_key

    logit, mult, prob = f"{name}_logit", f"{name}_multiplier", f"{name}_modeled_prob"
    if priors is None:
        return shots.withColumns(
            {logit: F.lit(0.0), mult: F.lit(1.0), prob: F.lit(None).cast("double")}
        )
    table = priors.select(
        bucket_key(*[F.col(c) for c in key_columns]).alias("__bucket"),
        F.col("bucket_logit").alias(logit),
        F.col("odds_multiplier").alias(mult),
        F.col("modeled_prob").alias(prob),
    )
    joined = shots.withColumn("__bucket", key).join(broadcast_if_small(table), "__bucket", "left").drop("__bucket")
    return joined.fillna({logit: 0.0, mult: 1.0})


def insert_if_absent(source: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of the source whose key is not in the target yet, one per key (the first by ``order``): the rows to append."""
    return first_per_key(source, keys, order).join(target.select(*keys), list(keys), "left_anti")


def scope(df: DataFrame, allowed: DataFrame | None, keys: Sequence[str], spread: Sequence[str],
          policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Keep rows whose key is allowed; no table means no filter. ``spread`` differs between rows of one key."""
    return df if allowed is None else salted_join(df, allowed.select(*keys), keys, "left_semi", spread, policy=policy)


def resolve_model(registry: DataFrame, model_name: str, version: str | None = None, by: str = "version") -> DataFrame:
    """The registry row of a model: an exact version, else the newest by version string or by creation time."""
    rows = registry.where(F.col("model_name") == model_name)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return rows.orderBy(F.col(by).desc()).limit(1)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def fill_by_mapping(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    present = {k: v for k, v in values.items() if k in df.columns}
    return df.fillna(present) if present else df
