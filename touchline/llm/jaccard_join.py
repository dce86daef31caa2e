"""Exact Jaccard self-join on word shingles, answered up to connected components, by set relations.

1. Equal sets are one *node*. Nodes that look highly similar (several equal minima of hash functions) hang on one *centre*; how a node
   differs from its centre (its delta) is computed once.
2. Answers inside a centre's family follow from the deltas: two sets differ exactly where their deltas differ, so whole sets are never
   compared there. Members linked to the centre need no further answer among themselves; only the others are compared, block by block.
3. Between families an index lists, for each prefix token, families instead of sets, with a block's range of sizes and the most tokens
   that may follow its position. Lists are sorted by size and skipped from the first entry that is too large; entries whose positions
   leave too few tokens are skipped too. Pairs need several common prefix tokens, the more the larger they are.
4. A pair of families is decided by its centres and the triangle inequality; members are looked at only where these leave a doubt. Linked
   centres leave it for members that their own centre does not answer.

The order of tokens puts frequent ones last. It is taken from a sample of sets and a bit table of fixed size; any order gives the same
result, so the sample decides time, never answers.

Shingles are compared as 64-bit hashes. Defined cases: a null or empty text has no shingle and is linked with nothing; a text of fewer
words than a shingle is one shingle; rows with the same key and set are linked through their key; a null key gives a component of null;
all rows come back, once for each input row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import bitmap, components, written
from touchline.llm.text import WordHashes, mix

SHINGLE, PERCENT = 4, 85
MINIMA = 8
#: common minima that make a node try a centre, and the similarity in percent that lets it stay
TRY, STAY = 2, 50
#: common prefix tokens that a set of so many shingles asks for
COMMON, COMMON_EACH = 3, 50
BLOCK = 512
#: one set of so many is looked at for frequent tokens; a token in so many of them counts as frequent
SAMPLED, FREQUENT = 32, 3
_SETS = "id bigint, node bigint, n int, minima array<bigint>, tokens array<bigint>"
_POLY = np.uint64(0x100000001B3)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter. Sorted, distinct, as signed longs."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    width = min(size, len(hashes))
    runs = np.zeros(len(hashes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            runs = runs * _POLY + mix(hashes[k : k + len(runs)])
    return np.unique(mix(runs, width).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _views(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _minima(tokens: np.ndarray) -> np.ndarray:
    """The smallest token of each class of tokens by their last bits: what equal minima say of two sets, one pass can tell."""
    return tokens[np.unique(tokens & (MINIMA - 1), return_index=True)[1]]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, t): ``h`` is a hash of the id, to look it up in bit tables."""
    key = F.col(f"`{key}`").cast("bigint")
    return docs.select(key.alias("id"), F.xxhash64(key).alias("h"), F.col(f"`{text}`").cast("string").alias("t"))


def _built(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Ids, nodes and sets of the documents of some batches, a few at a time."""
    hashed = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            tokens = [shingles(h, size) for h in hashed(part.column(2))]
            with np.errstate(over="ignore"):
                nodes = np.array([mix(mix(t, 77).sum(dtype=np.uint64)[None], len(t))[0] for t in tokens], np.uint64).view(np.int64)
            yield part.column(0), nodes, tokens


def shingle_sets(docs: DataFrame, key: str, text: str, size: int, ids: np.ndarray | None = None) -> DataFrame:
    """(id, node, n, minima, tokens) of each document; with a bit table ``ids``, of those whose id it may hold. Sets are built anew from
    the texts wherever they are needed: that is cheaper than keeping them all."""
    shared = docs.sparkSession.sparkContext.broadcast(ids) if ids is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None:
            batches = (b.filter(pa.array(shared.value[b.column(1).to_numpy() & (len(shared.value) - 1)])) for b in batches)
        for ids, nodes, tokens in _built(batches, size):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nodes), pa.array([len(t) for t in tokens], pa.int32()), _lists([_minima(t) for t in tokens]), _lists(tokens)],
                names=["id", "node", "n", "minima", "tokens"],
            )

    return _rows(docs, key, text).mapInArrow(work, _SETS)


def _flagged(sets: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows whose node's bit is set in ``table``."""
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def work(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            yield batch.filter(pa.array(shared.value[nodes & (len(shared.value) - 1)]))

    return sets.mapInArrow(work, sets.schema)


def _one_each(docs: DataFrame, key: str, text: str, size: int, nodes: DataFrame) -> DataFrame:
    """The set of each of ``nodes`` (node, rep and more), once: that of its smallest id. Rows that repeat an id go too."""
    ids = bitmap(nodes.select(F.xxhash64("rep").alias("h")), "h")
    found = shingle_sets(docs, key, text, size, ids).select("id", "node", "n", "tokens")
    return found.join(nodes.withColumnRenamed("rep", "id"), ["id", "node"]).dropDuplicates(["id", "node"])


def _families(nodes: DataFrame) -> DataFrame:
    """(node, centre): for each node that shares some minima with a more central one."""
    keyed = nodes.select("node", F.explode("minima").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keyed = written(keyed.join(often, "key"))
    centrality = keyed.groupBy("node").agg(F.sum("c").alias("c"))
    central = keyed.select("key", "node").join(centrality, "node").groupBy("key").agg(F.max(F.struct("c", "node")).alias("m"))
    tries = (
        keyed.select("key", "node").join(central, "key").where("node != m.node")
        .groupBy("node", F.col("m.node").alias("centre"), F.col("m.c").alias("c")).agg(F.count("*").alias("same")).where(F.col("same") >= TRY)
    )
    tries = written(tries)
    roots = tries.join(tries.select(F.col("node").alias("centre")).distinct(), "centre", "left_anti")
    return roots.groupBy("node").agg(F.max_by("centre", F.struct("same", "c", "centre")).alias("centre"))


def _linked(inner, union, percent):
    return 100 * inner >= percent * union


def _deltas(own: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """For each node with a centre: where it differs from it, their Jaccard distance ``far`` and its prefix. A node that does not stay has
    no distance."""
    centres = own.where("is_centre").select(F.col("node").alias("centre"), F.col("tokens").alias("centre_tokens"))
    pairs = own.where("centre is not null").select("centre", "node", "n", "tokens").join(centres, "centre")
    shared = own.sparkSession.sparkContext.broadcast(frequent)

    def work(batches):
        for batch in batches:
            deltas, far, first = [], [], []
            for a, b in zip(_views(batch.column(3)), _views(batch.column(4)), strict=True):
                differ = np.setxor1d(a, b, assume_unique=True)
                inner, union = (len(a) + len(b) - len(differ)) // 2, (len(a) + len(b) + len(differ)) // 2
                stays = 100 * inner >= STAY * union
                deltas.append(differ if stays else differ[:0])
                far.append(len(differ) / union if stays else None)
                first.append(_first_tokens(a, shared.value, percent))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _lists(deltas), pa.array(far, pa.float64()), _lists(first)], names=["centre", "node", "n", "delta", "far", "first"]
            )

    return pairs.select("centre", "node", "n", "tokens", "centre_tokens").mapInArrow(
        work, "centre bigint, node bigint, n int, delta array<bigint>, far double, first array<bigint>"
    )


def delta_links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join up the rows of two blocks of one family, from deltas alone: |a ^ b| = |delta a| + |delta b| - 2 |common|.
    A link is left out only where both ends are already joined."""
    size, n = rows["d"].to_numpy(), rows["n"].to_numpy()
    joined = rows["joined"].to_numpy()
    open_at = np.flatnonzero(~joined)
    lengths = np.array([len(x) for x in rows["delta"]])
    tokens = np.concatenate(rows["delta"].to_list()) if len(rows) else np.empty(0, np.int64)
    _, codes, seen = np.unique(tokens, return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(rows)), lengths)
    shared = seen[codes] > 1
    codes, who = np.unique(codes[shared], return_inverse=True)[1], who[shared]
    common = np.zeros((len(open_at), len(rows)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, who = codes[order], who[order]
    width = 2048
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        a, b = np.searchsorted(codes, [low, low + width])
        table = np.zeros((len(rows), width), np.float32)
        table[who[a:b], codes[a:b] - low] = 1
        common += table[open_at] @ table.T
    differ = size[open_at][:, None] + size[None, :] - 2 * common.astype(np.int64)
    both = n[open_at][:, None] + n[None, :]
    hit = 100 * (both - differ) >= percent * (both + differ)
    root = np.arange(len(rows) + 1)
    root[:-1][joined] = len(rows)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    nodes, out = rows["node"].to_numpy(), []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = find(open_at[i]), find(j)
        if a != b:
            root[a] = b
            out.append((int(nodes[open_at[i]]), int(nodes[j])))
    return out


def _inside(deltas: DataFrame, percent: int) -> DataFrame:
    """Links among members of a family that its centre does not answer. Members are dealt to blocks, and pairs of blocks to tasks."""
    rows = deltas.drop("first").withColumns({"d": F.size("delta"), "joined": F.col("far") <= 1 - percent / 100 + 1e-12})
    counted = rows.groupBy("centre").agg(F.count("*").alias("m"), F.sum((~F.col("joined")).cast("int")).alias("open")).where("open > 0 and m > 1")
    rows = rows.join(counted, "centre").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select(
        "centre", "node", "n", "d", "joined", "delta", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"), "b"
    ).withColumns({"b1": F.least("b", "o"), "b2": F.greatest("b", "o")})

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(delta_links(rows, percent), columns=["u", "v"])

    return rows.groupBy("centre", "b1", "b2").applyInPandas(work, "u bigint, v bigint")


_ENTRIES = "token bigint, family bigint, n int, rest int"


def _common(n):
    return COMMON + n // COMMON_EACH


def _first_tokens(tokens: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set, frequent tokens (``late``) last: two sets that are similar enough share ``_common`` tokens of theirs."""
    n = len(tokens)
    p = min(n, n - -(-percent * n // 100) + _common(n))
    often = late[tokens & (len(late) - 1)]
    return (tokens if not often[:p].any() else np.concatenate([tokens[~often], tokens[often]]))[:p]


def _prefix(families: np.ndarray, sets: list[np.ndarray], late: np.ndarray, percent: int) -> pa.RecordBatch:
    """(token, family, n, rest) for the prefix of each set: ``rest`` tokens stand after each one."""
    tokens = [_first_tokens(t, late, percent) for t in sets]
    lengths = np.array([len(t) for t in tokens], np.int64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n = np.repeat(np.array([len(t) for t in sets], np.int64), lengths)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64), pa.int64()), pa.array(np.repeat(families, lengths), pa.int64()),
         pa.array(n.astype(np.int32)), pa.array((n - 1 - place).astype(np.int32))],
        names=["token", "family", "n", "rest"],
    )


def _plain_prefixes(docs: DataFrame, key: str, text: str, size: int, marked: np.ndarray, frequent: np.ndarray, percent: int) -> DataFrame:
    """Prefixes of the sets that are one of a kind, each its own family, straight from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((marked, frequent))

    def work(batches):
        marked, late = shared.value
        for ids, nodes, tokens in _built(batches, size):
            some = [i for i, t in enumerate(tokens) if len(t) and ids[i].is_valid and not marked[nodes[i] & (len(marked) - 1)]]
            yield _prefix(nodes[some], [tokens[i] for i in some], late, percent)

    return _rows(docs, key, text).mapInArrow(work, _ENTRIES)


def _prefixes(sets: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def work(batches):
        for batch in batches:
            yield _prefix(batch.column("family").to_numpy(), _views(batch.column("tokens")), shared.value, percent)

    return sets.select("family", "tokens").mapInArrow(work, _ENTRIES)


def list_pairs(token, family, low, high, rest, percent: int):
    """Pairs of different families in each list. Lists are runs of one token, sorted by ``low``; an entry stops at the first one that is
    too large for it, and skips those whose positions leave too few common tokens."""
    at, step, out = np.arange(len(token) - 1), 1, []
    while len(at):
        to = at + step
        at, to = at[to < len(token)], to[to < len(token)]
        near = (token[to] == token[at]) & (percent * low[to].astype(np.int64) <= 100 * high[at].astype(np.int64))
        at, to = at[near], to[near]
        least = -(-percent * (low[at].astype(np.int64) + low[to]) // (100 + percent))
        need = np.minimum(_common(np.minimum(low[at], low[to]).astype(np.int64)), least)
        # of the first ``need`` common tokens, each leaves room for those still wanted
        good = (family[at] != family[to]) & (need + np.minimum(rest[at], rest[to]) >= least)
        a, b = family[at[good]], family[to[good]]
        out.append((np.minimum(a, b), np.maximum(a, b), need[good]))
        step += 1
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = entries.repartition(parts, "token").sortWithinPartitions("token", "low")

    def work(batches):
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
        for batch in _with_end(batches):
            if batch is not None:
                held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
                end = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            else:
                end = len(held[0])
            a, b, need = list_pairs(*[h[:end] for h in held], percent)
            held = [h[end:] for h in held]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(need, pa.int32())], names=["a", "b", "need"])

    pairs = lists.select("token", "family", "low", "high", "rest").mapInArrow(work, "a bigint, b bigint, need int")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need").select("a", "b")


def _with_end(batches):
    yield from batches
    yield None


def _overlaps(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, inner, together) of each pair of nodes, from their whole sets."""
    left = own.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = own.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))

    def work(batches):
        for batch in batches:
            inner = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(_views(batch.column("ta")), _views(batch.column("tb")), strict=True)]
            total = [len(x) + len(y) for x, y in zip(_views(batch.column("ta")), _views(batch.column("tb")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(inner, pa.int64()), pa.array(np.array(total, np.int64) - np.array(inner, np.int64), pa.int64())],
                names=["a", "b", "inner", "together"],
            )

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a bigint, b bigint, inner bigint, together bigint")


def _met(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    return reps.join(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "node")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``."""
    reach, joined = 1 - percent / 100 + 1e-9, 1 - percent / 100 + 1e-12
    sets = written(shingle_sets(docs, key, text, size).drop("tokens"))
    solid = sets.where("n > 0 and id is not null")
    nodes = written(
        solid.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("minima").alias("minima"))
    )
    families = written(_families(nodes))
    central = families.select(F.col("centre").alias("node")).distinct().withColumn("is_centre", F.lit(True))
    marked = nodes.where("rows > 1").select("node").union(families.select("node")).union(central.select("node")).distinct()
    marked = marked.join(families, "node", "left").join(central, "node", "left").fillna(False, ["is_centre"])
    table = bitmap(marked, "node")
    reps = nodes.select("node", "rep")
    own = written(_one_each(docs, key, text, size, reps.join(marked, "node")))
    some = docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("bigint"), F.lit(1)), F.lit(SAMPLED)) == 0)
    sampled = shingle_sets(some, key, text, size).select(F.explode("tokens").alias("token"))
    frequent = bitmap(sampled.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT), "token")
    found = written(_deltas(own, frequent, percent))
    deltas = found.where("far is not null")
    linked = deltas.where(F.col("far") <= joined).select(F.col("node").alias("u"), F.col("centre").alias("v"))
    inside = _inside(deltas, percent)

    # a node whose bit is set without being marked itself is one of a kind, and joins the marked ones that have no centre
    stray = _one_each(docs, key, text, size, _flagged(reps, table).join(marked, "node", "left_anti"))
    alone = own.where("centre is null").select("node", "tokens").unionByName(stray.select("node", "tokens"))
    members = found.select(F.when(F.col("far").isNull(), F.col("node")).otherwise(F.col("centre")).alias("family"), "n", F.posexplode("first").alias("place", "token"))
    grouped = members.select("token", "family", "n", (F.col("n") - 1 - F.col("place")).alias("rest")).unionByName(
        _prefixes(alone.withColumnRenamed("node", "family"), frequent, percent)
    )
    entries = _plain_prefixes(docs, key, text, size, table, frequent, percent).select(
        "token", "family", F.col("n").alias("low"), F.col("n").alias("high"), "rest"
    ).unionByName(grouped.groupBy("token", "family").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest")))
    pairs = written(_candidates(entries, percent))

    spread = deltas.groupBy("centre").agg(F.max("far").alias("far"))
    centres = written(_overlaps(pairs, _one_each(docs, key, text, size, _met(pairs, reps))))
    across = centres.where(_linked(F.col("inner"), F.col("together"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # linked centres join up what is linked to them; members that are not may still be linked with any of the other family
    doubt = (
        centres.withColumns({"far": 1 - F.col("inner") / F.col("together"), "met": _linked(F.col("inner"), F.col("together"), percent)})
        .join(spread.select(F.col("centre").alias("a"), F.col("far").alias("ra")), "a", "left")
        .join(spread.select(F.col("centre").alias("b"), F.col("far").alias("rb")), "b", "left").fillna(0.0, ["ra", "rb"])
        .where(F.col("far") <= reach + F.col("ra") + F.col("rb")).where(F.greatest("ra", "rb") > F.when(F.col("met"), joined).otherwise(0.0))
    )
    members = deltas.select("centre", "node", "far").unionByName(nodes.select(F.col("node").alias("centre"), "node", F.lit(0.0).alias("far")))
    doubt = (
        doubt.join(members.select(F.col("centre").alias("a"), F.col("node").alias("u"), F.col("far").alias("fu")), "a")
        .where(F.col("fu") >= F.col("far") - reach - F.col("rb")).where(F.col("fu") <= F.col("far") + reach + F.col("rb"))
        .join(members.select(F.col("centre").alias("b"), F.col("node").alias("v"), F.col("far").alias("fv")), "b")
        .where(F.col("fu") + F.col("fv") >= F.col("far") - reach).where(F.abs(F.col("fu") - F.col("fv")) <= F.col("far") + reach)
        .where(F.greatest("fu", "fv") > F.when(F.col("met"), joined).otherwise(-1.0)).where("u != a or v != b")
    )
    doubt = written(doubt.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a != b").distinct())
    rest = _overlaps(doubt, _one_each(docs, key, text, size, _met(doubt, reps))).where(_linked(F.col("inner"), F.col("together"), percent))
    edges = linked.unionByName(inside).unionByName(across).unionByName(rest.select(F.col("a").alias("u"), F.col("b").alias("v")))

    edges = (
        edges.join(reps.select(F.col("node").alias("u"), F.col("rep").alias("ru")), "u")
        .join(reps.select(F.col("node").alias("v"), F.col("rep").alias("rv")), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    )
    # equal sets are linked through their node; rows with one key through that key
    same = solid.select("id", "node").join(reps, "node").where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    roots = components(edges.unionByName(same))
    return sets.select("id", "n").join(roots.select(F.col("v").alias("id"), "root"), "id", "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest key of their component, with the columns they came with. Of rows that repeat a key, the one of
    the smallest text stays. A row without a key is compared as the rest, under a number made from its text that is above all usual keys.
    Rows without a word are no copies of anything: all of them stay."""
    name, again = _free(docs, "_key"), _free(docs, "_again")
    number = F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`").cast("string")), 2) + F.lit(1 << 62)
    named = docs.withColumn(name, F.coalesce(F.col(f"`{key}`").cast("bigint"), number))
    found = jaccard_components(named, name, text, size, percent)
    marks = written(
        found.where("n_shingles > 0").groupBy(name).agg((F.max("component_id") == F.col(name)).alias(again), F.count("*").alias("_rows"))
        .where(f"not {again} or _rows > 1").select(name, again)
    )
    words = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = named.where(words).join(marks, name, "left_anti").unionByName(named.where(~words))
    repeated = marks.where(again)
    if not repeated.isEmpty():
        copies = named.where(words).join(repeated, name, "left_semi")
        everything = F.struct(*[F.col(f"`{c}`") for c in copies.columns])
        order = F.struct(F.col(f"`{text}`").cast("string").alias("t"), F.to_json(everything).alias("j"))
        rest = rest.unionByName(copies.groupBy(name).agg(F.min_by(everything, order).alias("_one")).select("_one.*"))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
