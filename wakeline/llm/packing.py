"""Documents of varying length packed into containers of fixed capacity.

Sizes are tokens of a public tokenizer. A document larger than the capacity fills whole
containers and leaves a remainder; nothing else is split.

The packing is planned on the histogram of sizes, which has at most as many entries as
the capacity whatever the number of documents: items above one third of the capacity
meet at most two to a container, each paired with the largest partner that fits (large
items first); smaller items, largest first, go where they leave the least space. Equal
containers are planned together, so a plan is short. The documents then take the places
of their size by rank; ranks are counted per size and salt, so that a size which a third
of all documents share is no single task.

Defined results: null and empty texts have no tokens and go to container 0 with size 0;
every other piece appears exactly once; containers are numbered from 0 without gaps;
equal sizes are served in order of document id; repeated ids are told apart by nothing
and both placed; an empty table gives an empty result; capacities that are null or below
one are left out.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.workspace import scratch

#: Where the vocabulary files of the public tokenizers are looked for.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary cuts a text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Least number of salts, and documents per salt beyond it.
SALTS, PER_SALT = 64, 200_000


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every document; written once, since tokenizing is the dear part.

    The vocabulary is read on the driver and goes along with the function (under 1 MB)."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or _encoder(vocabulary).encode_ordinary
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    path = scratch(documents.sparkSession, "tokens")
    documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).where("doc_id is not null").mapInArrow(count, "doc_id long, tokens long").write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Kinds of containers as (how many, items by size) that hold exactly ``sizes``."""
    left = {s: n for s, n in sizes.items() if n > 0 and 0 < s <= capacity}
    bins: list[tuple[int, int, dict[int, int]]] = []  # (count, free space, items)
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            bins.append((left[a], capacity - a, {a: 1}))
            n = left[a]
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b and n == 0:
                bins.append((1, capacity - a, {a: 1}))
                n = 1
            else:
                bins.append((n, capacity - a - b, {a: 2} if a == b else {a: 1, b: 1}))
                left[b] -= n
                if a != b and not left[b]:
                    large.pop(at)
        left[a] -= n
        if not left[a]:
            large.pop()
    free: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for n, space, items in bins:
        free[space].append((n, items))
    spaces = sorted(free)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        todo = left[s]
        while todo:
            at = bisect.bisect_left(spaces, s)
            if at == len(spaces):  # no gap left: new containers, filled with this size
                per = min(capacity // s, todo)
                n = todo // per
                held = [(n, {s: per}, capacity - per * s)]
                todo -= n * per
                if todo:
                    held.append((1, {s: todo}, capacity - todo * s))
                todo = 0
            else:
                space = spaces[at]
                n, items = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
                per = min(space // s, todo)
                full = min(n, todo // per)
                held = [(full, {**items, s: items.get(s, 0) + per}, space - per * s)]
                if n > full:
                    held.append((n - full, items, space))
                todo -= full * per
            for count, items, space in held:
                if count:
                    if space not in free:
                        bisect.insort(spaces, space)
                    free[space].append((count, items))
    return [(n, items) for space in sorted(free) for n, items in free[space]]


def _places(kinds: list[tuple[int, dict[int, int]]], first: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, container of that rank and items per container, of each kind."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    seen: dict[int, int] = defaultdict(int)
    for n, items in kinds:
        for s, per in items.items():
            out[s].append((seen[s], first, per))
            seen[s] += n * per
        first += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


def pack(counts: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens): every piece in its container."""
    spark = counts.sparkSession
    kinds = [(r[0], int(r[1])) for r in containers.where("capacity_tokens >= 1").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind").collect()]
    schema = "container_kind string, container_id long, doc_id long, piece long, tokens long"
    if not kinds:
        return spark.createDataFrame([], schema)
    options = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds])
    each = counts.withColumn("k", F.explode(options)).select("doc_id", "tokens", "k.container_kind", "k.capacity")
    each = each.withColumns({"whole": F.expr("tokens div capacity"), "rest": F.expr("tokens % capacity")})
    # whole containers are numbered like a size of their own, by their first
    salts = max(SALTS, counts.count() // PER_SALT)
    spread = each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    tally = spread.groupBy("container_kind", "rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("w"))
    before = Window.partitionBy("container_kind", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumns({"rank0": F.coalesce(F.sum("n").over(before), F.lit(0)), "whole_in_rest": F.coalesce(F.sum("w").over(before), F.lit(0))})
    path = scratch(spark, "tally")
    tally.write.parquet(path)
    tally = spark.read.parquet(path)
    sizes: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    wholes: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    for k, rest, n, w in tally.groupBy("container_kind", "rest").agg(F.sum("n"), F.sum("w")).collect():  # at most the capacity by kind
        sizes[k][rest], wholes[k][rest] = n, w
    places, start = {}, {}
    for k, capacity in kinds:
        at = 0
        start[k] = {}
        for rest in sorted(wholes[k]):
            start[k][rest] = at
            at += wholes[k][rest]
        places[k] = _places(plan(sizes[k], capacity), at)
    caps_by = dict(kinds)
    # stable ranks within (kind, size, salt); at most about PER_SALT rows in one window
    w = Window.partitionBy("container_kind", "rest", "salt").orderBy("doc_id", "tokens")
    # a merge join: the window below wants the same order, and the tally need not be broadcast
    ranked = spread.join(tally.hint("merge"), ["container_kind", "rest", "salt"]).select(
        "container_kind", "doc_id", "tokens", "rest", "whole",
        (F.col("rank0") + F.row_number().over(w) - 1).alias("rank"),
        (F.col("whole_in_rest") + F.sum("whole").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).alias("before"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() if n == "container_kind" else batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names)}
            kind = np.array(c["container_kind"], object)
            out: list[tuple[np.ndarray, ...]] = []
            for k in set(c["container_kind"]):
                of = kind == k
                doc, rest, rank, whole, before = (c[n][of] for n in ("doc_id", "rest", "rank", "whole", "before"))
                box = np.zeros(len(doc), np.int64)
                for s in np.unique(rest[rest > 0]):
                    first, container, per = places[k][int(s)]
                    mine = rest == s
                    i = np.searchsorted(first, rank[mine], side="right") - 1
                    box[mine] = container[i] + (rank[mine] - first[i]) // per[i]
                some = (rest > 0) | (whole == 0)
                out.append((np.full(some.sum(), k, object), box[some], doc[some], whole[some], rest[some]))
                full = np.repeat(np.arange(len(doc)), whole)
                nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
                base = np.array([start[k][int(s)] for s in rest], np.int64) + before
                out.append((np.full(len(full), k, object), base[full] + nth, doc[full], nth, np.full(len(full), caps_by[k], np.int64)))
            cols = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(x.astype(np.int64)) for x in cols[1:]]], names=["container_kind", "container_id", "doc_id", "piece", "tokens"])

    return ranked.mapInArrow(place, schema)


def unused(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, unused_share): how well the packing fills."""
    per = packed.groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    share = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return per.join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind").select("container_kind", "containers", "tokens", F.round(share, 6).alias("unused_share"))
