"""Tracks cut into blocks of time with a halo, so that no mover has to fit in one task.

A mover with a third of all rows is spread over its blocks; each block also receives
the fixes within ``halo_s`` of it, enough for every rule that looks at neighbours no
further away. Within a task blocks arrive sorted and are handed to numpy many at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handed to the function at once, cut at a block's border.
UNIT = 200_000


def in_blocks(fixes: DataFrame, *, block_s: int, halo_s: int) -> DataFrame:
    """Distinct fixes with ``mmsi`` and ``us`` in (mmsi, block) partitions, sorted by time.

    Copies collapse before the shuffle. Adds block and ``core``, false in the halo."""
    size, halo = block_s * 1_000_000, halo_s * 1_000_000
    seen = fixes.distinct()
    blocks = F.sequence(F.expr(f"(us - {halo}) div {size}"), F.expr(f"(us + {halo}) div {size}"))
    return (
        seen.withColumn("block", F.explode(blocks))
        .withColumn("core", F.expr(f"us div {size}") == F.col("block"))
        .repartition("mmsi", "block")
        .sortWithinPartitions("mmsi", "block", "us")
    )


def _numpy(table: pa.Table) -> dict[str, np.ndarray]:
    """Columns as numpy arrays; missing numbers become NaN."""
    out = {}
    for name in table.column_names:
        column = table.column(name)
        if column.null_count or pa.types.is_floating(column.type):
            column = column.cast(pa.float64())
        out[name] = column.to_numpy()
    return out


def map_blocks(blocks: DataFrame, fn: Callable[[dict[str, np.ndarray], np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn(columns, group)`` to sorted units of whole blocks; ``group`` numbers the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = _numpy(table)
            new = (np.diff(cols["mmsi"], prepend=cols["mmsi"][:1]) != 0) | (np.diff(cols["block"], prepend=cols["block"][:1]) != 0)
            yield from fn(cols, np.cumsum(new)).to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= UNIT:
                table = pa.Table.from_batches(held)
                m, b = table.column("mmsi").to_numpy(), table.column("block").to_numpy()
                last = _tail_start(m, b)
                if last:
                    yield from done(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), table.num_rows - last
        if rows:
            yield from done(pa.Table.from_batches(held))

    return blocks.mapInArrow(run, schema)


def _tail_start(m: np.ndarray, b: np.ndarray) -> int:
    """Where the last block, which may go on in the next batch, begins."""
    other = np.flatnonzero((m != m[-1]) | (b != b[-1]))
    return int(other[-1]) + 1 if len(other) else 0
