"""Search of patterns in texts too long for one task: a text's blocks are rows of their own, spread over all tasks.

A best match spans at most twice the pattern's letters, as all of its letters left out cost no more than their number. So
a block that is read from so many letters before it has the costs of the whole text, and blocks need nothing of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import kernels
from seqloom.functions.align import SOME, flat

#: Letters of a block.
BLOCK = 1 << 14


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (id, pattern, text) as (id, block, pattern, part, skip, inside, last): a text's letters, with those before that a
    match may span; skip: how many; inside: whether the text goes on before them; last: whether it ends with them. Texts
    are cut as bytes, which takes no search for a place."""
    if block < 1:
        raise ValueError("a block has a letter at least")
    text, m = F.col("text").cast("binary"), F.length("pattern")
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / block)).cast("int")
    at = rows.where(F.col("pattern").isNotNull() & F.col("text").isNotNull()).select("id", "pattern", text.alias("text"), F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * block - 2 * m)
    skip = F.col("block") * block - first
    return at.select("id", "block", "pattern", F.substr("text", first + 1, skip + block).cast("string").alias("part"), skip.alias("skip"), (first > 0).alias("inside"), ((F.col("block") + 1) * block >= F.length("text")).alias("last"))


def search_blocks(rows: DataFrame, unmatched: float = 0.0, block: int = BLOCK) -> DataFrame:
    """rows (id, pattern, text) as (id, block, first, costs ARRAY<INT>): costs of the pattern's best match at each place of
    text from `first` on, as functions.align.search() gives them for a whole text: the last block of a text has those of
    matches over its right end too. Null patterns and texts have no rows; ids may repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                yield costs(batch.slice(at, SOME))

    def costs(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, skip = (batch.column(c).to_numpy().astype(np.int64) for c in (1, 4))
        inside, last = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (5, 6))
        part, size = flat(batch.column(3))
        found, count = kernels.search_costs(*flat(batch.column(2)), part, size, unmatched, inside)
        # Place `skip` is the block before's last; a text's very first place is the first block's.
        begin, end = skip + ((skip > 0) | inside), np.where(last, count, size + 1)
        place = np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count)
        own = found[(place >= np.repeat(begin, count)) & (place < np.repeat(end, count))]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.maximum(0, end - begin))], pa.int32()), pa.array(own, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number * block + (number > 0), pa.int64()), lists], names=["id", "block", "first", "costs"])

    own = blocks(rows, block)
    dealt = own.repartition("id", "block")  # a text's blocks come from one row
    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"id {kind}, block int, first bigint, costs array<int>")
