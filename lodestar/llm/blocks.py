"""Groups of any size as pairs of bounded blocks: no task ever holds a whole group, and no pair becomes a row by itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.frames import parts


def block_pairs(members: DataFrame, group: str, by: str, block: int) -> DataFrame:
    """Each member once for every pair of blocks (i <= j) of its group that its own block `own` is in, pairs together and sorted.

    A group of n members has ceil(n / block) blocks, dealt by a hash of `by`; groups of one member have no pairs and go.
    A group's pairs of blocks are numbered and go to tasks in turn, so those of one large group never meet in a task before
    every task has one.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n")).where("n > 1").select(group, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    each = dealt.select("*", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    first = [group, "i", "j", "own"]
    n = max(parts(each), 2)
    # the number of (i, j) among the pairs of a group of any size, in order of j and then i
    number = F.col("j").cast("long") * (F.col("j") + 1) / 2 + F.col("i")
    task = F.pmod(F.xxhash64(group) % n + number.cast("long"), F.lit(n)).cast("int")
    return each.select(*first, *[c for c in each.columns if c not in first]).repartitionById(n, task).sortWithinPartitions(group, "i", "j")


def runs(batches, keys: int):
    """Tables of the rows that agree on the first `keys` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*columns, strict=True))
        start = 0
        for r in range(n + 1):
            if r == n or rows[r] != key:
                if r > start:
                    held.append(batch.slice(start, r - start))
                if r < n:
                    if held:
                        yield pa.Table.from_batches(held)
                    held, key, start = [], rows[r], r
    if held:
        yield pa.Table.from_batches(held)
