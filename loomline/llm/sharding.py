"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits, the cell's place on the Hilbert curve orders the rows, and
the order is cut into runs of equal row counts.  A run covers few values of every dimension, so
minimum and maximum statistics of files written by run prune on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, partitions, sent

#: Rows that one ranking group should hold on average.
GROUP_ROWS = 200_000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of ``axes`` (dimensions x points, ``bits`` bits each).

    Gray-code construction from the highest bit down: at each level the point is mapped into the
    orientation of its sub-cube by exchanging and reflecting the lower bits of the axes.
    """
    x = axes.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for d in range(n):
            reflect = (x[d] & top) != 0
            swapped = np.where(reflect, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(reflect, x[0] ^ low, x[0] ^ swapped)
            if d:
                x[d] ^= swapped
    for d in range(1, n):
        x[d] ^= x[d - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity = np.where(x[n - 1] & (1 << level), parity ^ ((1 << level) - 1), parity)
    x ^= parity
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            index = index << 1 | (x[d] >> level & 1)
    return index


def _curve(dimensions: Sequence[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.vstack([c.to_numpy(np.int64) for c in columns]), bits))

    return place(*dimensions)


def _shares_before(counts: DataFrame) -> DataFrame:
    """(value, share): the share of all rows that come before a value, null first.

    Values are dealt out by ranges; only the ranges' sums, one for each partition, come together.
    """
    order = F.col("value").asc_nulls_first()
    ranged = cut(counts.repartitionByRange(partitions(counts.sparkSession), order).select("value", "n", F.spark_partition_id().alias("range")))
    before = (Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("n").alias("m"))
    sums = sums.select("range", F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(*before)), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy()).alias("all"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(order).rowsBetween(*before)), F.lit(0))
    return ranged.withColumn("own", own).join(F.broadcast(sums), "range").select("value", ((F.col("start") + F.col("own")) / F.col("all")).alias("share"))


def _gathered(placed: DataFrame) -> DataFrame:
    """The rows with all copies of a text in one cell, the first on the curve that any of them has."""
    cells = placed.groupBy(F.col("text_crc32").alias("__tc"), F.col("size").alias("__ts")).agg(F.min("hilbert").alias("__first"), F.max("hilbert").alias("__last"))
    moved = sent(cut(cells.where("__first < __last").drop("__last")))
    joined = placed.join(moved, (F.col("text_crc32") == F.col("__tc")) & (F.col("size") == F.col("__ts")), "left")
    return joined.withColumn("hilbert", F.coalesce("__first", "hilbert")).drop("__tc", "__ts", "__first")


def shard_documents(
    documents: DataFrame,
    shards: int = 8,
    bits: int = 4,
    dimensions: Sequence[str] = ("source", "lang"),
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Cut the rows, in Hilbert order, into ``shards`` runs whose counts differ by one at most.

    The dimensions are the text's size (its octave) and the columns named in ``dimensions``, each
    quantised to ``bits`` bits: a column's values are numbered in their order by cumulative row
    share, null first.  Equal texts (of one checksum and size), whatever their columns, take the first
    of their cells, and within a cell rows go by checksum, so that equal texts lie together; of all
    groups of equal texts at most ``shards`` - 1 are divided, one by each cut.  Returns ``id_col``, ``size`` (UTF-8 bytes + 1), ``text_crc32``,
    ``law`` ('rows'), ``shard``, ``slot`` (place in the shard, from 0), ``grown_shard`` (null: only
    the law 'key' has it), ``hilbert`` and the columns ``keep``.

    Every row gets a place: null and empty texts have size 1 and checksum 0; null ids, repeated ids
    and repeated rows are each placed, and ties of the order are broken by id, then as the rows come;
    an empty table gives an empty result; columns of any name can be carried.  Texts are read once for
    size and checksum and never shuffled, unless ``keep`` names them.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = documents.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        *[F.col(d).alias(f"__d{i}") for i, d in enumerate(dimensions)], *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
    )
    cells = 1 << bits
    values = [F.least(F.lit(cells - 1), F.floor(F.log2(F.col("size").cast("double"))) * cells / 32).cast("int")]
    for i in range(len(dimensions)):
        # The share of rows before a value, so that frequent values are told apart best.
        ranks = _shares_before(base.groupBy(F.col(f"__d{i}").alias("value")).agg(F.count(F.lit(1)).alias("n")))
        ranks = ranks.select(F.col("value").alias(f"__v{i}"), F.floor(F.col("share") * cells).cast("int").alias(f"__q{i}"))
        base = base.join(ranks, F.col(f"__d{i}").eqNullSafe(F.col(f"__v{i}"))).drop(f"__v{i}")
        values.append(F.col(f"__q{i}"))
    placed = cut(base.select("*", _curve(values, bits).alias("hilbert"), F.monotonically_increasing_id().alias("__row")))
    placed = _gathered(placed)
    total = placed.count()
    # Groups for ranking: the cell, a part of the checksum, and for a checksum of many copies itself and a part of the id.
    fine = max(1, -(-total // GROUP_ROWS))
    grouped = placed.select("*", (F.col("text_crc32") % (64 * fine)).alias("__a"))
    if fine > 1:
        copies = placed.groupBy(F.col("hilbert").alias("__ch"), F.col("text_crc32").alias("__cc")).agg(F.expr(f"ceil(count(1) / {GROUP_ROWS})").alias("__parts"))
        # Fewer than one for every GROUP_ROWS rows.
        copies = sent(cut(copies.where("__parts > 1")))
        grouped = grouped.join(copies, (F.col("hilbert") == F.col("__ch")) & (F.col("text_crc32") == F.col("__cc")), "left")
        grouped = grouped.withColumn("__c", F.coalesce("__cc", F.lit(-1))).withColumn("__b", F.pmod(F.xxhash64("__row"), F.coalesce("__parts", F.lit(1)))).drop("__ch", "__cc", "__parts")
    else:
        grouped = grouped.withColumn("__c", F.lit(-1).cast("long")).withColumn("__b", F.lit(0).cast("long"))
    keys = ["hilbert", "__a", "__c", "__b"]
    groups = grouped.groupBy(keys).agg(F.count(F.lit(1)).alias("__m"))
    per_cell = groups.groupBy("hilbert").agg(F.sum("__m").alias("__m"))
    before = (Window.unboundedPreceding, -1)
    cell_offsets = per_cell.select(F.col("hilbert").alias("__h"), F.coalesce(F.sum("__m").over(Window.orderBy("hilbert").rowsBetween(*before)), F.lit(0)).alias("__cell"))
    in_cell = F.coalesce(F.sum("__m").over(Window.partitionBy("hilbert").orderBy("__a", "__c", "__b").rowsBetween(*before)), F.lit(0)).alias("__group")
    offsets = groups.select(*keys, in_cell).join(F.broadcast(cell_offsets), F.col("hilbert") == F.col("__h")).select(*keys, (F.col("__cell") + F.col("__group")).alias("__offset"))
    within = Window.partitionBy(*keys).orderBy("text_crc32", "size", "__id", "__row")
    ranked = grouped.select("*", F.row_number().over(within).alias("__r")).join(offsets, keys).select("*", (F.col("__offset") + F.col("__r") - 1).alias("__rank"))
    shard = F.expr(f"(__rank * {shards}) div {max(total, 1)}")
    # The first rank r with r * shards div total = shard.
    first = F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")
    return ranked.select("*", shard.alias("__shard")).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"), (F.col("__rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write a result of ``shard_documents`` as Parquet, a folder a shard, rows in slot order.

    Rows are dealt out by ranges of shard and slot, so that a shard of any size is written by many tasks
    and each file holds a run of the curve; an empty table writes no folder; repeated rows, nulls and
    long texts are written as they are.
    """
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
