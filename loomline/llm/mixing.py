"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The output is a line of slots, each for one block of documents of one source.  With integer
weights p that sum to q, block k of a source has the window from floor(k * q / p) (its release) to
ceil((k + 1) * q / p) (its deadline).  Earliest deadline first over the released blocks meets every
deadline, as the weights fill one line exactly, so after any number t of slots a source has had more
than t * p / q - 1 and fewer than t * p / q + 1 blocks.  Windows repeat every q slots: the schedule
of one period, folded in a single expression over q slots, serves blocks without end.  The fold's state
is the pool of released blocks, each by its rank among all deadlines of the period, so that a step
takes the pool's minimum and needs no look at the sources; q is bounded by ``scale`` and the sources.

Documents are dealt to their source's blocks in the order of a digest of their id, which shuffles
each source.  Ranks within a source come from counts of (source, digest prefix) groups, so that a
source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut

#: Sources above which the period's table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 2_000
#: Rows that one ranking group should hold on average, and how many times as many may share a digest.
GROUP_ROWS, CROWDED = 200_000, 4
#: Digests shared by many rows that are sent to all tasks at most.
BROADCAST_DIGESTS = 100_000
#: Slots of a period for each source, at least: weights are exact to a sixteenth of a mean share however many sources.
SLOTS = 16
#: Slots whose line is gathered before it is appended to the others.
STEPS = 256


def _shares(counts: DataFrame, scale: int, targets: Mapping[str | None, float] | None, power: float) -> DataFrame:
    """Integer weight p of each source, at least 1 each."""
    if targets is None:
        wish = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        wish = F.lit(0.0)
        for name, weight in targets.items():
            wish = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(wish)
    every = counts.select("source", "n", wish.alias("wish"))
    total = every.agg(F.sum("wish").alias("all_wishes"), F.greatest(F.lit(scale), SLOTS * F.count(F.lit(1))).alias("scale"))
    share = F.when(F.col("all_wishes") > 0, F.floor(F.col("scale") * F.col("wish") / F.col("all_wishes"))).otherwise(0)
    return every.join(F.broadcast(total)).select("source", "n", F.greatest(F.lit(1), share).cast("long").alias("p"))


def _period(shares: DataFrame) -> DataFrame:
    """(source, p, q, j, slot): where in a period of q slots the j-th block of each source goes.

    Each slot takes the released block with the least deadline, ties to the first source.
    """
    total = shares.agg(F.sum("p").alias("q"))
    jobs = shares.join(F.broadcast(total)).select("source", "p", "q", F.explode(F.expr("sequence(0L, p - 1L)")).alias("j"))
    jobs = jobs.select("*", F.expr("(j * q) div p").alias("release"), F.expr("((j + 1) * q + p - 1) div p").alias("deadline"))
    # One task ranks the q blocks of a period.
    ranked = jobs.withColumn("rank", F.row_number().over(Window.orderBy("deadline", F.col("source").asc_nulls_first(), "j")))
    by_release = ranked.groupBy("release", "q").agg(F.collect_list("rank").alias("ranks"))
    table = by_release.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("release", "ranks"))).alias("released"))
    table = table.select("q", F.expr("transform(sequence(0L, q - 1L), t -> coalesce(try_element_at(released, t), cast(array() AS array<int>)))").alias("released"))
    step = f"""
        aggregate(
          sequence(0L, (q - 1L) div {STEPS}),
          struct(cast(array() AS array<int>) AS pool, cast(array() AS array<array<int>>) AS lines),
          (done, c) -> aggregate(
            array(aggregate(
              sequence(c * {STEPS}, least((c + 1L) * {STEPS}, q) - 1L),
              struct(done.pool AS pool, cast(array() AS array<int>) AS line),
              (state, t) -> aggregate(
                array(if(size(released[cast(t AS int)]) = 0, state.pool, concat(state.pool, released[cast(t AS int)]))),
                state,
                (now, pool) -> struct(array_remove(pool, array_min(pool)) AS pool, array_append(now.line, array_min(pool)) AS line)))),
            done,
            (now, part) -> struct(part.pool AS pool, array_append(now.lines, part.line) AS lines)))
    """
    line = table.select(F.posexplode(F.expr(f"flatten(({step}).lines)")).alias("slot", "rank"))
    return line.join(ranked, "rank").select("source", "p", "q", "j", F.col("slot").cast("long").alias("slot"))


def _parts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with ``sub``: 0, or for a digest that many rows of a source share (null or repeated ids) one of several.

    ``groups`` has the row counts of (source, part); only parts that hold far more than their share are looked into.
    """
    crowded = cut(groups.where(F.col("m") > CROWDED * GROUP_ROWS))
    if crowded.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("long"))
    own = crowded.select(F.col("source").alias("c_source"), F.col("part").alias("c_part"))
    inside = rows.join(own, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("part") == F.col("c_part")), "left_semi")
    # Fewer than one for every GROUP_ROWS rows.
    hot = cut(inside.groupBy(F.col("source").alias("c_source"), F.col("digest").alias("c_digest")).agg(F.expr(f"ceil(count(1) / {GROUP_ROWS})").alias("parts")).where("parts > 1"))
    few = F.broadcast if hot.count() <= BROADCAST_DIGESTS else (lambda frame: frame)
    marked = rows.withColumn("number", F.monotonically_increasing_id()).join(few(hot), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("digest") == F.col("c_digest")), "left")
    return marked.withColumn("sub", F.pmod(F.xxhash64("number"), F.coalesce("parts", F.lit(1)))).drop("number", "c_source", "c_digest", "parts")


def mix_sources(
    documents: DataFrame,
    block_rows: int = 8,
    scale: int = 1000,
    targets: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Give every document a place in a line that interleaves the sources to their target weights.

    ``targets`` maps sources to weights; sources it leaves out get the least weight.  Without it a
    source's weight is its number of documents to ``power``.  Weights are rounded down to
    1 / ``scale`` (or 1 / (``SLOTS`` x sources), if that is finer), and to no less than it; ``weight``
    tells what was used.  Columns: ``id_col``, ``source``, ``weight`` (p / q as
    used), ``block`` (of its source, from 0), ``release``, ``deadline``, ``slot``
    (release <= slot < deadline), ``position`` (slot * block_rows + place in the block; the order
    of the mix), and ``mixed``: whether every source still has blocks up to this slot, as far as
    which the weights hold; beyond, the sources that are left keep their proportions to each other.
    ``keep`` names further columns to carry.

    Every row is kept.  A null source is a source of its own; rows with null or repeated ids and
    wholly repeated rows each get a place, and however many share an id they are ranked in groups of
    bounded size; texts are not read; an empty table gives an empty result; other columns than those
    named are not read, and names used inside do not clash with those carried.
    Rows are read more than once, so they must come in a fixed order, as from files.
    """
    q_one = documents.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("source"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )
    counts = cut(documents.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n")))
    size = counts.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    few = F.broadcast if size["sources"] <= BROADCAST_SOURCES else (lambda frame: frame)
    digits = 2
    while size["largest"] > GROUP_ROWS * 16**digits:
        digits += 1
    rows = q_one.withColumn("part", F.substring("digest", 1, digits))
    rows = _parts(rows, rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("m")))
    groups = rows.groupBy("source", "part", "sub").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("source").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), F.col("sub").alias("o_sub"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    shares = _shares(counts, scale, targets, power)
    # Both are used more than once.
    period = cut(_period(shares))
    blocks = F.expr(f"(n + {block_rows - 1}) div {block_rows}")
    # The first slot at which some source has no block left; a single row.
    horizon = (
        shares.select("source", "p", blocks.alias("b"))
        .join(period.select(F.col("source").alias("h_source"), "j", "slot", "q"), F.col("source").eqNullSafe(F.col("h_source")) & (F.expr("b % p") == F.col("j")))
        .agg(F.min(F.expr("(b div p) * q + slot")).alias("horizon"))
    )
    within = Window.partitionBy("source", "part", "sub").orderBy("digest", "__id", *[f"__k{i}" for i in range(len(keep))])
    ranked = (
        rows.withColumn("r", F.row_number().over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("part") == F.col("o_part")) & (F.col("sub") == F.col("o_sub")))
        .select("*", (F.col("offset") + F.col("r") - 1).alias("rank"))
        .select("*", F.expr(f"rank div {block_rows}").alias("k"), F.expr(f"rank % {block_rows}").alias("row"))
    )
    weights = period.groupBy("source").agg(F.first("p").alias("p"), F.first("q").alias("q"), F.sort_array(F.collect_list(F.struct("j", "slot"))).alias("slots"))
    weights = weights.select(F.col("source").alias("w_source"), "p", "q", F.expr("transform(slots, x -> x.slot)").alias("slots"))
    # Whole numbers, computed without rounding.
    release, deadline = F.expr("(k * q) div p"), F.expr("((k + 1) * q + p - 1) div p")
    slot = F.expr("(k div p) * q + slots[cast(k % p AS int)]")
    placed = ranked.join(few(weights.join(F.broadcast(horizon))), F.col("source").eqNullSafe(F.col("w_source")))
    return placed.select(
        F.col("__id").alias(id_col), "source", (F.col("p") / F.col("q")).alias("weight"), F.col("k").alias("block"), release.alias("release"), deadline.alias("deadline"),
        slot.alias("slot"), (slot * block_rows + F.col("row")).alias("position"), (slot < F.col("horizon")).alias("mixed"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)],
    )
