"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label form a node.  A neighbour graph starts from random-projection cells and is
refined by neighbours-of-neighbours joins: the nodes that list one node meet each other and that node,
until hardly any new link is found.  Lists hold neighbours up to twice the threshold's angle, as only
those can be a common neighbour of two linked nodes' links.  A list that is filled by links is
enlarged, up to ``LONGEST``; a node with more links than that is *full* and leaves the search.

Full nodes are compared exactly instead: blocks of them are enclosed in balls, every node of the label
that a ball's angle lets come near is compared with the whole block, and links are counted, not
listed.  An audit compares a sample of the other nodes with all rows.  Below the asked recall the
search goes on with twice as many cells, and in the end all nodes are treated as full ones.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut, discard, partitions, runs, sent
from loomline.llm.components import connected_components
from loomline.llm.topk import usable

#: Entries of a list, and of one that links fill.
LIST, LONGEST = 10, 40
#: Nodes compared in a cell, those of its neighbour on the curve that it sees again, and members that meet at a node.
CELL, AGAIN, MEET = 2048, 512, 512
#: Probability that no draw of cells has a pair at the threshold together, and the most draws of one search.
MISS, DRAWS = 1e-4, 64
#: Rounds of refinement at most; one that adds less than this share of all links is the last.
ROUNDS, SETTLED = 6, 0.002
#: Full nodes of a block, blocks that a map gets at a time, and nodes of a label for each part of a block's partners.
BLOCK, BALLS, PARTNERS = 4096, 4096, 65_536
#: Audited nodes, the recall of their links that is asked for, and searches until all is compared exactly.
AUDITED, RECALL, SEARCHES = 2000, 0.99, 3
#: Half-precision products differ from exact ones by less than this; what rounding can explain in an angle or a product.
MARGIN, ROUNDING = 0.004, 1e-9

log = logging.getLogger(__name__)

LISTS = "u long, half binary, full boolean, vs array<long>, sims array<float>, fresh array<boolean>"


def _unit(columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision from lists of one length."""
    x = np.array(columns.to_pylist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stacked(column, kind: type) -> np.ndarray:
    data = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """A batch from columns of Python values, with names and types as in a Spark schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _key():
    """The digest of a vector and its space."""
    return F.unhex(F.md5(F.concat_ws(",", F.col("space"), F.transform("v", lambda x: x.cast("string"))).cast("binary")))


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, space, v, ok): ``space`` is label and length, only vectors of one space are compared; ok: any are."""
    some = F.coalesce(F.exists(F.col(vector_col), lambda x: x != 0), F.lit(False))
    ok = usable(vector_col) & some & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.concat_ws("/", F.col(label_col).cast("string"), F.size(vector_col).cast("string")).alias("space"), v.alias("v"), ok.alias("ok"))


def _nodes(rows: DataFrame) -> DataFrame:
    """(key, space, rep, copies, unit, half, node): a row and a number for each distinct vector of a label."""
    named = rows.where("ok").groupBy("space", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select(_key().alias("key"), "space", "rep", "copies", "v")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit: list[bytes] = [b""] * batch.num_rows
            half = unit.copy()
            sizes = np.array([len(x) for x in batch.column(4).to_pylist()])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _unit(batch.column(4).take(pa.array(at)))
                for i, row in zip(at, x):
                    unit[i], half[i] = row.tobytes(), row.astype(np.float16).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(unit, pa.binary()), pa.array(half, pa.binary())], names=["key", "space", "rep", "copies", "unit", "half"])

    packed = named.mapInArrow(make, "key binary, space string, rep long, copies long, unit binary, half binary")
    # Once written, numbers stay.
    return packed.withColumn("node", F.monotonically_increasing_id())


def _planes(seed: int, bits: int, size: int) -> np.ndarray:
    """Normals of pseudo-random hyperplanes, the same on every machine, and a direction to order by."""
    seed = int.from_bytes(hashlib.blake2b(b"%d %d" % (seed, size), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).standard_normal((size, bits + 1))


def _entries(sims: np.ndarray, ids: np.ndarray, near: float, floor: float) -> tuple[list[int], list[float], bool] | None:
    """(ids, similarities, full) of one node's list, from all it was compared with; ties go to the smaller id."""
    at = np.flatnonzero(sims >= floor)
    if not len(at):
        return None
    links = int((sims[at] >= near).sum())
    keep = LIST if links > LONGEST else max(LIST, links)
    if len(at) > keep:
        at = at[np.lexsort((ids[at], -sims[at]))[:keep]]
    return ids[at].tolist(), sims[at].tolist(), links > LONGEST


def _draws(bits: int, angle: float) -> int:
    """Draws of cells by ``bits`` hyperplanes after which a pair at the angle has been apart in all with probability ``MISS``."""
    together = (1 - angle / math.pi) ** bits
    return min(DRAWS, math.ceil(math.log(MISS) / math.log1p(-together))) if bits else 1


def _large(nodes: DataFrame) -> DataFrame:
    """(space, bits, parts) of the spaces that are divided: hyperplanes that make cells of ``CELL`` nodes, parts of ``PARTNERS``."""
    sizes = nodes.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(CELL, PARTNERS))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL))).cast("int")
    return cut(sizes.select("space", bits.alias("bits"), F.ceil(F.col("n") / PARTNERS).cast("int").alias("parts")))


def _first_lists(nodes: DataFrame, large: DataFrame, first: int, times: list[int], near: float, floor: float) -> DataFrame:
    """Lists from the cells of several draws: nodes on the same sides of random hyperplanes, in the order of a projection.

    ``times`` has the draws of a space by its bits.  Rows are dealt out by ranges of (draw, space, cell, projection), so
    a cell of any size is spread; each run of ``CELL`` nodes is compared with itself and the last ``AGAIN`` nodes before
    it.  A space without bits has no projection: its nodes, ``CELL`` at most, lie in one task and are all compared.
    """
    most = len(times) - 1

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves, bits = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            sizes, wanted = np.array([len(h) for h in halves]), np.array(times)[bits]
            for size in np.unique(sizes):
                for draw in range(max(times)):
                    at = np.flatnonzero((sizes == size) & (wanted > draw))
                    if not len(at):
                        break
                    x, own = _stacked([halves[i] for i in at], np.float16).astype(np.float64), bits[at]
                    found = x @ _planes(first + draw, most, x.shape[1])
                    code = (found[:, :most] > 0) @ (1 << np.arange(most)) & (1 << own.astype(np.int64)) - 1
                    along = np.where(own > 0, found[:, most], 0.0)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns[:3], pa.array(np.full(len(at), draw), pa.int32()), pa.array(code, pa.int64()), pa.array(along)], names=["node", "space", "half", "draw", "code", "along"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ids, x = None, np.empty(0, np.int64), np.empty((0, 0), np.float32)
        for cell, rows in runs(batches, ["draw", "space", "code"], CELL):
            halves = rows.column("half").to_pylist()
            own, y = rows.column("node").to_numpy(), _stacked(halves, np.float16).astype(np.float32)
            if cell != before:
                ids, x = own[:0], y[:0]
            every, z = np.concatenate([ids, own]), np.concatenate([x, y])
            sims = z @ z.T
            np.fill_diagonal(sims, -2)
            out: list[tuple] = []
            for i in np.flatnonzero(sims.max(1, initial=-2) >= floor).tolist():
                vs, s, full = _entries(sims[i], every, near, floor)
                out.append((int(every[i]), z[i].astype(np.float16).tobytes(), full, vs, s, [True] * len(vs)))
            if out:
                yield _batch(LISTS, [*zip(*out)])
            before, ids, x = cell, own[-AGAIN:], y[-AGAIN:]

    order = ["draw", "space", "code", "along"]
    sized = nodes.select("node", "space", "half").join(sent(large.select("space", "bits")), "space", "left").select("node", "space", "half", F.coalesce("bits", F.lit(0)).alias("bits"))
    dealt = sized.mapInArrow(sides, "node long, space string, half binary, draw int, code long, along double").repartitionByRange(partitions(nodes.sparkSession), *order)
    return dealt.sortWithinPartitions(*order).mapInArrow(nearest, LISTS)


def _merged(parts: DataFrame, near: float) -> DataFrame:
    """One list for each node from several; an entry is fresh unless some list had it already."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, "u"):
            out: list[tuple] = []
            rows = [*zip(*(batch.column(c).to_pylist() for c in ("u", "half", "full", "vs", "sims", "fresh")))]
            start = 0
            for stop in range(1, len(rows) + 1):
                if stop < len(rows) and rows[stop][0] == rows[start][0]:
                    continue
                found: dict[int, tuple[float, bool]] = {}
                for _, _, _, vs, sims, fresh in rows[start:stop]:
                    for v, s, f in zip(vs, sims, fresh):
                        found[v] = (s, f and found.get(v, (0, True))[1])
                half = next((r[1] for r in rows[start:stop] if r[1] is not None), None)
                links = sum(s >= near for s, _ in found.values())
                full = links > LONGEST or any(r[2] for r in rows[start:stop])
                best = sorted(found.items(), key=lambda e: (-e[1][0], e[0]))[: LIST if full else max(LIST, links)]
                if half is not None:  # a node that has no list of its own yet is none that another list can lack
                    out.append((rows[start][0], half, full, [v for v, _ in best], [s for _, (s, _) in best], [f for _, (_, f) in best]))
                start = stop
            if out:
                yield _batch(LISTS, [*zip(*out)])

    return parts.repartition("u").sortWithinPartitions("u").mapInArrow(merge, LISTS)


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The same sorted rows in tables that never part rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(key)[batch.num_rows - 1].as_py()
        at = int(np.searchsorted(batch.column(key).to_numpy(), last))
        if at or (held and held[-1].column(key)[0].as_py() != last):
            held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


MESSAGES = "centre long, member long, half binary, worst float, fresh boolean"


def _refined(lists: DataFrame, near: float, floor: float) -> DataFrame:
    """One round: the nodes that list a node meet each other and it, where one is new there, and better ones enter lists."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for u, half, vs, sims, fresh in zip(*(batch.column(c).to_pylist() for c in ("u", "half", "vs", "sims", "fresh"))):
                # What a candidate must reach: any link while links fill the list, else more than the last entry.
                worst = floor if len(vs) < LIST else min(near, sims[-1])
                out.append((u, u, half, worst, False))
                out += [(v, u, half, worst, f) for v, f in zip(vs, fresh)]
            if out:
                yield _batch(MESSAGES, [*zip(*out)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ["centre"], MEET):
            fresh = np.array(rows.column("fresh").to_pylist(), bool)
            if len(fresh) < 2 or not fresh.any():
                continue
            who, x = rows.column("member").to_numpy(), _stacked(rows.column("half"), np.float16).astype(np.float32)
            sims = x @ x.T
            better = (fresh[:, None] | fresh) & (sims >= rows.column("worst").to_numpy()[:, None]) & (who[:, None] != who)
            out = []
            for i in np.flatnonzero(better.any(1)).tolist():
                at = np.flatnonzero(better[i])
                out.append((int(who[i]), None, False, who[at].tolist(), sims[i, at].tolist(), [True] * len(at)))
            if out:
                yield _batch(LISTS, [*zip(*out)])

    met = lists.where(~F.col("full")).mapInArrow(send, MESSAGES).repartition("centre").sortWithinPartitions("centre")
    return _merged(lists.withColumn("fresh", F.transform("fresh", lambda f: F.lit(False))).unionByName(met.mapInArrow(meet, LISTS)), near)


def _search(nodes: DataFrame, large: DataFrame, lists: DataFrame | None, begun: int, times: list[int], near: float, floor: float) -> DataFrame:
    """The neighbour lists after more draws of cells and rounds of refinement, ``u`` to ``fresh`` as in ``LISTS``."""
    first = _first_lists(nodes, large, begun, times, near, floor)
    now = cut(_merged(first if lists is None else lists.unionByName(first), near))
    for _ in range(ROUNDS):
        before, now = now, cut(_refined(now, near, floor))
        discard(before)
        link = F.explode(F.arrays_zip("sims", "fresh")).alias("e")
        count = now.where(~F.col("full")).select(link).where(F.col("e.sims") >= near).agg(F.count(F.lit(1)).alias("links"), F.count(F.when(F.col("e.fresh"), 1)).alias("fresh")).first()
        if count["fresh"] <= SETTLED * count["links"]:
            break
    return now


def _exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs u < v whose cosine, in double precision, reaches the threshold."""
    left, right = (nodes.select(F.col("node").alias(side), F.col("unit").alias(f"{side}_unit")) for side in ("u", "v"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("u_unit").to_pylist(), batch.column("v_unit").to_pylist()
            keep = np.zeros(len(a), bool)
            sizes = np.array([len(x) for x in a])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keep[at] = np.einsum("ij,ij->i", *(_stacked([side[i] for i in at], np.float64) for side in (a, b))) >= threshold
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    some = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return some.join(right, "v").join(left, "u").mapInArrow(make, "u long, v long")


COMPARED = "node long, n long, u long, v long, both boolean"


def _compared(nodes: DataFrame, large: DataFrame, full: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Full nodes against all nodes that can be linked with them.

    Rows either count (node, n): the copies of other nodes that a full node is linked with; or are links
    (u, v): of a full node with one that is not, each; of two full nodes, one for every two components of
    a block's part, which ``both`` marks.

    A block holds full nodes of one component, at most ``BLOCK`` of them.  Its ball is a mean direction and
    the widest angle to it; a node farther from the mean than that and the threshold's angle together
    is linked with none of them.  Balls are sent out ``BALLS`` at a time.
    """
    members = full.select(F.col("u").alias("node")).distinct().join(nodes.select("node", "space", "copies", "unit"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = members.groupBy("space", "root").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) AS int)").alias("parts"))
    dealt = members.join(sizes, ["space", "root"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = cut(dealt.select("node", "copies", "unit", "root", "space", "slice"))
    reach = math.acos(min(threshold, 1.0)) + ROUNDING

    def enclose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (space, root, part), rows in runs(batches, ["space", "root", "slice"]):
            x = _stacked(rows.column("unit"), np.float64)
            mean = x.sum(0)
            mean /= max(np.sqrt(mean @ mean), 1e-300)
            angle = float(np.arccos(np.clip(x @ mean, -1, 1)).max())
            yield pa.RecordBatch.from_arrays([pa.array([space]), pa.array([root], pa.int64()), pa.array([part], pa.int32()), pa.array([mean.tobytes()]), pa.array([angle + reach])], names=["space", "root", "slice", "mean", "angle"])

    keys = ["space", "root", "slice"]
    balls = cut(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(enclose, "space string, root long, slice int, mean binary, angle double").withColumn("ball", F.monotonically_increasing_id()))
    # Taken in groups of about half of BALLS each, by a hash.
    groups = max(1, -(-balls.count() // max(1, BALLS // 2)))
    parted, parts = sent(large.select("space", "parts")), F.coalesce("parts", F.lit(1)).alias("parts")
    near = None
    for group in range(groups):
        own = balls.where(F.pmod(F.xxhash64("ball"), F.lit(groups)) == group).collect()
        by_space: dict[str, list] = {}
        for ball in own:
            by_space.setdefault(ball["space"], []).append(ball)
        tables = {
            space: (np.array([b["ball"] for b in some]), np.stack([np.frombuffer(b["mean"], np.float64) for b in some]), np.cos(np.minimum([b["angle"] for b in some], np.pi)))
            for space, some in by_space.items()
        }

        def meet(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                space = np.array(batch.column("space").to_pylist(), object)
                slices = batch.column("node").to_numpy() % batch.column("parts").to_numpy()
                for name, (ball, mean, least) in tables.items():
                    at = np.flatnonzero(space == name)
                    if len(at):
                        i, j = np.nonzero(_stacked(batch.column("unit").take(pa.array(at)), np.float64) @ mean.T >= least - ROUNDING)
                        met = batch.take(pa.array(at[i]))
                        slice_ = pa.array(slices[at[i]], pa.int32())
                        yield pa.RecordBatch.from_arrays([met.column("node"), met.column("copies"), met.column("unit"), pa.array(ball[j], pa.int64()), slice_], names=["node", "copies", "unit", "ball", "part"])

        some = nodes.select("node", "space", "copies", "unit").join(parted, "space", "left").select("node", "space", "copies", "unit", parts).mapInArrow(meet, "node long, copies long, unit binary, ball long, part int")
        near = some if near is None else near.unionByName(some)
    marks = dealt.select(F.col("node").alias("full_node"))
    near = near.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(marks, F.col("node") == F.col("full_node"), "left")
    near = near.select("ball", "part", "node", "copies", "unit", "root", F.col("full_node").isNotNull().alias("full"), F.lit(1).alias("role"))
    part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    inside = dealt.join(balls.select(*keys, "ball"), keys).join(parted, "space", "left").select("ball", part.alias("part"), "node", "copies", "unit", "root", F.lit(True).alias("full"), F.lit(0).alias("role"))
    cell = ["ball", "part"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for key, rows in runs(batches, cell, 1024):
            if key != at:
                if at is not None and held:
                    yield counted(who, n)
                at, held = key, []
            role = rows.column("role").to_numpy()
            inner, outer = rows.filter(pa.array(role == 0)), rows.filter(pa.array(role == 1))
            if inner.num_rows:
                held.append(inner)
                table = pa.concat_tables(held)
                who, x, root = table.column("node").to_numpy(), _stacked(table.column("unit"), np.float64), table.column("root").to_numpy()
                n = np.zeros(len(who), np.int64)
            if not outer.num_rows or not held:
                continue
            other, y = outer.column("node").to_numpy(), _stacked(outer.column("unit"), np.float64)
            linked = (x @ y.T >= threshold) & (who[:, None] != other)
            n += linked @ outer.column("copies").to_numpy()
            full, other_root = np.array(outer.column("full").to_pylist(), bool), outer.column("root").to_numpy()
            i, j = np.nonzero(linked[:, ~full])
            j = np.flatnonzero(~full)[j]
            yield links(who[i], other[j], False)
            i, j = np.nonzero(linked & full & (root[:, None] != other_root))
            if len(i):
                _, one = np.unique(other_root[j], return_index=True)  # a block lies in one component
                yield links(who[i[one]], other[j[one]], True)
        if at is not None and held:
            yield counted(who, n)

    def counted(who: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return _batch(COMPARED, [who, n, [None] * len(n), [None] * len(n), [None] * len(n)])

    def links(u: np.ndarray, v: np.ndarray, both: bool) -> pa.RecordBatch:
        return _batch(COMPARED, [[None] * len(u), [None] * len(u), u, v, [both] * len(u)])

    return near.unionByName(inside).repartition(*cell).sortWithinPartitions(*cell, "role").mapInArrow(compare, COMPARED)


def _audit(nodes: DataFrame, full: DataFrame, links: DataFrame, threshold: float) -> tuple[int, int]:
    """(links, links found) of a bounded sample of nodes that are not full, compared with every row."""
    some = nodes.select("node", "space", "unit").join(full.select(F.col("u").alias("node")), "node", "left_anti")
    sample = some.orderBy(F.xxhash64("node"), "node").limit(AUDITED).collect()
    by_space: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for space in {r["space"] for r in sample}:
        own = [r for r in sample if r["space"] == space]
        by_space[space] = (np.array([r["node"] for r in own]), np.stack([np.frombuffer(r["unit"], np.float64) for r in own]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces, who = np.array(batch.column("space").to_pylist(), object), batch.column("node").to_numpy()
            for space, (asked, x) in by_space.items():
                at = np.flatnonzero(spaces == space)
                if len(at):
                    i, j = np.nonzero(x @ _stacked(batch.column("unit").take(pa.array(at)), np.float64).T >= threshold)
                    i, j = asked[i], who[at[j]]
                    yield _batch("u long, v long", [np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]])

    true = nodes.select("node", "space", "unit").mapInArrow(make, "u long, v long").distinct()
    found = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(True).alias("found")).distinct()
    row = true.join(found, ["u", "v"], "left").agg(F.count(F.lit(1)), F.count("found")).first()
    return row[0], row[1]


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = RECALL, report: dict | None = None
) -> DataFrame:
    """Link vectors of one label whose cosine, in double precision, is at least ``threshold``.

    Returns, for every input row, ``id_col``, ``n_links`` (other rows linked directly), ``component_id``
    (the least id reached by links, its own included) and ``kept`` (whether it is that one).

    No link is wrong.  Links of vectors with more than ``LONGEST`` distinct partners are all found, and so
    are all links of labels up to ``CELL`` distinct vectors; of the others the share ``recall`` at least is
    found in an audit, which is logged and put in ``report`` (links, found, recall, searches, exact).

    Vectors that are null or zero or hold null, NaN or infinite components link with nothing, and so
    do rows with a null label or id and vectors of another length.  Repeated rows and copies are linked
    with each other.  An empty table gives an empty result; other columns are not read.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = _rows(vectors, id_col, vector_col, label_col)
    nodes = cut(_nodes(rows))
    large = _large(nodes)
    angle = math.acos(min(1.0, threshold))
    near, floor = threshold - MARGIN, math.cos(min(2 * angle, math.pi / 2)) - MARGIN
    times = [_draws(bits, angle) for bits in range((large.agg(F.max("bits")).first()[0] or 0) + 1)]
    lists, begun = None, 0
    for search in range(1, SEARCHES + 1):
        lists = _search(nodes, large, lists, begun, times, near, floor)
        # Spaces without bits have been compared whole.
        begun, times = begun + max(times), [0, *(2 * n for n in times[1:])]
        full = lists.where("full").select("u")
        links = cut(_exact(lists.select("u", F.explode(F.arrays_zip("vs", "sims")).alias("e")).where(F.col("e.sims") >= near).select("u", F.col("e.vs").alias("v")), nodes, threshold))
        roots, compared = connected_components(links), None
        if not full.isEmpty():
            compared = cut(_compared(nodes, large, full, roots, threshold))
            links = links.unionByName(compared.where("u IS NOT NULL").select("u", "v"))
        true, known = _audit(nodes, full, links, threshold + ROUNDING)
        if known >= recall * true:
            break
    exact = known < recall * true
    if exact:
        full = nodes.select(F.col("node").alias("u"))
        compared = cut(_compared(nodes, large, full, roots, threshold))
        links, known = links.unionByName(compared.where("u IS NOT NULL").select("u", "v")), true
    found = {"links": true, "found": known, "recall": known / true if true else 1.0, "searches": search, "exact": exact}
    log.info("audit of near-duplicate vectors: %s", found)
    if report is not None:
        report.update(found)
    if compared is not None:
        roots = connected_components(links)
    return _placed(vectors, rows, nodes, links, full, compared, roots, id_col, id_type)


def _placed(vectors: DataFrame, rows: DataFrame, nodes: DataFrame, links: DataFrame, full: DataFrame, compared: DataFrame | None, roots: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """The result: links are counted from lists, those of full nodes from the comparison."""
    pairs = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if compared is not None:
        ends = ends.join(full, "u", "left_anti")
    counts = ends.join(nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("n"))
    if compared is not None:
        counts = counts.unionByName(compared.where("node IS NOT NULL").groupBy(F.col("node").alias("u")).agg(F.sum("n").alias("n")))
    linked = roots.join(nodes.select("node", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    placed = nodes.select("key", "node", "rep", "copies").join(roots, "node", "left").join(least, "root", "left").join(counts.withColumnRenamed("u", "node"), "node", "left")
    placed = placed.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    joined = rows.where("ok").select("id", _key().alias("key")).join(placed, "key").select("id", "n_links", "component").unionByName(alone)
    component = F.col("component").cast(id_type)
    return joined.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
