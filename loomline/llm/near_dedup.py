"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class, a node of the graph.  Banded signatures bring nodes
into buckets.  A pair of a bucket is compared batch by batch of its signatures; after n hashes with
m matches the similarity has a Beta(m + 1, n - m + 1) posterior, and the pair is dropped once the
probability of reaching the threshold falls below the chosen miss probability.  What survives is
confirmed on whole shingle sets.

Not all pairs of a bucket are needed.  First each node is compared with its bucket's centre, the node
that shares most buckets with others: in a family of copies of one text that is the text itself.  The
links found make components.  Then only buckets that still span components are taken up again: in
those, nodes outside the bucket's most common component meet all nodes of other components, in
cells of bounded size.  Pairs within a component need no look, as they cannot change it.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut, sent, spread
from loomline.llm.components import connected_components

#: Signature values a band takes together, and signature values compared at a time.
ROWS, BATCH = 6, 30
#: Probability that a pair at the threshold shares no band, and that the posterior drops it.
MISS = 1e-5
#: Rows of a cell: nodes outside the most common component, and nodes that they meet.
OUTSIDE, MET = 256, 2048
#: Signature values for pairs across components: there may be many pairs just below the threshold.
LONGER = 600
#: Members of one task's star; larger stars are split.
STAR = 512
#: Shingles that are hashed together.
TOGETHER = 400_000
#: Signature values are 16 bits of a minimum that is mixed first, as the minimum of a large set is all but zero in its
#: upper bits: of two sets with nothing in common, one value in 65,536 is equal, whatever their sizes.
SIGNED = "<u2"
#: Copies of a set above which the class is sent to its rows.
COPIES = 10_000


def bands_for(percent: int) -> int:
    """Bands after which a pair at the threshold has been missed with probability ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


@functools.lru_cache(maxsize=256)
def least_matches(n: int, percent: int) -> int:
    """The fewest matches among n hashes at which P(similarity >= threshold) is ``MISS`` or more.

    With a flat prior that probability is P(Binomial(n + 1, threshold) <= matches).
    """
    t, total = percent / 100, 0.0
    for m in range(n + 2):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= MISS:
            return m
    return n


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = [int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=16).digest(), "little") for i in range(n)]
    return np.array([(d & (1 << 64) - 1) | 1 for d in draw], np.uint64), np.array([d >> 64 for d in draw], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The text's set of word shingles as sorted 64-bit hashes; A-Z in lower case, words between white space.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def _signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures (sets x n) of sets that are not empty."""
    a, b = _multipliers(n)
    out = np.empty((len(sets), n), SIGNED)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= TOGETHER):
            size += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[at:stop])
        starts = np.cumsum([0, *(len(s) for s in sets[at : stop - 1])])
        for k in range(n):
            out[at:stop, k] = _mixed(np.minimum.reduceat(x * a[k] + b[k], starts)) >> np.uint64(48)
        at = stop
    return out


def _sets(documents: DataFrame, id_col: str, text_col: str, words: int, n: int) -> DataFrame:
    """(id, text_hash, n_shingles, digest, sig); digest and sig are null for the empty set."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            some = [s for s in sets if len(s)]
            signed = iter([row.tobytes() for row in _signatures(some, n)] if some else [])
            columns = {
                "id": batch.column(0),
                "text_hash": batch.column(1),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                "sig": pa.array([next(signed) if len(s) else None for s in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.select("id", _text_hash(), "text").mapInArrow(make, f"id {id_type}, text_hash long, n_shingles long, digest binary, sig binary")


def _text_hash():
    return F.xxhash64("text").alias("text_hash")


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), SIGNED).reshape(len(column), -1)


def _keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """The bucket (signatures x bands) of every band: a hash of the band's number and values."""
    parts = sig[:, : bands * ROWS].reshape(-1, bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _bands(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, node) for every band of every node."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _keys(_stacked(batch.column(1)), bands)
            who = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(pa.array(who))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(make, "key long, node long")


def _crowded(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, node, centre) of every bucket of two nodes or more.

    The centre is the node that meets most others over all its buckets; ties go to the larger node.
    """
    keyed = _bands(nodes, bands)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    rows = cut(keyed.join(sizes, "key"))
    weights = rows.groupBy("node").agg(F.sum("m").alias("weight"))
    centres = rows.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    return cut(rows.join(centres.select("key", F.col("top.node").alias("centre")), "key").select("key", "node", "centre"))


def _plausible(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a row i of one signature table and a row j of another stay plausible through all batches."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n in range(BATCH, left.shape[1] + 1, BATCH):
        if not len(alive):
            break
        part = slice(n - BATCH, n)
        matches = matches + (left[i[alive], part] == right[j[alive], part]).sum(1)
        keep = matches >= least_matches(n, percent)
        alive, matches = alive[keep], matches[keep]
    return alive


def _starred(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(a, part, b, *columns): the stars of all pairs (a, b), sorted so that the centre a comes first, with b null.

    A star has a part for every ``STAR`` members; each part gets its centre's row of ``nodes`` and each
    member's own, so that a centre with any number of members is spread over many tasks.
    """
    stars = cut(pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(1) / {STAR}) AS int)").alias("parts")))
    large = sent(stars.where("parts > 1"))
    members = pairs.join(large, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "b")
    members = members.join(nodes.withColumnRenamed("node", "b"), "b").select("a", "part", "b", *columns)
    part = F.explode(F.expr("sequence(0, parts - 1)")).alias("part")
    centres = stars.join(nodes.withColumnRenamed("node", "a"), "a").select("a", part, F.lit(None).cast("long").alias("b"), *columns)
    return centres.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))


def _prune(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that signatures leave plausible."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[int | None, bytes] = (None, b"")
        for batch in batches:
            a, b, sig = (batch.column(c).to_pylist() for c in ("a", "b", "sig"))
            centres, members = [], []
            for i, (x, y) in enumerate(zip(a, b)):
                if y is None:
                    own = (x, sig[i])
                elif own[0] == x:
                    centres.append(own[1])
                    members.append(i)
            if members:
                left, right = (np.frombuffer(b"".join(side), SIGNED).reshape(len(members), -1) for side in (centres, [sig[i] for i in members]))
                same = np.arange(len(members))
                keep = _plausible(left, right, same, same, percent)
                yield batch.select(["a", "b"]).take(pa.array(np.array(members)[keep], pa.int64()))

    return _starred(pairs, nodes.select("node", "sig"), ["sig"]).mapInArrow(make, "a long, b long")


def _texts(documents: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, digest, text) for the wanted (node, digest, rep): the text of one document of each class.

    ``rep`` is the id and the text's hash; repeated rows are reduced to one before they move.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = wanted.select("node", "digest", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    found = rows.join(asked, F.col("id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_hash")))
    return cut(found.select("node", "digest", "text").dropDuplicates(["node"]))


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold; a task holds one centre's set at a time."""
    dealt = _starred(pairs, texts, ["digest", "text"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, digest, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "digest", "text"))):
                if b is None and a == centre:
                    continue
                hashes = shingles(text, words)
                if set_digest(hashes) != digest:
                    continue
                if b is None:
                    centre, own = a, hashes
                elif a == centre:
                    both = len(np.intersect1d(own, hashes, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(hashes) - both):
                        found.append((a, b))
            yield _pairs(found)

    return dealt.mapInArrow(make, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def _longer(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, sig) with ``LONGER`` values for the wanted nodes, from their texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            right = [i for i, d in enumerate(batch.column(1).to_pylist()) if len(sets[i]) and set_digest(sets[i]) == d]
            if right:
                sig = _signatures([sets[i] for i in right], LONGER)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right)), pa.array([row.tobytes() for row in sig], pa.binary())], names=["node", "sig"])

    return texts.join(wanted, "node").select("node", "digest", "text").mapInArrow(make, "node long, sig binary").dropDuplicates(["node"])


def _leftover_pairs(crowded: DataFrame, roots: DataFrame, texts: DataFrame, bands: int, words: int, percent: int) -> DataFrame:
    """Plausible pairs across components in buckets that span several, but for those with the centre."""
    rows = crowded.where(F.col("node") != F.col("centre")).select("key", "node")
    rows = rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    spans = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main"))
    spans = spans.where(F.col("roots") > 1).select("key", "n", (F.col("n") - F.col("most")).alias("outside"), "main")
    rows = cut(rows.join(spans, "key"))
    rows = rows.join(_longer(texts, rows.select("node").distinct(), words), "node")
    blocks, parts = F.expr(f"cast(ceil(outside / {OUTSIDE}) AS int)"), F.expr(f"cast(ceil(n / {MET}) AS int)")
    block, part = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.pmod(F.xxhash64("node"), parts).cast("int")
    outside = rows.where(F.col("root") != F.col("main")).select("key", "node", "root", "sig", block.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"))
    met = rows.select("key", "node", "root", "sig", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), part.alias("part"), ((F.col("root") == F.col("main")).cast("int") + 1).alias("role"))
    cell = ["key", "block", "part"]
    dealt = outside.unionByName(met).repartition(*cell).sortWithinPartitions(*cell, "role")

    def compare(key: int, held: list[tuple], waiting: list[tuple]) -> list[tuple[int, int]]:
        """Pairs of an outside row with a met one of another component; of two outside rows, once.

        A pair belongs to the first bucket that it shares.  Should one of the two be the centre there,
        the pair has been compared already, and no bucket puts it out.
        """
        if not held or not waiting:
            return []
        (a, a_root, _), (b, b_root, role) = (tuple(np.array([r[k] for r in side]) for k in (0, 1, 3)) for side in (held, waiting))
        i, j = np.nonzero((a_root[:, None] != b_root) & ((role == 2) | (a[:, None] < b)))
        x, y = (np.stack([np.frombuffer(r[2], SIGNED) for r in side]) for side in (held, waiting))
        keep = _plausible(x, y, i, j, percent)
        if not len(keep):
            return []
        x_keys, y_keys = _keys(x, bands)[i[keep]], _keys(y, bands)[j[keep]]
        keep = keep[np.take_along_axis(x_keys, (x_keys == y_keys).argmax(1)[:, None], 1)[:, 0] == key]
        return [*zip(np.minimum(a[i[keep]], b[j[keep]]).tolist(), np.maximum(a[i[keep]], b[j[keep]]).tolist())]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting = (None,), [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, block, part, node, root, sig, role in zip(*(batch.column(c).to_pylist() for c in (*cell, "node", "root", "sig", "role"))):
                if (key, block, part) != at:
                    found += compare(at[0], held, waiting)
                    at, held, waiting = (key, block, part), [], []
                if role == 0:
                    held.append((node, root, sig, role))
                else:
                    waiting.append((node, root, sig, role))
                    if len(waiting) >= 256:
                        found += compare(key, held, waiting)
                        waiting = []
            yield _pairs(found)
        yield _pairs(compare(at[0], held, waiting))

    return dealt.mapInArrow(make, "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns, for every input row, ``id_col``, ``n_shingles`` (size of its set), ``component_id`` (the least
    id it reaches by links, its own included) and ``kept`` (whether it is that one).

    Null texts, empty texts and texts of white space have no shingles and link with nothing.
    Repeated rows and copies have equal sets and are linked.  A null id is no candidate for
    ``component_id`` where its component has others; a component of null ids only has a null one, and
    its rows count as kept.  An empty table gives an empty result; texts of any length are taken whole.
    A pair at the threshold is missed with probability 2 * ``MISS`` at most.  Pairs are confirmed on whole sets of
    64-bit hashes of shingles; two shingles of one pair of texts of a million words each share a hash
    with a probability of 1e-7.  Columns other than the two named are not read.
    """
    bands = bands_for(percent)
    n = -(-bands * ROWS // BATCH) * BATCH
    sets = cut(_sets(documents, id_col, text_col, words, n))
    classes = sets.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_hash"))), F.min(F.struct("id", "text_hash"))).alias("rep"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("copies")
    )
    # Once the classes are written, their numbers stay.
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    crowded = _crowded(nodes, bands)
    wanted = crowded.select("node").distinct().join(nodes.select("node", "digest", "rep"), "node")
    texts = _texts(documents, wanted, id_col, text_col)
    pairs = crowded.where(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(_confirm(cut(_prune(pairs, nodes, percent)), texts, words, percent))
    roots = connected_components(links)
    more = cut(_confirm(cut(_leftover_pairs(crowded, roots, texts, bands, words, percent)), texts, words, percent))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    reps = nodes.select("node", "digest", "copies", F.col("rep.id").alias("rep"))
    linked = roots.join(reps.select("node", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    placed = reps.join(roots, "node", "left").join(least, "root", "left")
    placed = cut(placed.select("digest", "copies", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("least")))
    return _told(sets.select("id", "n_shingles", "digest"), placed, id_col)


def _told(sets: DataFrame, placed: DataFrame, id_col: str) -> DataFrame:
    """The result: each row gets its class's least id.  Classes of many copies are sent to their rows."""
    some = sets.where(F.col("digest").isNotNull())
    many = sent(placed.where(F.col("copies") > COPIES).select("digest", "least"))
    few = placed.where(F.col("copies") <= COPIES).select("digest", "least")
    columns = ["id", "n_shingles", "least"]
    joined = some.join(many, "digest").select(columns).unionByName(some.join(many, "digest", "left_anti").join(few, "digest").select(columns))
    alone = sets.where(F.col("digest").isNull()).select("id", "n_shingles", F.col("id").alias("least"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
