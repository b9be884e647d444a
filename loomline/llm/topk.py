"""Exact top-k search by tiled matrix products.

Queries and candidates meet in the cells of a grid: a cell pairs one block of queries with one
shard of candidates, so a query is sent to every shard and a candidate to every query block, and
no cell grows with the input.  In a cell the products of tiles are partially selected, lists of
tiles are merged, and a tree of groupings merges the lists of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, candidates of a shard (bounds of a cell), and candidates of a tile.
BLOCK, SHARD, TILE = 8_192, 32_768, 4_096
#: Lists merged at a time.
FAN_IN = 32
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53
LONG = 2**63 - 1


def scaled(column: str, factor: int = 256):
    """floor(factor * x) of every component, as doubles (whole numbers)."""
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * factor).cast("double"))


def usable(column: str):
    """Whether a vector is not null and all its components are finite numbers."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.col(column).isNotNull() & finite


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by double products where those are exact."""
    bound = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * max(queries.shape[1], 1)
    if bound < EXACT:
        return (queries @ tile.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries).dot(whole(tile).T) if queries.size and tile.size else np.zeros((len(queries), len(tile)), object)
    return np.vectorize(lambda s: min(max(s, -LONG - 1), LONG), otypes=[np.int64])(exact)


def _select(k: int, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each row's k best, ties to the smaller id; own ids do not count."""
    own = query_ids[:, None] == ids[None, :]
    if scores.shape[1] > 4 * k:
        # The k-th best score of a row bounds what can be among its best; ties at it stay for now.
        ranked = np.where(own, np.iinfo(np.int64).min, scores)
        least = np.partition(ranked, -k, axis=1)[:, -k]
        row, at = np.nonzero((scores >= least[:, None]) & ~own)
    else:
        row, at = np.nonzero(~own)
    return _best(k, row, ids[at], scores[row, at])


def _best(k: int, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], scores[place < k]


def _search_cell(k: int, cell: pd.DataFrame) -> pd.DataFrame:
    found = []
    for _, same in cell.groupby(cell["v"].map(len), sort=False):
        queries, rest = same[same["is_query"]], same[~same["is_query"]]
        if not len(queries) or not len(rest):
            continue
        q, qid = np.vstack(queries["v"].to_list()), queries["id"].to_numpy()
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for start in range(0, len(rest), TILE):
            tile = rest.iloc[start : start + TILE]
            for part in range(0, len(q), 512):  # bounds the product in memory
                row, ids, scores = _select(k, qid[part : part + 512], tile["id"].to_numpy(), _products(q[part : part + 512], np.vstack(tile["v"].to_list())))
                best = tuple(np.concatenate(x) for x in zip(best, (row + part, ids, scores)))
            best = _best(k, *best)
        found.append(pd.DataFrame({"query_id": qid[best[0]], "vec_id": best[1], "score": best[2]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """The k best candidates of every query by integer inner product of floor(factor * x) vectors.

    Queries are the rows whose id ``every`` divides; candidates are all rows with another id.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; equal scores go to the smaller
    id; a query with fewer than k candidates gets them all.

    Vectors that are null or hold null, NaN or infinite components, and rows with a null id, take no
    part.  Vectors of different lengths are not compared.  Repeated rows are candidates each; an id
    that repeats is one query, with its least vector.  Scores outside 64 bits are held at the limits.
    An empty table, or one row, gives an empty result.  Products are exact at any magnitude.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), scaled(vector_col, factor).alias("v"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n = vectors.select(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(id_col) % every == 0, 1)).alias("q")).first()
    blocks, shards = max(1, -(-n["q"] // BLOCK)), max(8, -(-n["n"] // SHARD))

    def spread(name: str, number: int):
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)

    def dealt(number: int):
        return F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")

    to_cells = asked.select("id", "v", F.lit(True).alias("is_query"), dealt(blocks).alias("block"), spread("shard", shards))
    candidates = rows.select("id", "v", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), spread("block", blocks))
    cells = to_cells.unionByName(candidates).groupBy("block", "shard")

    def search(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        return _search_cell(k, cell).assign(shard=key[1])

    lists = cells.applyInPandas(search, "query_id long, vec_id long, score long, shard int")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.expr(f"shard div {FAN_IN}"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


# DuckDB: one product a pair of query and candidate, exact in doubles at this magnitude.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
