"""Exact search for the largest inner products with paged M-trees.

Inner products become distances by one more coordinate: with M the largest norm
of all vectors, x gets sqrt(M^2 - |x|^2) and a query gets 0, so that
d(q, x)^2 = |q|^2 + M^2 - 2 q.x falls as the inner product rises.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starqa.sources.storage import stored

#: Vectors of a page at most (about), of a leaf, and entries of an inner node.
PAGE, LEAF, FAN = 2048, 128, 16
#: Queries searched together, routing vectors of the top level, vectors of the pilot.
QUERY_BLOCK, MAX_PIVOTS, PILOT = 256, 4096, 512
#: Beyond this a scaled component, and a score, counts as this: what a long holds, as a double.
LARGEST = float((1 << 63) - 1024)
#: Distances are floats: bounds give way by this share before anything is skipped.
SLACK = 1e-9


def scaled_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``row`` (a number of its own), ``vec_id`` and ``v``: floor(scale * x) of each component as double.

    Rows without id, without vector, or with a component that is null or not
    finite are left out.  Rows that share an id stay, each by itself.
    """
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    # The bound is a whole number, so it may come before the floor.
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long")
    return (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("raw"))
        .where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & F.forall("raw", fits))
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("raw", whole).alias("v"))
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), -1)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """The vectors as floats with the coordinate that evens their norms."""
    y = x.astype(np.float64)
    last = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", y, y), 0.0))
    return np.concatenate([y, last[:, None]], axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x to the vector y."""
    return np.sqrt(np.einsum("ij,ij->i", x - y, x - y))


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows: as floats where every sum is exact that way, as Python's numbers where 64 bits may not do."""
    size = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * x.shape[1]
    if size < 1 << 52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if size < 1 << 62:
        return x @ y.T
    exact = x.astype(object) @ y.astype(object).T
    return np.clip(exact, -int(LARGEST), int(LARGEST)).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return np.einsum("ij,ij->i", y, y)


@dataclass
class Tree:
    """Nodes as ranges of entries; an entry of an inner node leads to another node.

    Of each entry: its vector's row, its distance to the node's routing vector
    (-1 at the root), the covering radius and the child (leaf entries: 0, -1).
    """

    first: np.ndarray
    count: np.ndarray
    row: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray
    child: np.ndarray


def build_tree(lifted: np.ndarray) -> Tree:
    """Bulk loading: spread vectors over up to FAN routing vectors, node by node."""
    first, count, row, to_parent, radius, child = [], [], [], [], [], []

    def new_node(rows: np.ndarray, parent: np.ndarray | None) -> int:
        node = len(first)
        first.append(len(row))
        fan = [rows] if len(rows) <= LEAF else _spread(lifted, rows)
        if len(fan) < 2:  # a leaf; equal vectors cannot be spread and share a longer one
            near = np.full(len(rows), -1.0) if parent is None else _apart(lifted[rows], parent)
            count.append(len(rows))
            row.extend(rows.tolist())
            to_parent.extend(near.tolist())
            radius.extend([0.0] * len(rows))
            child.extend([-1] * len(rows))
            return node
        count.append(len(fan))
        start = len(row)
        for part in fan:
            center = lifted[part[0]]
            row.append(int(part[0]))
            to_parent.append(-1.0 if parent is None else float(_apart(center[None], parent)[0]))
            radius.append(float(_apart(lifted[part], center).max()))
            child.append(-1)
        for i, part in enumerate(fan):
            child[start + i] = new_node(part, lifted[part[0]])
        return node

    new_node(np.arange(len(lifted)), None)
    ints = lambda x: np.array(x, dtype=np.int64)
    return Tree(ints(first), ints(count), ints(row), np.array(to_parent), np.array(radius), ints(child))


def _spread(lifted: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows by the nearest of FAN far-apart routing vectors; each part starts with its own."""
    x = lifted[rows]
    chosen, near = [0], _apart(x, x[0])
    while len(chosen) < FAN and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _apart(x, x[chosen[-1]]))
    to = np.stack([_apart(x, x[c]) for c in chosen])
    to[range(len(chosen)), chosen] = -1.0
    owner = to.argmin(axis=0)
    return [
        np.concatenate([rows[[c]], rows[(owner == i) & (np.arange(len(rows)) != c)]]) for i, c in enumerate(chosen)
    ]


def search_tree(
    tree: Tree, whole: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray, top: float,
    order_by: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best first for a block of queries: query index, row and score of all that may be among a query's k best.

    ``bounds``: distances beyond which nothing counts for a query; they shrink
    as results come in.  Equal scores go by ``order_by``, then by id.  The queue holds a node, the queries that still need it
    and their distances to its routing vector; the least bound comes first.
    """
    none = np.iinfo(np.int64).min
    norms = _norms(queries)
    bounds = bounds.copy()
    scores = np.full((len(queries), k), none)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    everyone = np.arange(len(queries))
    queue: list[tuple] = [(0.0, 0, everyone, None, np.zeros(len(queries)))]
    reach = lambda who: bounds[who] * (1 + SLACK) + SLACK
    while queue:
        _, node, who, to_center, least = heapq.heappop(queue)
        still = least <= reach(who)
        who = who[still]
        a = tree.first[node]
        entries = np.arange(a, a + tree.count[node])
        if to_center is not None and len(who):  # the triangle inequality over stored distances, before any is computed
            gap = np.abs(to_center[still][:, None] - tree.to_parent[entries]) - tree.radius[entries]
            near = gap <= reach(who)[:, None]
            entries, who = entries[near.any(axis=0)], who[near.any(axis=1)]
        if not len(entries) or not len(who):
            continue
        rows = tree.row[entries]
        score = _products(queries[who], whole[rows])
        if tree.child[a] >= 0:
            apart = np.sqrt(np.maximum((norms[who] + top)[:, None] - 2.0 * score, 0.0))
            low = np.maximum(apart - tree.radius[entries], 0.0)
            wanted = low <= reach(who)[:, None]
            for i, e in enumerate(entries.tolist()):
                if (some := np.flatnonzero(wanted[:, i])).size:
                    lows = low[some, i]
                    heapq.heappush(queue, (float(lows.min()), int(tree.child[e]), who[some], apart[some, i], lows))
            continue
        score = np.where(ids[rows][None, :] == own[who][:, None], none, score)
        best = np.concatenate((scores[who], score), axis=1)
        scores[who] = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        worst = scores[who].min(axis=1)
        at, column = np.nonzero((score >= worst[:, None]) & (score > none))
        found.append((who[at], rows[column], score[at, column]))
        distance = np.sqrt(np.maximum(norms[who] + top - 2.0 * worst, 0.0))
        bounds[who] = np.where(worst > none, np.minimum(bounds[who], distance), bounds[who])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    query, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
    enough = score >= scores.min(axis=1)[query]
    query, row, score = query[enough], row[enough], score[enough]
    by = ids if order_by is None else order_by
    order = np.lexsort((ids[row], by[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    top_k = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top_k], row[top_k], score[top_k]


def _bounds(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int, top: float) -> np.ndarray:
    """Distance of each query to its k-th best of a sample; infinite if there are fewer."""
    if len(ids) <= k:
        return np.full(len(queries), np.inf)
    norms = _norms(queries)
    apart = np.sqrt(np.maximum((norms + top)[:, None] - 2.0 * _products(queries, sample), 0.0))
    apart[own[:, None] == ids[None, :]] = np.inf
    return np.partition(apart, k - 1, axis=1)[:, k - 1]


def build_pages(vectors: DataFrame, pivots: np.ndarray, pivot_dims: np.ndarray, page: int) -> DataFrame:
    """One row per page: ids and vectors, ``page_no`` counted from 0."""
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast((pivots, pivot_dims))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, dims = known.value
        for pdf in batches:
            cell = np.zeros(len(pdf), dtype=np.int64)
            lengths = pdf["v"].map(len).to_numpy()
            for dim in np.unique(lengths):
                own = np.flatnonzero(dims == dim)
                at = np.flatnonzero(lengths == dim)
                if len(own):
                    x = _matrix(pdf["v"].iloc[at]).astype(np.float64)
                    y = np.array([heads[i] for i in own], dtype=np.float64).reshape(len(own), -1)
                    cell[at] = own[(np.einsum("ij,ij->i", y, y)[None] - 2 * x @ y.T).argmin(axis=1)]
            yield pdf.assign(cell=cell, dim=lengths)

    celled = stored(vectors.mapInPandas(nearest, "row long, vec_id long, v array<long>, cell long, dim long"), "vectors")
    before = Window.orderBy("cell", "dim").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        celled.groupBy("cell", "dim").agg(F.count("*").alias("n"))
        .withColumn("parts", F.ceil(F.col("n") / page))
        .withColumn("offset", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    )
    return (
        celled.join(cells, ["cell", "dim"])
        .withColumn("page_no", F.col("offset") + F.pmod(F.xxhash64("row"), F.col("parts")))
        .groupBy("page_no", "dim")
        .agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("all"))
        .select("page_no", "dim", F.col("all.row").alias("rows"), F.col("all.vec_id").alias("ids"), F.flatten("all.v").alias("flat"))
    )


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    page: int = PAGE,
) -> DataFrame:
    """For each query row the k other rows with the largest integer inner product.

    Result: query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    Vectors of different lengths are not compared.  Rows of one id are rows of
    their own: each is a candidate for the others, and asked for it has results
    of its own.  See ``scaled_vectors`` for rows that take no part; a table
    without queries gives no rows.  Columns besides id and vector are not used
    (but by ``is_query``).  Components and scores beyond 64 bits count as the
    largest that fits.

    Vectors are dealt to pages around routing vectors (at most MAX_PIVOTS, from
    a bounded sample) and a cell with more than a page is split by row.  Every
    page is searched by every block of queries, one task reading one page and one
    block and loading the page as an M-tree, of which distant nodes are left
    unread.  A bounded pilot sample gives each query a first bound.
    """
    spark = vectors.sparkSession
    plain = stored(scaled_vectors(vectors, vec_id, vector, scale), "scaled")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top = plain.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    wanted = min(MAX_PIVOTS, -(-n // page)) if n else 0
    # A bounded sample by hash of the id: at most max(wanted, PILOT) vectors, chosen before any come to the driver.
    by = (F.xxhash64("vec_id"), F.col("vec_id"), F.col("row"))
    chosen = stored(plain.orderBy(*by).limit(max(wanted, PILOT)), "sample")
    sample = [(r["row"], r["v"]) for r in chosen.orderBy(*by).collect()]
    heads = [v for _, v in sample[:wanted]]
    pages = stored(build_pages(plain, heads, np.array([len(v) for v in heads]), page), "pages")
    n_pages = pages.count()
    pilot = spark.sparkContext.broadcast(sample[:PILOT])
    top = float(top)

    asked = plain.where(is_query)
    blocks = max(1, -(-n // (50 * QUERY_BLOCK)))
    blocks = (
        asked.withColumn("dim", F.size("v").cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        .groupBy("block", "dim")
        .agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("all"))
        .select(
            "block", "dim", F.col("all.row").alias("query_rows"), F.col("all.vec_id").alias("query_ids"),
            F.flatten("all.v").alias("queries"),
        )
        .withColumn("page_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_pages - 1)).cast("long"))))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows, ids, own, asked_ids = (np.array(x, dtype=np.int64) for x in (r.rows, r.ids, r.query_rows, r.query_ids))
                whole = np.array(r.flat, dtype=np.int64).reshape(len(ids), -1)
                queries = np.array(r.queries, dtype=np.int64).reshape(len(own), -1)
                few = [(i, v) for i, v in pilot.value if len(v) == whole.shape[1]]
                known = np.array([v for _, v in few], dtype=np.int64).reshape(len(few), whole.shape[1])
                bounds = _bounds(queries, own, known, np.array([i for i, _ in few], dtype=np.int64), k, top)
                tree = build_tree(_lifted(whole, top))
                query, row, score = search_tree(tree, whole, rows, queries, own, k, bounds, top, ids)
                yield pd.DataFrame(
                    {"query": own[query], "query_id": asked_ids[query], "row": rows[row], "vec_id": ids[row], "score": score}
                )

    # Spark takes the blocks of all pages for as few as the queries, so neither side may be broadcast.
    found = blocks.join(pages.hint("merge"), ["page_no", "dim"]).repartition("page_no", "block").mapInPandas(
        search, "query long, query_id long, row long, vec_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
