"""Approximate nearest neighbours on robust-pruned graphs.

Vectors are dealt by hash into shards of bounded size.  Each shard gets a directed graph:
a greedy search proposes neighbours of a vector, and pruning keeps a neighbour only if no
kept one is closer to it by the factor ``alpha``, so edges point in different directions.
Equal directions are one node of the graph, with the list of their rows.  Queries travel in
blocks to every shard and stream past its graph, a beam search answers them there, and the best
answers of all shards are merged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintide.llm.common import written

DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 96
SHARD_ROWS = 6000
SHARD_BYTES = 24_000_000  # of the numbers of a shard
QUERY_BLOCK = 256
BLOCKS_AT_ONCE = 64  # blocks of queries that follow one copy of a graph


def beam_search(units: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` closest vectors met, nearest first, and the vectors expanded on the way (-1: none)."""
    m, n = len(queries), len(units)
    seen = np.zeros((m, n + 1), bool)
    seen[:, [entry, n]] = True
    ids = np.full((m, beam), n)
    far = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = entry, 1 - queries @ units[entry], False
    path = []
    active = np.arange(m)
    while len(active):
        pick = np.argmin(done[active], 1)  # the closest that isn't expanded yet
        node = ids[active, pick]
        done[active, pick] = True
        step = np.full(m, -1)
        step[active] = node
        path.append(step)
        near = graph[node]
        near = np.where(near < 0, n, near)
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        distance = np.full(near.shape, np.inf, np.float32)
        r, c = np.nonzero(new)
        distance[r, c] = 1 - np.einsum("ij,ij->i", queries[active[r]], units[near[r, c]])
        all_far = np.concatenate([far[active], distance], 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~new], 1), order, 1)
        far[active] = np.take_along_axis(all_far, order, 1)
        active = active[~done[active].all(1)]
    return np.where(np.isinf(far), -1, ids), np.stack(path, 1)


def robust_prune(units: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to ``degree`` of its options (-1: none), pruned with relaxed distances."""
    n = len(units)
    options = np.sort(np.where((options < 0) | (options == nodes[:, None]), n, options), 1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = n
    vectors = units[np.minimum(options, n - 1)]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ijk,ik->ij", vectors, units[nodes])))
    far[options == n] = np.inf
    order = np.argsort(far, 1, kind="stable")
    options, far = np.take_along_axis(options, order, 1), np.take_along_axis(far, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    apart = alpha * np.sqrt(np.maximum(0, 2 - 2 * vectors @ vectors.transpose(0, 2, 1)))
    alive = np.isfinite(far)
    kept = np.full((len(nodes), degree), -1, np.int32)
    line = np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmax(alive, 1)
        some = alive[line, pick]
        if not some.any():
            break
        kept[some, k] = options[line, pick][some]
        alive &= apart[line, pick] > far
        alive[line, pick] = False
    return kept


def build(units: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Neighbours of each vector (-1: none) and the vector where searches start."""
    n = len(units)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(np.argmax(units @ units.mean(0)))
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(256, at))]
        ids, path = beam_search(units, graph, entry, units[batch], beam)
        graph[batch] = robust_prune(units, batch, np.concatenate([ids, path], 1), degree, alpha)
        # every new edge is also offered the other way
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        offered = np.full((len(nodes), int(count.max())), -1)
        offered[np.repeat(np.arange(len(nodes)), count), place] = source
        options = np.concatenate([graph[nodes], offered], 1)
        free = (graph[nodes] < 0).sum(1) >= count
        packed = np.take_along_axis(options, np.argsort(options < 0, 1, kind="stable"), 1)[:, :degree]
        graph[nodes[free]] = packed[free]
        for some in np.array_split(np.flatnonzero(~free), max(1, (~free).sum() // 512)):
            if len(some):
                graph[nodes[some]] = robust_prune(units, nodes[some], options[some], degree, alpha)
        at += len(batch)
    return graph, entry


def usable(vec: str) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> DataFrame:
    """(dim, shard, graph): the packed graph and vectors of each shard of (row, id, vec).

    Every row is indexed.  A shard holds about ``shard_rows`` rows, fewer of long vectors, whatever
    their values.  Rows of one direction are one node; those of a node are kept by vector, then by id.
    """
    n, widest = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    shards = max(1, -(-n // max(1, min(shard_rows, SHARD_BYTES // (12 * max(1, widest))))))
    dealt = vectors.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "id", "vec")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "row"])
        vec, same = np.unique(np.stack(rows["vec"].to_numpy()).astype(np.float64), axis=0, return_inverse=True)
        units = (vec / np.abs(vec).max(1, keepdims=True))
        units, node = np.unique((units / np.linalg.norm(units, axis=1, keepdims=True)).astype(np.float32), axis=0, return_inverse=True)
        graph, entry = build(units, degree, alpha, beam)
        by_node = np.argsort(node.ravel(), kind="stable")  # vectors by node
        place = np.empty(len(vec), np.int64)
        place[by_node] = np.arange(len(vec))
        by_vector = np.argsort(place[same.ravel()], kind="stable")  # rows by vector, then by id
        packed = _packed(
            row=rows["row"].to_numpy()[by_vector], id=rows["id"].to_numpy()[by_vector], rows=np.bincount(place[same.ravel()]),
            vec=vec[by_node], vectors=np.bincount(node.ravel()), units=units, graph=graph, entry=np.array(entry),
        )
        return pd.DataFrame({"dim": rows["dim"].iloc[:1].to_numpy(), "shard": rows["shard"].iloc[:1].to_numpy(), "graph": [packed]})

    return dealt.groupBy("dim", "shard").applyInPandas(one, "dim int, shard bigint, graph binary")


def _cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, of scaled vectors so that no square overflows."""
    q, v = queries / np.abs(queries).max(-1, keepdims=True), vectors / np.abs(vectors).max(-1, keepdims=True)
    return (q * v).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((v * v).sum(-1)))


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """A packed shard, ready for searches."""

    def __init__(self, blob: bytes):
        parts = np.load(io.BytesIO(blob))
        self.units, self.graph, self.entry, self.vec = parts["units"], parts["graph"], int(parts["entry"]), parts["vec"]
        self.vectors, self.rows, self.row, self.id = parts["vectors"], parts["rows"], parts["row"], parts["id"]
        self.first_vector, self.first_row = (np.cumsum(x) - x for x in (self.vectors, self.rows))

    def answers(self, queries: list[dict], k: int, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the ``k`` nearest rows of each query, but for its own row.

        Of the rows of one vector the k + 1 smallest ids are enough; the query may be one of them.
        """
        vec = np.array([q["vec"] for q in queries], np.float64)
        units = vec / np.abs(vec).max(1, keepdims=True)
        units = (units / np.linalg.norm(units, axis=1, keepdims=True)).astype(np.float32)
        found, _ = beam_search(self.units, self.graph, self.entry, units, max(beam, k + 1))
        for q, nodes, v in zip(queries, found, vec):
            nodes = nodes[nodes >= 0]
            near = _runs(self.first_vector[nodes], self.vectors[nodes])
            score = _cosine(v[None], self.vec[near])
            good = score >= np.sort(score)[::-1][min(k, len(score) - 1)]
            near, score = near[good], score[good]
            counts = np.minimum(self.rows[near], k + 1)
            rows, score = _runs(self.first_row[near], counts), np.repeat(score, counts)
            others = self.row[rows] != q["row"]
            rows, score = rows[others], score[others]
            best = np.lexsort((self.id[rows], -score))[:k]
            yield self.id[rows][best], score[best]


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_row, query_id, rank, id, score): the ``k`` nearest others of each of (row, id, vec).

    Queries are packed into blocks of about ``block``.  A graph travels once for every
    BLOCKS_AT_ONCE blocks, which follow it through a task one by one.  A query meets only
    vectors of its own length.
    """
    sized = queries.withColumn("dim", F.size("vec"))
    blocks = max(1, -(-queries.count() // block))
    slices = -(-blocks // BLOCKS_AT_ONCE)
    number = F.pmod(F.xxhash64("row"), F.lit(blocks))
    dealt = sized.groupBy("dim", number.alias("block")).agg(F.collect_list(F.struct("row", "id", "vec")).alias("queries"))
    known = graphs.select("dim", "shard")
    asked = dealt.join(known, "dim").select("dim", "shard", F.pmod("block", F.lit(slices)).alias("slice"), "queries", F.lit(None).cast("binary").alias("graph"))
    copies = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        "dim", "shard", F.col("slice").cast("bigint").alias("slice"), F.lit(None).cast(asked.schema["queries"].dataType).alias("queries"), "graph"
    )
    groups = max(1, known.count()) * slices
    rows = copies.unionByName(asked).repartition(groups, "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", F.col("graph").isNull())
    out = "query_row bigint, query_id bigint, id bigint, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for asked, blob in zip(batch.column(0), batch.column(1)):
                if blob.is_valid:
                    shard = Shard(blob.as_py())
                    continue
                asked = asked.as_py()
                columns = [[], [], [], []]
                for q, (ids, scores) in zip(asked, shard.answers(asked, k, beam)):
                    for column, values in zip(columns, ([q["row"]] * len(ids), [q["id"]] * len(ids), ids.tolist(), scores.tolist())):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_row", "query_id", "id", "score"])

    nearest = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    merged = rows.select("queries", "graph").mapInArrow(run, out).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return merged.select("query_row", "query_id", "rank", "id", "score")


def nearest(
    table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec: str = "vec", **options,
) -> DataFrame:
    """(query_id, rank, id, score) of the rows that ``queries`` selects, against all other rows.

    Score is the cosine in double precision on the original vectors, ties to the smaller
    id.  Rows whose vector is null, zero or has null or non-finite components, and rows without
    an id, take no part.  Repeated rows are each other's neighbours: equal vectors are one node of a shard's
    graph, and a node answers with its smallest ids.  Vectors of different
    length never meet.  An empty table gives no rows; extra columns don't matter.  ``table``
    must be a table, as its rows are numbered by position.
    """
    rows = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vec"), queries.alias("asked"),
    ).filter(F.col("id").isNotNull() & usable("vec"))
    rows = written(rows)
    graphs = written(index(rows.drop("asked"), **options))
    found = search(graphs, rows.filter("asked").drop("asked"), k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
