"""Nearest neighbours by inner product: a robust-pruned directed graph for each shard, searched by beams.

Vectors are dealt to shards of about SHARD by a hash. Within a shard inner product becomes distance by one more
coordinate, sqrt(M - |x|^2) with M the largest squared norm, which a query has as 0. The graph is built in batches:
each new point searches the graph so far greedily; of the points it came by, the nearest is kept and those are pruned
that are RELAX times nearer to the kept one than to the point, and so on, which leaves diverse edges. Edges go both
ways and are pruned again where a point has a third too many, and all at the end. A query runs a beam search in every
shard, and what the shards find is ranked by the exact inner product in double precision.

Equal vectors are indexed once with their k + 1 smallest ids: no answer can need more, as ties go to smaller
ids. Queries are dealt in blocks of QUERY_BLOCK, so a task holds one shard and one block, and a shard's graph goes to one
task for each block. Every query searches every shard, so it is the shards that grow with the corpus, as far as a
task holds (SHARD to MAX_SHARD), and not their number: FAN at most, up to FAN * MAX_SHARD (786,432) vectors. Beyond,
searches are queries times shards again: with 100 million vectors there are 1,526 shards and 153 blocks of queries.

Vectors that are null, zero, or hold a null or non-finite component, and rows without an id, take no part. Repeated
rows count once; of different vectors with one id each is a candidate, and the smallest is the query. Vectors of
different lengths are never compared. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliospark.llm.common import scratch

SHARD, MAX_SHARD = 4096, 65_536
#: So many shards at most, while none is larger than MAX_SHARD.
FAN = 12
#: Beyond so many rows in a shard its beam grows.
WIDE_SHARD = 16_384
DEGREE = 32
BUILD_BEAM = 64
BEAM = 96
RELAX = 1.2
QUERY_BLOCK = 32_768
#: Queries of a block that step through a graph together.
TOGETHER = 256
BATCH = 512
#: Of the beam, so many points are expanded at a time.
WIDTH = 4
#: A point may have 1 / SLACK more edges than DEGREE while a graph is built.
SLACK = 3
#: So many distances between candidates are held while points are pruned.
PAIRS = 1 << 20


def marks(n: int, together: int) -> np.ndarray:
    """By query and point: -1, or the place in its step at which the point was met. A search leaves them as it found them."""
    return np.full(n * together, -1, np.int32)


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of each query's beam, nearest first. All queries step together."""
    nq, n = len(queries), len(x)
    ids = np.full((nq, beam), -1, np.int64)
    far = np.full((nq, beam), np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    met = marks(n, nq) if met is None else met
    # written over in each step: fresh memory costs more than the differences
    rooms = np.empty((2, nq * WIDTH * edges.shape[1], x.shape[1]), np.float32)
    touched = [np.arange(nq) * n + start]
    ids[:, 0], done[:, 0], met[touched[0]] = start, False, 0
    far[:, 0] = ((queries - x[start]) ** 2).sum(1)
    while True:
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            for key in touched:
                met[key] = -1
            return ids, far
        # the nearest WIDTH of the beam that are not expanded
        order = np.argsort(done[live], axis=1, kind="stable")[:, :WIDTH]
        rows = live[:, None]
        r, c = np.nonzero(~done[rows, order])
        done[rows, order] = True
        near = edges[ids[live[r], order[r, c]]]
        r = np.repeat(r, near.shape[1])
        near = near.reshape(-1)
        key = live[r] * n + near
        some = np.flatnonzero((near >= 0) & (met[key] < 0))
        r, near, key = r[some], near[some], key[some]
        # each point once, although several may lead to it
        met[key] = place = np.arange(len(key), dtype=np.int32)
        touched.append(key)
        some = np.flatnonzero(met[key] == place)
        r, near = r[some], near[some]
        counts = np.bincount(r, minlength=len(live))
        gap, asked = (room[: len(near)] for room in rooms)
        np.take(x, near, axis=0, out=gap, mode="clip")
        np.take(queries, live[r], axis=0, out=asked, mode="clip")
        gap -= asked
        # the new ones of each query side by side, behind its beam
        wide = beam + int(counts.max())
        at = r * wide + beam + np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        all_ids, all_far, all_done = np.full((len(live), wide), -1, np.int64), np.full((len(live), wide), np.inf, np.float32), np.ones((len(live), wide), bool)
        all_ids[:, :beam], all_far[:, :beam], all_done[:, :beam] = ids[live], far[live], done[live]
        all_ids.reshape(-1)[at], all_far.reshape(-1)[at], all_done.reshape(-1)[at] = near, np.einsum("ij,ij->i", gap, gap), False
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam] + np.arange(len(live))[:, None] * wide
        ids[live], far[live], done[live] = np.take(all_ids, best), np.take(all_far, best), np.take(all_done, best)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Neighbours (-1: none) of each point, of its candidates (-1: none)."""
    out = np.full((len(points), degree), -1, np.int64)
    step = max(1, PAIRS // max(1, candidates.shape[1]) ** 2)
    for a in range(0, len(points), step):
        out[a : a + step] = _prune(x, points[a : a + step], candidates[a : a + step], degree, relax)
    return out


def _prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    rows = np.arange(len(points))
    candidates = np.where(candidates == points[:, None], -1, candidates)
    gap = np.take(x, np.maximum(candidates, 0), axis=0)
    gap -= x[points][:, None, :]
    # with places about the point: relax^2 |u - v|^2 > |v|^2, written by the products of u and v
    products = gap @ gap.transpose(0, 2, 1)
    d = np.einsum("ijj->ij", products).copy()
    keeps = products < (d / 2)[:, :, None] + (d * np.float32((1 - relax**-2) / 2))[:, None, :]
    d[candidates < 0] = np.inf
    out = np.full((len(points), degree), -1, np.int64)
    for k in range(degree):
        pick = d.argmin(1)
        some = np.isfinite(d[rows, pick])
        if not some.any():
            break
        out[some, k] = candidates[some, pick[some]]
        d[~keeps[rows, pick]] = np.inf
        d[rows, pick] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1: none) and the start, the point nearest to the mean."""
    n = len(x)
    # while the graph grows a point may have some edges more, and is pruned when they are full
    edges = np.full((n, degree + degree // SLACK), -1, np.int64)
    held = np.zeros(n, np.int64)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    met = marks(n, min(BATCH, n))
    at = 1
    while at < n:
        new = order[at : at + max(1, min(BATCH, at))]
        ids, _ = beam_search(x, edges, x[new], start, beam, met)
        # those of one batch do not find each other by search, so a few of them are put to each as well
        peers = new[np.random.default_rng(at).integers(0, len(new), (len(new), 16))]
        chosen = robust_prune(x, new, np.concatenate([ids, peers], axis=1), degree, relax)
        edges[new, :degree], held[new] = chosen, (chosen >= 0).sum(1)
        source, slot = np.nonzero(chosen >= 0)
        target, source = chosen[source, slot], new[source]
        back = (edges[target] == source[:, None]).any(1)
        target, source = target[~back], source[~back]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        hubs, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = held[target] + np.arange(len(target)) - np.repeat(first, counts)
        held[hubs] += counts
        room = held[hubs] <= edges.shape[1]
        fits = np.repeat(room, counts)
        edges[target[fits], place[fits]] = source[fits]
        # points without room are pruned, those with about as many edges together
        wide = np.ceil(np.log2(np.maximum(held[hubs] - degree, 1)))
        for w in np.unique(wide[~room]):
            some = ~room & (wide == w)
            full = hubs[some]
            both = np.full((len(full), int(held[full].max())), -1, np.int64)
            both[:, : edges.shape[1]] = edges[full]
            more = np.repeat(some, counts)
            both[np.repeat(np.arange(len(full)), counts[some]), place[more]] = source[more]
            edges[full] = -1
            edges[full, :degree] = chosen = robust_prune(x, full, both, degree, relax)
            held[full] = (chosen >= 0).sum(1)
        at += len(new)
    over = np.flatnonzero(held > degree)
    edges[over, :degree] = robust_prune(x, over, edges[over], degree, relax)
    return edges[:, :degree].copy(), start


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _matrix(column, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def _build_shard(t: pa.Table) -> pa.Table:
    v = _matrix(t.column("embedding"))
    norm = (v * v).sum(1)
    x = np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
    edges, start = build(x)
    n = len(x)
    return pa.table(
        {"shard": t.column("shard"), "dim": t.column("dim"), "node": pa.array(np.arange(n), pa.int32()), "ids": t.column("ids"), "embedding": t.column("embedding"), "edges": _lists(edges, pa.int32()), "start": pa.array(np.full(n, start), pa.int32())}
    )


def beam_for(beam: int, rows: int) -> int:
    """The beam in a shard of so many rows: it grows with the square root beyond WIDE_SHARD, to keep the recall."""
    return round(beam * max(1.0, rows / WIDE_SHARD) ** 0.5)


def _search_shard(k: int, beam: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if index.num_rows and queries.num_rows:
            index = index.sort_by("node")
            v, q, own = _matrix(index.column("embedding")), _matrix(queries.column("embedding")), queries.column("vec_id").to_numpy()
            norm = (v * v).sum(1)
            x = np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
            # the nearest by distance are those of largest inner product whatever the query's length; scaling helps float32
            scale = np.sqrt(norm.max()) / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)
            asked = np.concatenate([q * scale[:, None], np.zeros((len(q), 1))], axis=1).astype(np.float32)
            edges, start = _matrix(index.column("edges"), np.int64), index.column("start")[0].as_py()
            names = index.column("ids").combine_chunks()
            held, names = pc.list_value_length(names).to_numpy(), names.flatten().to_numpy()
            first = np.cumsum(held) - held
            met = marks(len(x), min(TOGETHER, len(q)))
            for a in range(0, len(q), TOGETHER):
                nodes, _ = beam_search(x, edges, asked[a : a + TOGETHER], start, max(beam_for(beam, len(x)), k + 1), met)
                asking, slot = np.nonzero(nodes >= 0)
                node = nodes[asking, slot]
                score = np.einsum("ij,ij->i", v[node], q[a + asking])
                # all ids of a vector, but the query's own
                many = held[node]
                name = names[np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                asking, score = np.repeat(a + asking, many), np.repeat(score, many)
                some = np.flatnonzero(name != own[asking])
                some = some[np.lexsort((name[some], -score[some], asking[some]))]
                counts = np.bincount(asking[some] - a)
                some = some[np.arange(len(some)) - np.repeat(np.cumsum(counts) - counts, counts) < k]
                for out, column in zip(found, (own[asking], name, score), strict=True):
                    out.append(column[some])
        columns = [np.concatenate(c) if c else [] for c in found]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, dim of the rows that take part, each once."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(F.coalesce(good & some, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim")).distinct()


def shard_count(n: int, shard_rows: int | None = None) -> int:
    return max(1, round(n / (shard_rows or min(MAX_SHARD, max(SHARD, n / FAN)))))


def build_index(vectors: DataFrame, k: int, shard_rows: int | None = None) -> DataFrame:
    """shard, dim, node, ids, embedding, edges, start: every vector that takes part, written to the shared folder."""
    rows = usable(vectors)
    # the limit on row_number is tried in each task before rows are shuffled, so a vector with many ids is not gathered
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("dim", "embedding").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    once = scratch(ranked.groupBy("dim", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = once.count()
    shards = shard_count(n, shard_rows)
    dealt = once.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    kind = dict(once.dtypes)["embedding"]
    schema = f"shard int, dim int, node int, ids array<long>, embedding {kind}, edges array<int>, start int"
    dealt = dealt.select("shard", "dim", "ids", "embedding")
    return scratch(dealt.groupBy("shard", "dim").applyInArrow(_build_shard, schema), "graph")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query (vec_id, embedding)."""
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    asked = scratch(asked, "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = scratch(index.select("shard", "dim").distinct(), "shards")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    # each block of queries goes to every shard of its dimension
    sent = asked.select("vec_id", "embedding", "dim", block).join(shards, "dim")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("shard", "dim", "block")
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search_shard(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
