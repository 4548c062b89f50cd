"""Embedding near-duplicates over a flat, robustly pruned graph that is built in overlapping shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslab.llm.components import connected_components
from newslab.llm.simhash import _roots
from newslab.llm.vectors import matrix, usable
from newslab.session import settle

#: Rows in one graph; a larger shard is cut into lots, each searched by all of its shard.
LOT = 2048
#: Centroids are fitted on at most SAMPLE rows; there are at most SAMPLE / 10 of them.
SAMPLE = 20_000
NEAREST, RANDOM, DEGREE, ALPHA = 48, 24, 24, 1.2
BEAM = 16
#: Nodes this far below the threshold still have their neighbours looked at.
SLACK = 0.05
#: Asked are rows until so many with links to 1 .. FEW others are among them, at most ASKED rows at once.
AUDIT_ROWS, FEW, ASKED, AUDIT_RECALL = 256, 7, 4096, 0.97
MOST_OVERLAP = 48
#: Rows of a block and of a product tile of the exact comparison.
BLOCK, TILE = 8192, 1024


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    r = np.random.default_rng(seed)
    centre = sample[r.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i:i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.stack([np.bincount(near, sample[:, d], len(centre)) for d in range(sample.shape[1])], axis=1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centre)
    return centre


def robust_graph(v: np.ndarray, seed: int = 5) -> np.ndarray:
    """Neighbour lists (-1: none) of unit rows.

    Candidates of a node are its nearest rows and some random ones for long ways. The best candidate
    becomes a neighbour and rules out those that are ALPHA times nearer to it than to the node, and
    so on up to DEGREE. Then every edge also leads back, up to DEGREE more per node, nearest first.
    """
    n, v = len(v), v.astype(np.float32)
    r = np.random.default_rng(seed)
    near = min(NEAREST, n - 1)
    out = np.full((n, 2 * DEGREE), -1, np.int32)
    if near < 1:
        return out
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        sims = v[own] @ v.T
        sims[np.arange(len(own)), own] = -2
        close = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([close, r.integers(0, n, (len(own), RANDOM))], axis=1)
        to = np.take_along_axis(sims, cand, axis=1)
        vectors = v[cand]
        among = vectors @ vectors.transpose(0, 2, 1)
        alive = np.where(cand == own[:, None], -np.inf, to)
        lines = np.arange(len(own))
        for k in range(DEGREE):
            pick = alive.argmax(axis=1)
            ok = alive[lines, pick] > -np.inf
            if not ok.any():
                break
            out[own[ok], k] = cand[lines, pick][ok]
            ruled = ALPHA ** 2 * (1 - among[lines, pick]) <= 1 - to
            alive[ruled] = -np.inf
            alive[lines, pick] = -np.inf
            alive[cand == cand[lines, pick][:, None]] = -np.inf
    source, k = np.nonzero(out[:, :DEGREE] >= 0)
    target = out[source, k]
    sim = np.einsum("ij,ij->i", v[source], v[target])
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < DEGREE
    out[target[fits], DEGREE + place[fits]] = source[fits]
    return out


def range_search(asks: np.ndarray, own: np.ndarray, v: np.ndarray, graph: np.ndarray,
                 entries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in asks, node) of cosine >= threshold that greedy search with a widening range finds.

    From the medoids ``entries`` (and the asking row's own node, ``own`` >= 0) each query walks to its best
    unvisited node, BEAM of them kept; then the neighbours of every node within threshold - SLACK are looked
    at, and theirs, until the range holds nothing new. Found pairs are compared in double precision.
    """
    m, n = len(asks), len(v)
    q32, v32 = asks.astype(np.float32), v.astype(np.float32)
    seen = np.zeros((m, n), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def look(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Cosines of pairs seen for the first time; those in range are noted."""
        sim = np.einsum("ij,ij->i", q32[q], v32[node])
        inside = sim >= threshold - SLACK
        if inside.any():
            hits.append((q[inside], node[inside]))
        return sim

    start = np.concatenate([np.broadcast_to(entries, (m, len(entries))), own[:, None]], axis=1)
    width = BEAM + start.shape[1]
    beam = np.full((m, width), -1, np.int64)
    sims = np.full((m, width), -np.inf, np.float32)
    open_ = np.zeros((m, width), bool)

    def join(lines: np.ndarray, nodes: np.ndarray) -> None:
        """Look at unseen nodes of each line and keep the best in its beam."""
        ok = (nodes >= 0) & ~seen[lines[:, None], nodes]
        flat_q, flat_n = np.broadcast_to(lines[:, None], nodes.shape)[ok], nodes[ok]
        _, first = np.unique(flat_q * n + flat_n, return_index=True)
        keep = np.zeros(len(flat_q), bool)
        keep[first] = True
        where = np.argwhere(ok)[keep]
        if not len(where):
            return
        flat_q, flat_n = flat_q[keep], flat_n[keep]
        seen[flat_q, flat_n] = True
        new_sims = np.full(nodes.shape, -np.inf, np.float32)
        new_sims[where[:, 0], where[:, 1]] = look(flat_q, flat_n)
        all_sims = np.concatenate([sims[lines], new_sims], axis=1)
        all_nodes = np.concatenate([beam[lines], nodes], axis=1)
        all_open = np.concatenate([open_[lines], new_sims > -np.inf], axis=1)
        best = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
        for target, values in ((sims, all_sims), (beam, all_nodes), (open_, all_open)):
            target[lines, :BEAM] = np.take_along_axis(values, best, axis=1)

    join(np.arange(m), start)
    while True:
        ahead = np.where(open_[:, :BEAM], sims[:, :BEAM], -np.inf)
        pick = ahead.argmax(axis=1)
        lines = np.flatnonzero(ahead[np.arange(m), pick] > -np.inf)
        if not len(lines):
            break
        open_[lines, pick[lines]] = False
        join(lines, graph[beam[lines, pick[lines]]].astype(np.int64))
    done = 0
    while done < len(hits):
        todo, done = hits[done:], len(hits)
        for q, node in todo:
            for at in range(0, len(q), 8192):
                nodes = graph[node[at:at + 8192]].astype(np.int64)
                lines = np.broadcast_to(q[at:at + 8192, None], nodes.shape)
                ok = (nodes >= 0) & ~seen[lines, nodes]
                code = np.unique(lines[ok] * n + nodes[ok])
                if len(code):
                    seen[code // n, code % n] = True
                    look(code // n, code % n)
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, node = (np.concatenate(x) for x in zip(*hits, strict=True))
    exact = np.concatenate([np.einsum("ij,ij->i", asks[q[i:i + 65536]], v[node[i:i + 65536]])
                            for i in range(0, len(q), 65536)])
    return q[exact >= threshold], node[exact >= threshold]


def _searched(rows: DataFrame, threshold: float, overlap: int) -> DataFrame:
    """Rows ``(id, found, links, root)`` of unit rows ``(id, copies, v)`` by one build and search."""
    spark = rows.sparkSession
    n = rows.count()
    count = max(1, min(SAMPLE // 10, math.ceil(n * overlap / LOT)))
    picked = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(min(SAMPLE, 50 * count)).select("v")
    sample = [r["v"] for r in picked.collect()]
    shared = spark.sparkContext.broadcast(centroids(unit(np.array(sample)), count))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value
        for batch in batches:
            near = unit(matrix(batch.column(2))) @ centre.T if batch.num_rows else np.zeros((0, len(centre)))
            some = min(overlap, len(centre))
            shards = np.sort(np.argpartition(-near, some - 1, axis=1)[:, :some], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(shards.astype(np.int32)), pa.list_(pa.int32()))],
                ["id", "copies", "v", "shards"])

    dealt = settle(rows.select("id", "copies", "v")
                   .mapInArrow(assign, "id long, copies long, v array<double>, shards array<int>"), "dealt")
    placed = dealt.withColumn("shard", F.explode("shards"))
    sizes = settle(placed.groupBy("shard").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots")), "sizes")
    placed = placed.join(sizes, "shard").withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        graph = robust_graph(unit(matrix(table["v"])))
        return pa.table({"id": pa.array(ids), "near": pa.array([ids[g[g >= 0]] for g in graph], pa.list_(pa.int64()))})

    lists = (placed.select("shard", "lot", "id", "v").groupBy("shard", "lot")
             .applyInArrow(build, "id long, near array<long>"))
    flat = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = settle(placed.join(flat, "id"), "graph")
    other = F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    no_list = F.array().cast("array<bigint>")
    tasks = (nodes.select("shard", F.col("lot").alias("held"), other.alias("asking"), "id", "copies", "v",
                          "shards", "near", F.lit(True).alias("node"))
             .union(nodes.where("lots > 1").select("shard", other, "lot", "id", "copies", "v", "shards",
                                                   no_list, F.lit(False))))

    def search(table: pa.Table) -> pa.Table:
        held, asking, shard = table["held"][0].as_py(), table["asking"][0].as_py(), table["shard"][0].as_py()
        node = table["node"].to_numpy().astype(bool)
        ids, copies, v = table["id"].to_numpy(), table["copies"].to_numpy(), unit(matrix(table["v"]))
        shards = matrix(table["shards"]).astype(np.int64)
        inside = np.flatnonzero(node)
        inside = inside[np.argsort(ids[inside])]
        asks = inside if held == asking else np.flatnonzero(~node)
        if not len(inside) or not len(asks):
            return pa.table({name: pa.array([], pa.int64()) for name in ("id", "found", "links", "root")})
        lists = [np.array(x, np.int64) for x in table["near"].take(pa.array(inside)).to_pylist()]
        graph = np.full((len(inside), max(1, max(map(len, lists)))), -1, np.int32)
        for i, x in enumerate(lists):
            at = np.searchsorted(ids[inside], x)
            ok = ids[inside][np.minimum(at, len(inside) - 1)] == x  # neighbours of other shards live there
            graph[i, :ok.sum()] = at[ok]
        mean = v[inside].mean(axis=0)
        medoids = np.argsort(-(v[inside] @ mean))[:1]
        counted, linked, edges = np.zeros(len(asks), np.int64), np.zeros(len(asks), np.int64), []
        for start in range(0, len(asks), 256):
            some = asks[start:start + 256]
            at = np.minimum(np.searchsorted(ids[inside], ids[some]), len(inside) - 1)
            own = np.where(ids[inside][at] == ids[some], at, -1)
            q, found = range_search(v[some], own, v[inside], graph, medoids, threshold)
            other = ids[some][q] != ids[inside][found]
            q, found = q[other], found[other]
            edges.append(np.unique(np.stack([some[q], inside[found]], axis=1), axis=0))
            # A pair that shares several shards is counted in the first of them.
            a, b = shards[some][q], shards[inside][found]
            common = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int64).max)
            first = common.min(axis=1, initial=np.iinfo(np.int64).max) == shard
            counted[start:start + len(some)] = np.bincount(q[first], copies[inside][found[first]], len(some))
            linked[start:start + len(some)] = np.bincount(q[first], minlength=len(some))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        pairs = rank[np.concatenate(edges)] if edges else np.zeros((0, 2), np.int64)
        roots = np.array(_roots(len(ids), map(tuple, pairs.tolist())))
        touched = np.unique(np.concatenate([asks, pairs_ids(pairs, order)]))
        amount, links = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        amount[asks], links[asks] = counted, linked
        return pa.table({"id": pa.array(ids[touched]), "found": pa.array(amount[touched]), "links": pa.array(links[touched]),
                         "root": pa.array(ids[order[roots[rank[touched]]]])})

    found = tasks.groupBy("shard", "held", "asking").applyInArrow(search, "id long, found long, links long, root long")
    return settle(found, "found")


def pairs_ids(pairs: np.ndarray, order: np.ndarray) -> np.ndarray:
    return order[np.unique(pairs)] if len(pairs) else np.zeros(0, np.int64)


def true_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(id, links)``: to how many other rows the asked rows that have links are linked, by brute force.

    Rows are asked in the order of a hash, block after block, each against all rows, until AUDIT_ROWS of them have
    1 .. FEW links (a hot group's rows alone do not end it) or all rows have been asked.
    """
    spark, slices, at, few, parts = rows.sparkSession, 1 << 20, 0, 0, []
    n, size = rows.count(), 2 * AUDIT_ROWS
    place = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(slices))
    while at < slices and few < AUDIT_ROWS:
        to = at + max(1, math.ceil(min(size, ASKED) * slices / max(n, 1)))
        asked = rows.where((place >= at) & (place < to)).select("id", "v").collect()
        at, size = to, 2 * size
        if not asked:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in asked]), unit(np.array([r["v"] for r in asked]))))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, v = shared.value
            total = np.zeros(len(ids), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, TILE):
                    some = batch.slice(i, TILE)
                    near = unit(matrix(some.column(1))) @ v.T >= threshold
                    near &= some.column(0).to_numpy()[:, None] != ids[None, :]
                    total += near.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[total > 0]), pa.array(total[total > 0])], ["id", "links"])

        part = settle(rows.select("id", "v").mapInArrow(count, "id long, links long")
                      .groupBy("id").agg(F.sum("links").alias("links")), "true")
        few += part.where(F.col("links") <= FEW).count()
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def audit(true: DataFrame, found: DataFrame) -> float:
    """Mean over asked rows of the share of their links that was found; of rows with 1 .. FEW links and of the others, the lower.

    Each row counts once, whatever its links and copies, so neither a hot group nor the many rows around small groups hide the other.
    """
    got = found.groupBy("id").agg(F.sum("links").alias("got"))
    share = F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("links"))
    means = true.join(got, "id", "left").groupBy(F.col("links") <= FEW).agg(F.avg(share)).collect()
    return min((m for _, m in means), default=1.0)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place known to be connected) after the links a - b."""
    while True:
        a_to, b_to = label[a], label[b]
        apart = a_to != b_to
        if not apart.any():
            return label
        a, b, a_to, b_to = a[apart], b[apart], a_to[apart], b_to[apart]
        np.minimum.at(label, np.maximum(a_to, b_to), np.minimum(a_to, b_to))
        while (label[label] != label).any():
            label = label[label]


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(id, found, links, root)`` like those of ``_searched``, by comparing all pairs of unit rows.

    Rows are dealt to blocks by a hash of their id; each pair of blocks meets in one task, by tiles. The work
    is the square of the rows, the traffic rows times blocks. Only counts and one link per row leave a task.
    """
    blocks = math.ceil(rows.count() / BLOCK)
    own = rows.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int").alias("own"), "id", "copies", "v")
    grid = (own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "copies", "v"))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, v = table["id"].to_numpy(), table["copies"].to_numpy(), unit(matrix(table["v"]))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left, right = (np.flatnonzero(table["own"].to_numpy() == x) for x in (low, high))
        counted, linked, label = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(left), TILE):
            for j in range(0, len(right), TILE):
                a, b = left[i:i + TILE], right[j:j + TILE]
                q, found = np.nonzero(v[a] @ v[b].T >= threshold)
                q, found = a[q], b[found]
                q, found = q[q != found], found[q != found]
                counted += np.bincount(q, copies[found], len(ids)).astype(np.int64)
                linked += np.bincount(q, minlength=len(ids))
                if low != high:
                    counted += np.bincount(found, copies[q], len(ids)).astype(np.int64)
                    linked += np.bincount(found, minlength=len(ids))
                label = joined(label, q, found)
        touched = np.flatnonzero((counted > 0) | (low == high))
        return pa.table({"id": pa.array(ids[touched]), "found": pa.array(counted[touched]), "links": pa.array(linked[touched]),
                         "root": pa.array(ids[label[touched]])})

    return settle(grid.groupBy("low", "high").applyInArrow(work, "id long, found long, links long, root long"), "found")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, overlap: int = 3, key: str = "vec_id",
                    vector: str = "embedding", recall: float = AUDIT_RECALL) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one per key.

    Equal vectors are one node with a count. Nodes go to the ``overlap`` nearest of the clusters of a
    bounded sample; each shard's graph is built alone, the lists of a node from all its shards are
    united, and every node asks in all its shards by range-expanding greedy search over the united
    lists. A pair is counted in its first common shard. A shard beyond LOT rows is cut into lots, of
    which a task holds two. Tasks return counts and one link per row to the smallest id joined to it.
    An audit compares rows, until enough of them have links, with all rows and checks every pass by it; below ``recall`` the work is
    done again with twice the overlap. Where MOST_OVERLAP is not enough either, all rows are compared with
    all rows by blocks, which misses no link. Every link is confirmed in double precision.

    Vectors null, empty, zero, or with null or non-finite components have no links and are their own
    component. A key that repeats counts once, with its smallest usable vector; null keys are left
    out. Vectors of different lengths never link. Other columns are ignored. An empty table gives no rows.
    """
    keys = vectors.select(F.col(key).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    every = settle(usable(vectors, key, vector), "vectors")
    groups = settle(every.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "groups")
    parts = []
    for (dim,) in sorted(groups.select(F.size("v")).distinct().collect()):
        rows, width = groups.where(F.size("v") == dim), overlap
        true = true_links(rows, threshold)
        while True:
            found = _searched(rows, threshold, width)
            if audit(true, found) >= recall:
                break
            if width >= MOST_OVERLAP:
                found = compared(rows, threshold)
                break
            width *= 2
        parts.append(found)
    if not parts:
        return keys.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    links = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_node = (found.groupBy("id").agg(F.sum("found").alias("found"))
                .join(links.withColumnRenamed("node", "id"), "id", "left")
                .join(groups.select("id", "copies"), "id")
                .select(F.col("id").alias("node"), (F.col("found") + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "id").alias("component_id")))
    copied = groups.where("copies > 1").select("v", F.col("id").alias("first"))
    member = (every.join(copied, "v", "left")
              .select(F.col("id").alias("vec_id"), F.coalesce("first", "id").alias("node")))
    out = keys.join(member.join(per_node, "node"), "vec_id", "left")
    return (out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
