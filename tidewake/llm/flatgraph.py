"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors are one node. Centroids are fitted on a bounded sample; a node belongs to the shards
   of its ``overlap`` nearest centroids, the nearest being its home. A shard with more than
   ``shard_rows`` nodes is dealt into pieces, which all stand for it.
2. In each piece the nodes get robust-pruned lists of neighbours; a node's lists of all pieces are united.
3. A vector is searched for in a piece by greedy search from the medoids of the connected parts of the
   piece's graph, and from what that finds by expansion: the neighbours of every node within the range,
   and a margin, are looked at until no new one is. Cosines are computed for nodes that the search
   looks at alone. Hits count only at home, so no pair counts twice.
4. Shards that a hit belongs to are searched next, until there are none. Links are counted in the
   tasks; what leaves them is one row for each vector, not one for each pair.
5. The recall is audited on a bounded sample against all vectors, half of it drawn from vectors with
   links; below ``target`` the search is widened to more shards. A recall under ``worst`` after the
   widest search is an error; the recall is returned beside the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import written
from tidewake.llm.components import components
from tidewake.llm.vectors import digested, one_length, usable, vector_classes

QUERIES = 4096  # most queries that meet a piece in one task


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _units(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centers)
    return centers


def robust_prune(x: np.ndarray, degree: int, alpha: float = 1.2, wide: int = 64) -> list[np.ndarray]:
    """For each row of ``x`` its pruned neighbours: a candidate goes if a kept one is nearer to it by the factor alpha."""
    n, out = len(x), []
    gram = x @ x.T
    for i in range(n):
        k = min(wide, n - 1)
        near = np.argpartition(-gram[i], k)[: k + 1] if k < n - 1 else np.arange(n)
        near = near[near != i]
        near = near[np.argsort(-gram[i][near], kind="stable")]
        far = np.maximum(0.0, 2 - 2 * gram[i][near])  # squared distances; alpha counts for distances
        among, alive, kept = np.maximum(0.0, 2 - 2 * gram[np.ix_(near, near)]), np.ones(len(near), bool), []
        for j in range(len(near)):
            if alive[j]:
                kept.append(near[j])
                if len(kept) == degree:
                    break
                alive &= alpha * alpha * among[j] > far
        out.append(np.array(kept, np.int64))
    return out


def medoids(x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The row nearest to the mean of each connected part of the graph ``lists`` over ``x``."""
    label, (a, k) = np.arange(len(x)), np.nonzero(lists >= 0)
    b = lists[a, k]
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    parts, label = np.unique(label, return_inverse=True)
    mean = np.zeros((len(parts), x.shape[1]))
    np.add.at(mean, label, x)
    order = np.lexsort((-np.einsum("nd,nd->n", x, mean[label]), label))
    return order[np.searchsorted(label[order], np.arange(len(parts)))]


def range_search(q: np.ndarray, x: np.ndarray, lists: np.ndarray, starts: np.ndarray, least: float, margin: float, beam: int) -> np.ndarray:
    """For each row of ``q`` its cosines with the rows of ``x`` that the search looks at, -inf for the others; lists has -1 for no neighbour."""
    n, m, beam = len(q), len(x), max(beam, len(starts))
    s, rows = np.full((n, m), -np.inf), np.arange(n)

    def look(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores the places (r, c) that are new, and returns them."""
        place = np.unique((r * m + c)[s[r, c] == -np.inf])
        r, c = place // m, place % m
        for i in range(0, len(r), 1 << 16):
            s[r[i : i + (1 << 16)], c[i : i + (1 << 16)]] = np.einsum("nd,nd->n", q[r[i : i + (1 << 16)]], x[c[i : i + (1 << 16)]])
        return r, c

    ids = np.full((n, beam), -1)
    ids[:, : len(starts)] = starts
    look(np.repeat(rows, len(starts)), np.tile(starts, n))
    done = ids < 0
    while True:
        best = np.where(done, -np.inf, s[rows[:, None], np.maximum(ids, 0)])
        pick = best.argmax(axis=1)
        live = np.flatnonzero(best[rows, pick] > -np.inf)
        if not len(live):
            break
        done[live, pick[live]] = True
        nbrs = lists[ids[live, pick[live]]]
        fresh = (nbrs >= 0) & (s[live[:, None], np.maximum(nbrs, 0)] == -np.inf)
        r, c = np.nonzero(fresh)
        look(live[r], nbrs[r, c])
        both = np.concatenate((ids[live], np.where(fresh, nbrs, -1)), axis=1)
        state = np.concatenate((done[live], ~fresh), axis=1)
        value = np.where(both >= 0, s[live[:, None], np.maximum(both, 0)], -np.inf)
        top = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
        ids[live], done[live] = np.take_along_axis(both, top, 1), np.take_along_axis(state, top, 1) | (np.take_along_axis(value, top, 1) == -np.inf)
    a, b = np.nonzero(s >= least - margin)
    many = max(1, (1 << 19) // lists.shape[1])  # lists of hubs are long
    while len(a):
        new = []
        for i in range(0, len(a), many):
            nbrs = lists[b[i : i + many]]
            r, c = np.nonzero(nbrs >= 0)
            r, c = look(a[i : i + many][r], nbrs[r, c])
            near = s[r, c] >= least - margin
            new.append((r[near], c[near]))
        a, b = (np.concatenate(z) for z in zip(*new))
    return s


def _roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least id of each place's component under the links (a, b) between places."""
    root = ids.copy()
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        if (root == before).all():
            break
    return root


FOUND = "query long, shard int, links long, reached array<int>, node long, root long"


class Index:
    """What ``build_index`` has made of nodes, and the shards that its nodes have been searched in so far."""

    def __init__(self, placed: DataFrame, pieces: DataFrame, stored: DataFrame, overlap: int, search: Callable[[pa.Table, pa.Table], pa.Table]):
        self.placed, self.pieces, self.stored, self.overlap, self.search = placed, pieces, stored, overlap, search
        self.visited: DataFrame | None = None
        self.found: DataFrame | None = None


def build_index(nodes: DataFrame, *, least: float = 0.9, overlap: int = 2, widest: int = 12, shard_rows: int = 2048, degree: int = 24, beam: int = 24, margin: float = 0.1, sample_rows: int = 20_000, most_shards: int = 4096, seed: int = 11) -> Index | None:
    """The shards of ``nodes`` (rep, vec, n), each node in its ``overlap`` nearest ones, with their graphs; None without nodes."""
    spark = nodes.sparkSession
    total = nodes.count()
    if not total:
        return None
    share = min(1.0, 1.2 * sample_rows / total)
    drawn = nodes.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("vec").limit(sample_rows).toArrow()
    if not drawn.num_rows:
        drawn = nodes.select("vec").limit(1).toArrow()
    shards = max(1, min(most_shards, math.ceil(total * overlap / (shard_rows / 2))))
    centers = spark.sparkContext.broadcast(fit_centroids(_units(_matrix(drawn.column("vec"))), shards))  # most_shards rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        for batch in batches:
            if batch.num_rows:
                s = _units(_matrix(batch.column("vec"))) @ c.T
                k = min(max(overlap, widest), c.shape[0])
                near = np.argsort(-s, axis=1, kind="stable")[:, :k].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * k), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec"), batch.column("n"), lists], names=["node", "vec", "n", "shards"])

    # ``shards`` has more shards than a node is stored in: a search can be widened to them
    placed = written(nodes.select("rep", "vec", "n").mapInArrow(assign, "node long, vec array<double>, n long, shards array<int>"), "placed")
    member = placed.select("node", "vec", "n", F.slice("shards", 1, overlap).alias("shards")).withColumn("shard", F.explode("shards"))
    pieces = member.groupBy("shard").count().select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("pieces"))
    member = written(member.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")), "members")

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        lists = robust_prune(_units(_matrix(table.column("vec"))), degree)
        return pa.table({"node": pa.array(np.repeat(ids, [len(x) for x in lists])), "nbr": pa.array(ids[np.concatenate(lists)] if len(lists) else ids[:0])})

    edges = member.groupBy("shard", "piece").applyInArrow(build, "node long, nbr long")
    both = edges.union(edges.select("nbr", "node")).groupBy("node").agg(F.collect_set("nbr").alias("nbrs"))
    stored = written(member.join(both, "node", "left").select("shard", "piece", "node", "vec", "n", "shards", "nbrs"), "stored")

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "links": pa.array([], pa.int64()), "reached": pa.array([], pa.list_(pa.int32())), "node": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not asked.num_rows or not there.num_rows:
            return empty
        there, asked = there.sort_by("node"), asked.sort_by("query")
        ids, x, q, qid = there.column("node").to_numpy(), _units(_matrix(there.column("vec"))), _units(_matrix(asked.column("query_vec"))), asked.column("query").to_numpy()
        shard, n = there.column("shard")[0].as_py(), there.column("n").to_numpy()
        within = _matrix(there.column("shards"))
        home = within[:, 0] == shard
        near = [np.array(sorted(o or ()), np.int64) for o in there.column("nbrs").to_pylist()]
        near = [np.searchsorted(ids, o[np.isin(o, ids)]) for o in near]
        lists = np.full((len(ids), max([1, *map(len, near)])), -1)
        for i, o in enumerate(near):
            lists[i, : len(o)] = o
        starts = medoids(x, lists)
        out = {k: [] for k in empty.column_names}
        for i in range(0, len(q), 512):
            s = range_search(q[i : i + 512], x, lists, starts, least, margin, beam)
            part = qid[i : i + 512]
            hit = (s >= least) & (part[:, None] != ids[None, :])
            links = (hit & home[None, :]).astype(np.int64) @ n
            a, b = np.nonzero(hit)
            names = np.unique(np.concatenate((part, ids)))
            roots = _roots(names, np.searchsorted(names, part[a]), np.searchsorted(names, ids[b]))
            out["query"] += part.tolist()
            out["links"] += links.tolist()
            most = int(within.max()) + 1
            pairs = np.unique((a[:, None] * most + within[b]).ravel())
            pairs = pairs[pairs % most != shard]
            ends = np.searchsorted(pairs // most, np.arange(len(part) + 1)).tolist()
            others = (pairs % most).tolist()
            out["reached"] += [others[e:f] for e, f in zip(ends, ends[1:])]
            out["node"] += part.tolist()
            out["root"] += roots[np.searchsorted(names, part)].tolist()
            extra = np.setdiff1d(ids[np.unique(b)], part)
            out["query"] += [None] * len(extra)
            out["links"] += [0] * len(extra)
            out["reached"] += [[]] * len(extra)
            out["node"] += extra.tolist()
            out["root"] += roots[np.searchsorted(names, extra)].tolist()
        out["shard"] = [shard] * len(out["node"])
        return pa.table({k: pa.array(v, empty.schema.field(k).type) for k, v in out.items()})

    return Index(placed, pieces, stored, overlap, search)


def search_links(index: Index, visit: int) -> tuple[DataFrame, DataFrame]:
    """(query, links) and edges (a, b) between nodes of one component: every node in its ``visit`` nearest shards, and in those that what it finds lies in.

    What earlier calls have found stays; only new visits are searched.
    """
    placed, pieces, stored = index.placed, index.pieces, index.stored
    vectors = placed.select(F.col("node").alias("query"), F.col("vec").alias("query_vec"))
    todo = placed.select(F.col("node").alias("query"), F.explode(F.slice("shards", 1, visit)).alias("shard"))
    if index.visited is not None:
        todo = todo.join(index.visited, ["query", "shard"], "left_anti")
    while True:
        todo = written(todo, "visits")
        if todo.isEmpty():
            break
        index.visited = todo if index.visited is None else index.visited.unionByName(todo)
        meet = todo.join(pieces, "shard").join(vectors, "query").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        many = todo.groupBy("shard").count().select("shard", F.ceil(F.col("count") / QUERIES).cast("int").alias("turns"))
        meet = meet.join(many, "shard").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).select("shard", "piece", "turn", "query", "query_vec")
        there = stored.join(many, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        keys = ["shard", "piece", "turn"]
        new = written(meet.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(index.search, FOUND), "found")
        index.found = new if index.found is None else index.found.unionByName(new)
        todo = new.filter("query is not null").select("query", F.explode("reached").alias("shard")).distinct().join(index.visited, ["query", "shard"], "left_anti")
    counts = index.found.filter("query is not null").groupBy("query").agg(F.sum("links").alias("links"))
    return counts, index.found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def link_counts(nodes: DataFrame, *, overlap: int = 2, **build) -> tuple[DataFrame, DataFrame]:
    """(query, links) and edges (a, b) between nodes of one component, for ``nodes`` (rep, vec, n), searched in as many shards as they are stored in."""
    index = build_index(nodes, overlap=overlap, **build)
    if index is None:
        return nodes.sparkSession.createDataFrame([], "query long, links long"), nodes.sparkSession.createDataFrame([], "a long, b long")
    return search_links(index, overlap)


def lower_bound(hits: int, of: int, z: float = 1.96) -> float:
    """Wilson's lower bound of a share of which ``hits`` of ``of`` were seen; 0 without any."""
    if not of:
        return 0.0
    p = hits / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def audit_recall(nodes: DataFrame, counts: DataFrame, *, least: float = 0.9, sample_rows: int = 512, most_rows: int = 8192, links: int = 4000, seed: int = 23) -> tuple[int, int, bool]:
    """(found, true) links of a uniform draw of nodes, compared with all nodes, and whether that were all nodes.

    ``sample_rows`` nodes are drawn whatever the search has found for them, and twice as many again until they have ``links`` true links or
    are ``most_rows``. Found links are true ones (the search compares the same cosines) and each counts once, so their number says which part was found.
    """
    total, rows = nodes.count(), sample_rows
    while True:
        share = min(1.0, 1.2 * rows / max(1, total))
        drawn = nodes.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("rep", "vec").limit(rows).toArrow()
        if not drawn.num_rows:
            return 0, 0, not total
        ids, q = drawn.column("rep").to_numpy(), _units(_matrix(drawn.column("vec")))

        def count(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            true = np.zeros(len(ids), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, names, n = _units(_matrix(batch.column("vec"))), batch.column("rep").to_numpy(), batch.column("n").to_numpy()
                    for i in range(0, len(ids), 1024):
                        hit = (q[i : i + 1024] @ x.T >= least) & (ids[i : i + 1024, None] != names[None, :])
                        true[i : i + 1024] += hit.astype(np.int64) @ n
            some = np.flatnonzero(true)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(true[some])], names=["query", "true"])

        true = nodes.select("rep", "vec", "n").mapInArrow(count, "query long, true long").groupBy("query").agg(F.sum("true").alias("true"))
        row = true.join(counts, "query", "left").agg(F.sum("true").alias("t"), F.sum(F.coalesce("links", F.lit(0))).alias("f")).first()
        if (row.t or 0) >= links or rows >= most_rows or share >= 1.0:
            return row.f or 0, row.t or 0, len(ids) == total
        rows *= 2


def near_vectors(vectors: DataFrame, *, least: float = 0.9, overlap: int = 3, target: float = 0.999, sure: float = 0.99, worst: float = 0.9, widest: int = 12, **build) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of ``vectors``.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null vec_id,
    link with nothing (component_id is their own vec_id); so do vectors of another length than most,
    which have no cosine with them. Rows of equal vectors
    link with each other and count each. Labels and other columns are ignored, whatever their names;
    rows that share a vec_id are vectors of their own, each with the component of its vector. An empty
    table gives an empty result. ``recall`` is what the audit found, the same in all rows. The search is widened, up to ``widest``
    shards, while that is below ``target`` or its lower bound (95 % on each side) below ``sure``, unless all nodes were drawn; RuntimeError
    if it is below ``worst`` then. ``build`` goes to ``build_index``.
    """
    vectors = one_length(vectors)
    ids = written(digested(vectors).select("vec_id", "digest"), "ids")
    nodes = vector_classes(vectors)
    index, visit, recall = build_index(nodes, least=least, overlap=overlap, widest=widest, **build), overlap, 1.0
    counts, edges = link_counts(nodes.limit(0))
    while index is not None:
        counts, edges = search_links(index, visit)
        counts = written(counts, "counts")
        hits, of, whole = audit_recall(nodes, counts, least=least)
        recall = 1.0 if not of else hits / of
        if visit >= widest or (recall >= target and (whole or lower_bound(hits, of) >= sure)):
            break
        visit = min(2 * visit, widest)
    if recall < worst:
        raise RuntimeError(f"the search found {recall:.3f} of the links of a sample, even in {visit} shards")
    found = components(edges)
    per = nodes.join(counts, F.col("rep") == F.col("query"), "left").join(found, F.col("rep") == F.col("node"), "left")
    per = per.select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    per = per.join(per.groupBy("c").agg(F.min("least").alias("component_id")), "c")
    linked = ids.join(per, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = vectors.filter(~(usable() & F.col("vec_id").isNotNull())).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "recall": F.lit(recall)})
