"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

1. Equal vectors are one node. A first graph joins each node to the nearest of its blocks under a few
   random projections; blocks are cut to a fixed size.
2. NN-descent: each node gathers a sample of its neighbours in both directions, of which some are new;
   neighbours of one node are compared with each other, and a pair that is nearer than the worst
   neighbour of either is offered to that one. The best ``degree`` stay. Rounds end when few
   neighbours change.
3. A query starts at its own node and expands the best unexpanded nodes of its list of ``width`` until
   all of them are expanded. Candidates are scored where their vectors are stored, place by place.

Every round is a set of joins, written to the shared folder. A node's neighbours and a query's list are
arrays of bounded length in one row, nearest first; offers to a list are arrays, too. A task merges the
lists of many nodes, or of many queries, as arrays at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import bucketed, forget, written
from tidewake.llm.vectors import digested, one_length, vector_classes

EDGES = "node long, nbr long, score double"
OFFERS = "node long, nbrs array<long>, scores array<double>"
GRAPH = "node long, cell long, nbrs array<long>, scores array<double>, new array<boolean>, drawn array<long>, fresh int, added int"
FOUND = "query long, nodes array<long>, scores array<double>"
NODES_AT_ONCE = 2048  # whose lists meet in one task's arrays
QUERIES_AT_ONCE = 64


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of arrays of one length."""
    values = _whole(column)
    return values.flatten().to_numpy().reshape(len(values), -1) if len(values) else np.empty((0, 0))


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as the bytes of their doubles, which move faster than arrays."""
    x = np.ascontiguousarray(x, np.float64)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = _whole(column)
    if not len(values):
        return np.empty((0, 0))
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.float64, (ends[-1] - ends[0]) // 8, int(ends[0])).reshape(len(values), -1)


def _ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of arrays, and how many each row has."""
    values = _whole(column)
    return values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy()) if len(values) else np.empty(0, np.int64)


def _arrays(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys, from 0."""
    begin = np.flatnonzero(_starts(*keys))
    return np.arange(len(keys[0])) - np.repeat(begin, np.diff(np.append(begin, len(keys[0]))))


def _lot(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A number for each pair by which it is drawn; it differs by round, so that all get their turn."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn + 1) * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def _first_graph(nodes: DataFrame, n: int, degree: int, trees: int, block: int, seed: int) -> DataFrame:
    """Offers of edges inside random blocks, a row for each node and tree; a block with more than ``block`` nodes is dealt into several by hash."""
    bits = max(0, int(math.log2(max(1, n / block * 2))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            planes = np.random.default_rng(seed).normal(size=(trees, x.shape[1], max(bits, 1)))
            codes = np.einsum("nd,tdb->tnb", x, planes, optimize=True) > 0
            keys = codes[:, :, :bits] @ (1 << np.arange(bits)) if bits else np.zeros(codes.shape[:2], np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([batch.column("rep"), _packed(x), pa.array(keys[t] * trees + t)], names=["rep", "vec", "key"])

    def link(table: pa.Table) -> pa.Table:
        ids, x = table.column("rep").to_numpy(), _unpacked(table.column("vec"))
        k = min(degree, len(ids) - 1)
        near, scores = np.empty((len(ids), k), np.int64), np.empty((len(ids), k))
        for lo in range(0, len(ids) if k else 0, 256):
            s = x[lo : lo + 256] @ x.T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            best = np.argpartition(s, len(ids) - k, axis=1)[:, len(ids) - k :]
            near[lo : lo + 256], scores[lo : lo + 256] = ids[best], np.take_along_axis(s, best, 1)
        counts = np.full(len(ids), k)
        return pa.table({"node": ids, "nbrs": _arrays(near.ravel(), counts), "scores": _arrays(scores.ravel(), counts)})

    coded = written(nodes.select("rep", "vec").mapInArrow(code, "rep long, vec binary, key long"), "codes", NODES_AT_ONCE)
    sizes = coded.groupBy("key").count().withColumn("pieces", F.ceil(F.col("count") / block))
    dealt = coded.join(sizes.select("key", "pieces"), "key").withColumn("piece", F.pmod(F.xxhash64("rep", "key"), F.col("pieces")))
    return dealt.groupBy("key", "piece").applyInArrow(link, OFFERS)


def _merged(held: pa.Table, offers: pa.Table, degree: int, sample: int, turn: int) -> pa.Table:
    """The rows of ``GRAPH`` of the nodes ``held`` with the best of what they have and are offered.

    Of each list at most ``sample`` new and as many old neighbours are drawn for the round ``turn``, the new ones (``fresh``
    of them) first; what is drawn isn't new any more.
    """
    held = held.take(pa.array(np.argsort(held.column("node").to_numpy())))
    names = held.column("node").to_numpy()
    (nbr, counts), score, new = _ragged(held.column("nbrs")), _ragged(held.column("scores"))[0], _ragged(held.column("new"))[0].astype(bool)
    at, kind = np.repeat(np.arange(len(names)), counts), new.astype(np.int8)
    if offers.num_rows:
        offered, many = _ragged(offers.column("nbrs"))
        at = np.append(at, np.repeat(np.searchsorted(names, offers.column("node").to_numpy()), many))
        nbr, score = np.append(nbr, offered), np.append(score, _ragged(offers.column("scores"))[0])
        kind = np.append(kind, np.full(len(offered), 2, np.int8))
    by = np.lexsort((kind, nbr, at))
    by = by[_starts(at[by], nbr[by])]  # what a node has goes before what it is offered again
    by = by[np.lexsort((nbr[by], -score[by], at[by]))]
    by = by[_ranks(at[by]) < degree]
    at, nbr, score, came, new = at[by], nbr[by], score[by], kind[by] == 2, kind[by] > 0
    by = np.lexsort((_lot(names[at], nbr, turn), ~new, at))
    drawn = by[_ranks(at[by], new[by]) < sample]
    fresh = np.bincount(at[drawn[new[drawn]]], minlength=len(names))
    left = new.copy()
    left[drawn] = False
    sizes, of = np.bincount(at, minlength=len(names)), np.bincount(at[drawn], minlength=len(names))
    added = np.bincount(at[came], minlength=len(names))
    return pa.table({"node": names, "cell": held.column("cell"), "nbrs": _arrays(nbr, sizes), "scores": _arrays(score, sizes), "new": _arrays(left, sizes), "drawn": _arrays(nbr[drawn], of), "fresh": fresh.astype(np.int32), "added": added.astype(np.int32)})


def _mates(edges: pa.Table, held: pa.Table, sample: int, turn: int) -> pa.Table:
    """(at, cell, of, new): for each node ``held`` the neighbours it drew and at most ``sample`` new and as many old nodes of ``edges`` (node, of, new) that drew it.

    Nodes with nothing new have no row.
    """
    held = held.take(pa.array(np.argsort(held.column("node").to_numpy())))
    names, (of, counts) = held.column("node").to_numpy(), _ragged(held.column("drawn"))
    at = np.repeat(np.arange(len(names)), counts)
    new = _ranks(at) < np.repeat(held.column("fresh").to_numpy(), counts)
    if edges.num_rows:
        there, back, fresh = np.searchsorted(names, edges.column("node").to_numpy()), edges.column("of").to_numpy(), edges.column("new").to_numpy(zero_copy_only=False).astype(bool)
        by = np.lexsort((_lot(back, names[there], turn), fresh, there))
        by = by[_ranks(there[by], fresh[by]) < sample]
        at, of, new = np.append(at, there[by]), np.append(of, back[by]), np.append(new, fresh[by])
    by = np.lexsort((~new, of, at))
    by = by[_starts(at[by], of[by])]
    at, of, new = at[by], of[by], new[by]
    some = np.bincount(at[new], minlength=len(names)) > 0
    kept = some[at]
    return pa.table({"at": names[some], "cell": held.column("cell").filter(pa.array(some)), "of": _arrays(of[kept], np.bincount(at, minlength=len(names))[some]), "new": _arrays(new[kept], np.bincount(at, minlength=len(names))[some])})


def _lists(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, begun): the partners of each key as structs (away, ``other``), nearest first; ``away`` is the score with its sign turned."""
    return edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), F.col(other).alias(other)))).alias("begun"))


def _placed(nodes: DataFrame, n: int, sizes: dict[str, int], seed: int) -> DataFrame:
    """(node, vec), vectors as bytes, and for each name of ``sizes`` the number of a place of at most about so many nodes, near vectors together.

    A place is a code of random projections; where too many nodes share one, they are dealt out by hash.
    """
    most = {c: max(0, int(math.log2(max(1, n / size * 2)))) for c, size in sizes.items()}
    bits = max(1, *most.values())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), _packed(x), pa.array((x @ planes > 0) @ (1 << np.arange(bits)))], names=["node", "vec", "code"])

    out = written(nodes.select("rep", "vec").mapInArrow(code, "node long, vec binary, code long"), "coded")
    for c, size in sizes.items():
        out = out.withColumn("_key", F.col("code").bitwiseAND((1 << most[c]) - 1))
        pieces = out.groupBy("_key").agg(F.ceil(F.count("*") / size).alias("_pieces"))
        dealt = F.col("_key") * (1 << 24) + F.pmod(F.xxhash64("node", "_key"), F.col("_pieces"))
        out = out.join(pieces, "_key").withColumn(c, dealt).drop("_key", "_pieces")
    return written(out.drop("code"), "places")


def _squares(lists: pa.Table, vectors: pa.Table, degree: int, at_once: int = 256) -> pa.Table:
    """For every node of ``lists`` (at, of, new) the pairs of its list that are new and nearer than the worst neighbour of their first.

    ``vectors`` has (listed, vec, worst) of all that is listed. Of each first at most ``degree`` pairs come back, the nearest.
    """
    if not lists.num_rows or not vectors.num_rows:
        return pa.table({"node": np.empty(0, np.int64), "nbrs": _arrays(np.empty(0, np.int64), np.empty(0, np.int64)), "scores": _arrays(np.empty(0), np.empty(0, np.int64))})
    ids, worst, x = vectors.column("listed").to_numpy(), vectors.column("worst").to_numpy(), _unpacked(vectors.column("vec"))
    order = np.argsort(ids)
    (of, counts), new = _ragged(lists.column("of")), _ragged(lists.column("new"))[0].astype(bool)
    of = order[np.searchsorted(ids[order], of)]
    ends = np.cumsum(counts)
    made = []
    for lo in range(0, len(ends), at_once):
        e, m = ends[lo : lo + at_once], counts[lo : lo + at_once]
        slots = (e - m)[:, None] + np.arange(m.max())
        there = slots < e[:, None]
        slots = np.where(there, slots, 0)
        who, fresh = of[slots], new[slots]
        g = x[who]
        scores = g @ g.transpose(0, 2, 1)
        k, i, j = np.nonzero(scores > np.where(there, worst[who], np.inf)[:, :, None])
        good = there[k, j] & (fresh[k, i] | fresh[k, j]) & (who[k, i] != who[k, j])
        k, i, j = k[good], i[good], j[good]
        pair, first = np.unique(who[k, i] * len(ids) + who[k, j], return_index=True)
        made.append((pair, scores[k, i, j][first]))
    pair, score = (np.concatenate(c) for c in zip(*made))
    pair, first = np.unique(pair, return_index=True)
    node, nbr, score = pair // len(ids), pair % len(ids), score[first]
    best = np.lexsort((nbr, -score, node))
    best = best[_ranks(node[best]) < degree]
    node, nbr, score = node[best], nbr[best], score[best]
    begin = np.flatnonzero(_starts(node))
    counts = np.diff(np.append(begin, len(node)))
    return pa.table({"node": ids[node[begin]], "nbrs": _arrays(ids[nbr], counts), "scores": _arrays(score, counts)})


def neighbour_graph(nodes: DataFrame, *, degree: int = 32, sample: int = 14, trees: int = 6, block: int = 2048, rounds: int = 6, stop: float = 0.02, seed: int = 7) -> DataFrame:
    """(node, nbr, score): about the ``degree`` nearest nodes of each node of ``nodes`` (rep, vec).

    The lists of nodes that lie near each other are compared in one task, as they share most of what
    they list: a vector moves once to each such place in a round, not once for each list it is in.
    Places grow with the table up to ``block`` nodes, so that the copies of a vector don't.
    Lists and offers move as arrays, to tasks that each merge those of many nodes.
    """
    n = nodes.count()
    placed = _placed(nodes, n, {"cell": min(block, max(64, n // 32))}, seed + 1)
    buckets = max(1, math.ceil(n / NODES_AT_ONCE))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))

    def merged(held: DataFrame, offers: DataFrame, turn: int) -> DataFrame:
        return written(held.groupBy(bucket("node")).cogroup(offers.groupBy(bucket("node"))).applyInArrow(lambda h, o: _merged(h, o, degree, sample, turn), GRAPH), "graph", NODES_AT_ONCE)

    empty = lambda kind: F.array().cast(f"array<{kind}>")
    held = placed.select("node", "cell", empty("long").alias("nbrs"), empty("double").alias("scores"), empty("boolean").alias("new"))
    graph = merged(held, _first_graph(nodes, n, degree, trees, block, seed), 0)
    for turn in range(rounds):
        edges = graph.select(F.col("node").alias("of"), "fresh", F.posexplode("drawn").alias("i", "node")).select("node", "of", (F.col("i") < F.col("fresh")).alias("new"))
        held = graph.select("node", "cell", "drawn", "fresh")
        lists = edges.groupBy(bucket("node")).cogroup(held.groupBy(bucket("node"))).applyInArrow(lambda e, h: _mates(e, h, sample, turn), "at long, cell long, of array<long>, new array<boolean>")
        lists = written(lists, "lists", NODES_AT_ONCE)
        worst = F.when(F.size("scores") < degree, F.lit(-math.inf)).otherwise(F.element_at("scores", -1))
        near = placed.select("node", "vec").join(graph.select("node", worst.alias("worst")), "node").withColumnRenamed("node", "listed")
        wanted = lists.select(F.col("cell").alias("place"), F.explode("of").alias("listed")).distinct().join(near, "listed").select("place", "listed", "vec", "worst")
        offers = lists.groupBy("cell").cogroup(wanted.groupBy("place")).applyInArrow(lambda a, v: _squares(a, v, degree), OFFERS)
        before, graph = graph, merged(graph.select("node", "cell", "nbrs", "scores", "new"), offers, turn + 1)
        forget(before, lists)
        if (graph.agg(F.sum("added")).first()[0] or 0) <= stop * degree * n:
            break
    return graph.select("node", F.explode(F.arrays_zip("nbrs", "scores")).alias("x")).select("node", F.col("x.nbrs").alias("nbr"), F.col("x.scores").alias("score"))


def _unseen(near: pa.Table, asking: pa.Table) -> pa.Table:
    """A row for each query and place with the candidates ``nbrs`` of the query (``of``) that lie there (their ``areas``) and aren't in its list yet, each once."""
    asking = asking.take(pa.array(np.argsort(asking.column("query").to_numpy())))
    asks = asking.column("query").to_numpy()
    names, counts = _ragged(near.column("nbrs"))
    names, first, name = np.unique(names, return_index=True, return_inverse=True)
    where = _ragged(near.column("areas"))[0][first]
    who = np.repeat(np.searchsorted(asks, near.column("of").to_numpy()), counts)
    pair = np.sort(who * len(names) + name)
    pair = pair[_starts(pair)]
    known, counts = _ragged(asking.column("nodes"))
    known, holds = np.append(known, asks), np.append(np.repeat(np.arange(len(asks)), counts), np.arange(len(asks)))
    if len(names):
        spot = np.minimum(np.searchsorted(names, known), len(names) - 1)
        there = names[spot] == known
        pair = pair[np.isin(pair, holds[there] * len(names) + spot[there], invert=True)]
    who, name = pair // max(1, len(names)), pair % max(1, len(names))
    by = np.lexsort((where[name], who))
    who, name = who[by], name[by]
    begin = np.flatnonzero(_starts(who, where[name]))
    same = asking.take(pa.array(who[begin]))
    there = _arrays(names[name], np.diff(np.append(begin, len(name))))
    return pa.table({"area": where[name][begin], **{c: same.column(c) for c in ("query", "query_vec", "least")}, "nodes": there})


def _scored(rows: pa.Table, vectors: pa.Table, at_once: int = 8192) -> pa.Table:
    """(query, nodes, scores): of each row (query, query_vec, least, nodes) the nodes nearer than ``least``; ``vectors`` has (node, vec)."""
    query, least, q = rows.column("query").to_numpy(), rows.column("least").to_numpy(), _unpacked(rows.column("query_vec"))
    names, counts = _ragged(rows.column("nodes"))
    row, score = np.repeat(np.arange(len(query)), counts), np.empty(len(names))
    if len(names):
        ids, x = vectors.column("node").to_numpy(), _unpacked(vectors.column("vec"))
        order = np.argsort(ids)
        spot = order[np.searchsorted(ids[order], names)]
        for lo in range(0, len(names), at_once):
            part = slice(lo, lo + at_once)
            score[part] = np.einsum("nd,nd->n", x[spot[part]], q[row[part]])
    good = score > least[row]
    many = np.bincount(row[good], minlength=len(query))
    return pa.table({"query": query[many > 0], "nodes": _arrays(names[good], many[many > 0]), "scores": _arrays(score[good], many[many > 0])})


def _better(held: pa.Table, found: pa.Table, width: int, expand: int) -> pa.Table:
    """The lists ``held`` with what was ``found``: the best ``width``, of which the first ``expand`` that aren't done are ``open`` next. What was open is done."""
    held = held.take(pa.array(np.argsort(held.column("query").to_numpy())))
    asks = held.column("query").to_numpy()
    (node, counts), score, done = _ragged(held.column("nodes")), _ragged(held.column("scores"))[0], _ragged(held.column("done"))[0].astype(bool)
    at = np.repeat(np.arange(len(asks)), counts)
    if found.num_rows:
        names, counts = _ragged(found.column("nodes"))
        at = np.append(at, np.repeat(np.searchsorted(asks, found.column("query").to_numpy()), counts))
        node, score, done = np.append(node, names), np.append(score, _ragged(found.column("scores"))[0]), np.append(done, np.zeros(len(names), bool))
    by = np.lexsort((node, -score, at))
    by = by[_ranks(at[by]) < width]
    at, node, score, done = at[by], node[by], score[by], done[by]
    opened = np.flatnonzero(~done)
    opened = opened[_ranks(at[opened]) < expand]
    done[opened] = True
    sizes = np.bincount(at, minlength=len(asks))
    lists = {"nodes": _arrays(node, sizes), "scores": _arrays(score, sizes), "done": _arrays(done, sizes), "open": _arrays(node[opened], np.bincount(at[opened], minlength=len(asks)))}
    return pa.table({"query": asks, "query_vec": held.column("query_vec"), **lists})


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, *, start: DataFrame | None = None, width: int = 400, expand: int = 400, block: int = 4096, seed: int = 7) -> DataFrame:
    """(query, node, score): the best ``width`` nodes that greedy search finds for each of ``queries`` (rep), itself left out.

    Lists only get better and a node is expanded once, so the search ends. Vectors and lists of
    neighbours are dealt out once, into bucketed tables; a hop moves the queries to places where
    unseen candidates lie, which are few, as near vectors share a place and places grow with the table,
    from ``block`` nodes to 16 times as many. Lists are kept in shards of queries, as arrays.
    ``start`` is the result of a narrower search to go on from; without it a query begins with the
    neighbours of its own node.
    """
    n = nodes.count()
    placed = _placed(nodes, n, {"area": min(max(block, n // 32), 16 * block)}, seed + 2)
    # a row a node, wherever its neighbours lie: else a hop would make a row for each place of each open node
    links = graph.join(placed.select(F.col("node").alias("nbr"), "area"), "nbr").groupBy("node").agg(F.collect_list(F.struct("area", "nbr")).alias("ends")).select("node", F.col("ends.area").alias("areas"), F.col("ends.nbr").alias("nbrs"))
    begun = start if start is not None else graph.select(F.col("node").alias("query"), F.col("nbr").alias("node"), "score")
    asked = placed.join(queries.select(F.col("rep").alias("node")).distinct(), "node").select(F.col("node").alias("query"), F.col("vec").alias("query_vec"))
    begun = _lists(begun.join(asked.select("query"), "query", "left_semi"), "query", "node")
    shards = max(1, math.ceil(queries.count() / QUERIES_AT_ONCE))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    kept = "query long, query_vec binary, nodes array<long>, scores array<double>, done array<boolean>, open array<long>"

    def merged(held: DataFrame, found: DataFrame) -> DataFrame:
        return written(held.groupBy(shard("query")).cogroup(found.groupBy(shard("query"))).applyInArrow(lambda h, f: _better(h, f, width, expand), kept), "search", NODES_AT_ONCE)

    first = asked.join(begun, "query").select("query", "query_vec", F.col("begun.node").alias("nodes"), F.transform("begun.away", lambda x: -x).alias("scores"), F.transform("begun.away", lambda x: F.lit(False)).alias("done"))
    state = merged(first, nodes.sparkSession.range(0).select(F.col("id").alias("query"), F.array("id").alias("nodes"), F.array(F.lit(0.0)).alias("scores")))
    with bucketed(placed.select("area", "node", "vec"), "area") as stored, bucketed(links, "node") as adjacency:
        while not state.filter(F.size("open") > 0).isEmpty():
            least = F.when(F.size("nodes") < width, F.lit(-math.inf)).otherwise(F.element_at("scores", -1))
            near = state.select(F.col("query").alias("of"), F.explode("open").alias("node")).join(adjacency, "node").select("of", "areas", "nbrs")
            # a query's links meet as rows: collected into one they would be large, and many of them in a batch
            asking = state.filter(F.size("open") > 0).select("query", "query_vec", least.alias("least"), "nodes")
            unseen = near.groupBy(shard("of")).cogroup(asking.groupBy(shard("query"))).applyInArrow(_unseen, "area long, query long, query_vec binary, least double, nodes array<long>")
            found = unseen.groupBy("area").cogroup(stored.groupBy("area")).applyInArrow(lambda r, v: _scored(r, v), FOUND)
            before, state = state, merged(state.drop("open"), found)
            forget(before)
    return state.select("query", F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("query", F.col("x.nodes").alias("node"), F.col("x.scores").alias("score"))


def _ranked(rows: DataFrame, width: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "node"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= width).drop("_rank")


def audit_recall(nodes: DataFrame, found: DataFrame, queries: DataFrame, k: int, *, sample_rows: int = 128, seed: int = 29) -> float:
    """Share of the ``k`` best nodes of at most ``sample_rows`` queries (rep, vec), compared with all ``nodes``, that ``found`` (query, node) has.

    A node counts if it is as near as the k-th best, so that ties don't matter.
    """
    share = min(1.0, 2.0 * sample_rows / max(1, queries.count()))
    drawn = queries.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("rep", "vec").limit(sample_rows).toArrow()
    if not drawn.num_rows:
        return 1.0
    ids, q = drawn.column("rep").to_numpy(), _matrix(drawn.column("vec"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("rep").to_numpy()
            if len(names):
                scores = q @ _matrix(batch.column("vec")).T
                scores[ids[:, None] == names[None, :]] = -np.inf
                top = np.argpartition(-scores, min(k, len(names)) - 1, axis=1)[:, :k]
                value = np.take_along_axis(scores, top, 1)
                good = value > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(axis=1))), pa.array(names[top][good]), pa.array(value[good])], names=["query", "node", "score"])

    true = _ranked(nodes.select("rep", "vec").mapInArrow(best, "query long, node long, score double"), k)
    sampled = true.select("query").distinct()
    mine = _ranked(found.join(sampled, "query", "left_semi").select("query", "node", "score"), k)
    least = true.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = mine.join(least, "query").filter(F.col("score") >= F.col("least") - F.abs("least") * 1e-12).groupBy("query").agg(F.count("*").alias("f"))
    row = least.join(good, "query", "left").agg(F.sum("n").alias("n"), F.sum(F.coalesce(F.least("f", "n"), F.lit(0))).alias("f")).first()
    return 1.0 if not row.n else row.f / row.n


def nearest(vectors: DataFrame, *, k: int = 20, query_divisor: int = 20, degree: int = 32, width: int = 400, target: float = 0.95, worst: float = 0.9, widest: int = 1600, **build) -> DataFrame:
    """(query_id, rank, vec_id, score, recall): the k nearest rows of each row whose vec_id is divisible by ``query_divisor``.

    Nearness is the inner product in double precision, ties go to the smaller vec_id, the query's own
    row is left out. Null, zero and non-finite vectors, vectors of another length than most and null
    ids take no part; equal vectors are one node, from which the k + 1 smallest ids can be returned.
    Rows that share a vec_id and differ in the vector are answers of their own. With fewer than k
    candidates all of them are returned; an empty table gives an empty result. Columns besides
    vec_id and embedding are ignored, whatever their names. ``recall`` is measured on a bounded sample
    of queries against all rows, the same in all rows of the result: below ``target`` the search is
    done again with lists twice as wide, up to ``widest``; RuntimeError if it is below ``worst`` then.
    """
    vectors = one_length(vectors)
    classes = vector_classes(vectors, members=k + 1)
    nodes = classes.select("rep", "vec")
    graph = neighbour_graph(nodes, degree=degree, **build)
    rows = vectors.filter(F.col("vec_id") % query_divisor == 0)
    ids = digested(rows).select(F.col("vec_id").alias("query_id"), "digest").join(classes.select("digest", F.col("rep").alias("query")), "digest").select("query_id", "query")
    ids = written(ids, "queries")
    asked = classes.join(ids.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi")  # nodes that hold a query
    width, found = max(width, k), None
    while True:
        found = search(nodes, graph, asked.select("rep", "vec"), start=found, width=width)
        recall = audit_recall(nodes, found, asked, k)
        if recall >= target or width >= widest:
            break
        width *= 2
    if recall < worst:
        raise RuntimeError(f"the search found {recall:.3f} of the neighbours of a sample, even with lists of {width}")
    own = asked.select(F.col("rep").alias("query"), F.col("rep").alias("node"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x).alias("score"))
    best = _ranked(found.unionByName(own), k + 1)
    members = classes.select(F.col("rep").alias("node"), F.explode("members").alias("vec_id"))
    pairs = ids.join(best, "query").join(members, "node").filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(recall).alias("recall"))
