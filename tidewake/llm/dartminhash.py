"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is a weighted set: its shingles with their counts. Along an element's weight axis lie cells
[0, 1), [1, 2), [2, 4), ... Hashed darts fall on a cell as a Poisson process along the axis of ranks, as
many as its width asks for, each at a hashed weight; the same darts fall for every document. A document
has the darts below its weight and below a limit of rank, chosen so that about k ln k + 2k of them hit,
whatever its total weight. A hash sends each dart to one of k coordinates, and the dart of least rank
per coordinate is kept. Two documents agree in a coordinate with a probability equal to their weighted
Jaccard similarity.

Documents with equal shingles are one class, and classes are linked through bands of coordinates. Every
pair of classes that share a band and aren't connected otherwise is verified on its shingles: classes
with a pivot first, then the pairs of small bands. For large bands pairs are found by what sets them
apart from the band's pivot p. With D(x) the symmetric difference of x and p, x and y differ by exactly
the symmetric difference of D(x) and D(y), so that a linked pair shares
(|D(x)| - s |x| + |D(y)| - s |y|) / 2 of D at least, with s = (1 - t) / (1 + t). Pairs of which that
isn't positive are linked to p both. For the others it bounds from below how far into D(x), in an order
that all share, the first common element lies, and only those prefixes are joined. The order begins with
what p lacks, where edits differ most. Of what meets there, pairs are only written out if counts of D by
hash, which bound from above what two of them share, allow for as much. Pairs inside a component never are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import schema_of, small_batches, texts_of, unused, written
from tidewake.llm.components import components
from tidewake.llm.shingles import U64, mix, shingle_counts, shingle_units

GAP, COORDINATE, GOLDEN, WEIGHT = U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7), U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
UNITS = 1.0 / 2**64
CELLS = 256  # counts by hash of a set D
PART = 1 << 17  # units of the sets that meet around a pivot in one task


def dart_signatures(keys: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Least rank per coordinate for each weighted set: float64 of (sets, k). Sets without weight get infinities.

    ``keys`` and ``weights`` are the elements of the sets in turn, ``counts`` of them in each. Weights
    can be any numbers of 0 or more; of those much under 1 most darts miss, so scale them up.
    """
    out = np.full((len(counts), k), np.inf)
    flat, owner = out.reshape(-1), np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, weights, len(counts))
    limit = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(len(counts)), where=total > 0)
    cells = np.where(weights > 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))), weights > 0).astype(np.int64)
    if cells.max(initial=0) > 1:
        cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
        keys, weights, owner = np.repeat(keys, cells), np.repeat(weights, cells), np.repeat(owner, cells)
        width = np.exp2(np.maximum(cell - 1, 0))
        keys, low = np.where(cell > 0, mix(keys + cell.astype(U64) * WEIGHT), keys), np.where(cell > 0, width, 0.0)
    else:
        keys, weights, owner = keys[cells > 0], weights[cells > 0], owner[cells > 0]
        width, low = np.ones(len(keys)), np.zeros(len(keys))
    partly = weights < low + width
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        key, who, wide = keys[mine], owner[mine], width[mine]
        top, rank, nth = limit[who], np.zeros(len(key)), 0
        while len(key):
            nth += 1
            hit = mix(key + U64(nth * int(GAP) & (2**64 - 1)))
            # the next gap is -log(u) / width; the dart counts if rank + gap < top
            near = hit.astype(np.float64) > np.exp((rank - top) * wide) * 2.0**64
            key, who, top, wide, hit, mine = key[near], who[near], top[near], wide[near], hit[near], mine[near]
            rank = rank[near] - np.log(np.maximum(hit.astype(np.float64), 0.5) * UNITS) / wide
            cell = who * k + ((mix(hit ^ COORDINATE) >> U64(11)).astype(np.float64) * (k / 2.0**53)).astype(np.int64)
            if (edge := partly[mine]).any():
                inside = ~edge
                inside[edge] = low[mine[edge]] + wide[edge] * mix(hit[edge] ^ WEIGHT).astype(np.float64) * UNITS < weights[mine[edge]]
                np.minimum.at(flat, cell[inside], rank[inside])
            else:
                np.minimum.at(flat, cell, rank)
        todo &= np.isinf(out).any(axis=1)  # a coordinate without a dart: throw again, further
        limit[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One long for each band of coordinates, the band's number mixed in."""
    bits = signatures.view(U64).reshape(len(signatures), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=U64) * COORDINATE, bits.shape[:2]).copy()
    for r in range(bits.shape[2]):
        out = mix(out * GOLDEN + bits[:, :, r])
    return out.view(np.int64)


SKETCH = ("row long", "n long", "c1 long", "c2 long", "bands array<long>")


def sketches(docs: DataFrame, names: list[str], *, words: int = 5, bands: int = 32, rows: int = 6) -> DataFrame:
    """``docs`` with columns ``names`` for SKETCH: a number of the row, its number of shingles, two sums that equal multisets share, band keys (null without shingles)."""
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, "text", 1 << 20):
            texts = [t.decode().lower().encode() for t in texts_of(batch, "text")]
            keys, weights, counts = shingle_counts(texts, words)
            at, made = np.concatenate(([0], np.cumsum(counts))), band_keys(dart_signatures(keys, weights, counts, bands * rows), bands)
            sums = [np.concatenate(([U64(0)], np.cumsum(mix(keys ^ x) * weights.astype(U64))))[at] for x in (GAP, COORDINATE)]
            n = np.diff(np.concatenate(([0], np.cumsum(weights)))[at]).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), pa.array(made.reshape(-1)))
            flat = pc.if_else(pa.array(counts > 0), flat, pa.nulls(len(counts), flat.type))
            ids = pa.array(np.arange(number, number + len(counts)))
            number += len(counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids, pa.array(n), *(pa.array(np.diff(s).view(np.int64)) for s in sums), flat], names=[*kept, *names])

    more = ", ".join(f"`{name}` {field.split()[1]}" for name, field in zip(names, SKETCH))
    return docs.mapInArrow(run, f"{schema_of(docs)}, {more}")


def unit_lists(texts: DataFrame, words: int) -> DataFrame:
    """(node, units) of (node, text): the low 32 bits of the unit keys, sorted, as binary. Collisions change a similarity by under size / 2 ** 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            keys, counts = shingle_units([t.decode().lower().encode() for t in texts_of(batch, "text")], words)
            at, low = np.concatenate(([0], np.cumsum(counts))), keys.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.sort(low[i:j]).tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["node", "units"])

    return texts.select("node", "text").mapInArrow(run, "node long, units binary")


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(1, len(both) - common)


def _with_units(pairs: DataFrame, units: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the units x of column ``a`` and y of column ``b``; a hot node is best in ``b``, whose units are joined last."""
    left = units.select(F.col("node").alias(a), F.col("units").alias("x"))
    return pairs.join(left, a).join(units.select(F.col("node").alias(b), F.col("units").alias("y")), b)


def verified(pairs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """(a, b, linked): whether the pairs (a, b) reach ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(x, y) >= threshold for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "linked"])

    return _with_units(pairs, units, "a", "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _tested(pairs: DataFrame, before: DataFrame | None, units: DataFrame, threshold: float) -> DataFrame:
    """What is verified so far, with the new ones of ``pairs`` (a, b)."""
    pairs = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if before is None:
        return written(verified(pairs, units, threshold), "tested")
    new = verified(pairs.join(before.select("a", "b"), ["a", "b"], "left_anti"), units, threshold)
    return before.unionByName(written(new, "tested"))


def _members(rows: DataFrame) -> DataFrame:
    """(key, doc, m, p, company): the rows (key, doc) of keys that m > 1 documents share; p is the one with most company over all its keys."""
    counts = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = written(rows.join(counts, "key").select("key", "doc", "m"), "shared")
    company = shared.groupBy("doc").agg(F.sum("m").alias("company"))
    pivots = shared.join(company, "doc").groupBy("key").agg(F.max(F.struct("company", (-F.col("doc")).alias("minus"))).alias("best"))
    pivots = pivots.select("key", (-F.col("best.minus")).alias("p"), F.col("best.company").alias("company"))
    return written(shared.join(pivots, "key").select("key", "doc", "m", "p", "company"), "members")


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, p, c): members of the keys that hold several components, each with its pivots and its own component."""
    rows = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "p", F.coalesce("component", "doc").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    return rows.join(mixed, "key").select("doc", "p", "c").distinct()


DEALT = "p long, part int, doc long, c long, near boolean, slack double, counts binary, units array<long>, left array<int>"


def _met(around: DataFrame, units: DataFrame, threshold: float, most: int) -> DataFrame:
    """Of the groups (doc, p, c) around pivots, as one table (a, b, key): pairs (a, b) that may be linked, and members a of keys that more than ``most`` share.

    Every linked pair of one group and of different components is a pair here, or linked to p both, or in a key.
    """
    pivot = around.filter("doc = p").select("p", F.col("c").alias("pc")).distinct()
    sizes = units.select(F.col("node").alias("doc"), F.floor(F.length("units") / 4).alias("size"))
    parts = around.join(sizes, "doc").groupBy("p").agg(F.ceil(F.sum("size") / PART).cast("int").alias("parts")).join(pivot, "p")
    share = (1 - threshold) / (1 + threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in (f.split()[0] for f in DEALT.split(", "))}
            for p, doc, c, pc_, parts, x, y in zip(*(batch.column(k).to_pylist() for k in ("p", "doc", "c", "pc", "parts", "x", "y"))):
                x, y = np.frombuffer(x, np.uint32).astype(np.int64), np.frombuffer(y, np.uint32).astype(np.int64)
                apart = np.concatenate((np.setdiff1d(x, y), np.setdiff1d(y, x) + (1 << 32)))
                slack, edge = len(apart) - share * len(x), share * len(y)
                near = c == pc_ or slack <= edge  # connected with p
                need = max(1, math.ceil((slack + (edge if near else -edge)) / 2 - 1e-6))
                first = apart[: max(0, len(apart) - need + 1)]
                left = len(apart) - np.arange(len(first), dtype=np.int32)
                part = (mix(first.astype(np.uint64)) % U64(parts)).astype(np.int32)
                cells = np.bincount((mix(apart.astype(np.uint64)) >> U64(56)).astype(np.int64), minlength=CELLS)
                counts = np.minimum(cells, 65535).astype(np.uint16).tobytes()
                for k in np.unique(part).tolist():
                    mine = part == k
                    for name, value in zip(rows, (p, k, doc, c, near, slack, counts, first[mine], left[mine])):
                        rows[name].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, list[tuple[int, int]]] = {}  # by unit the rows that hold it, and how much of their D begins there
        hot, rows = set(), []
        salt = U64(mix(np.array([key[0].as_py()]).view(U64))[0])

        def out(a: list | np.ndarray, b: list | np.ndarray | None, keys: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if keys is None else pa.array(keys, pa.int64())], names=["a", "b", "key"])

        def name(unit: int) -> int:
            return int(mix(np.array([unit], np.uint64) * GOLDEN + salt).view(np.int64)[0])

        for batch in batches:
            members, keys = [], []
            for doc, c, near, slack, counts, units_, left in zip(*(batch.column(k).to_pylist() for k in ("doc", "c", "near", "slack", "counts", "units", "left"))):
                number = None
                for unit, rest in zip(units_, left):
                    if unit in hot:
                        members.append(doc)
                        keys.append(name(unit))
                        continue
                    if number is None:
                        number = len(rows)
                        rows.append((doc, c, near, slack, counts))
                    holders = at.setdefault(unit, [])
                    holders.append((number, rest))
                    if len(holders) > most:
                        hot.add(unit)
                        members += [rows[i][0] for i, _ in holders]
                        keys += [name(unit)] * len(holders)
                        at[unit] = []
            if members:
                yield out(members, None, keys)
        if not rows:
            return
        doc, c, near, slack, counts = zip(*rows)
        doc, c, near, slack, counts = np.array(doc), np.array(c), np.array(near), np.array(slack), np.frombuffer(b"".join(counts), np.uint16).reshape(-1, CELLS)
        full = counts.max(axis=1) == 65535  # its counts are no bound
        seen = [np.zeros(0, np.int64)]

        def alike(pairs: np.ndarray) -> np.ndarray:
            """Of the pairs those whose counts allow for as many common elements of D as linked ones have."""
            x, y = pairs // len(rows), pairs % len(rows)
            common = [np.minimum(counts[x[i : i + 8192]], counts[y[i : i + 8192]]).sum(axis=1, dtype=np.int64) for i in range(0, len(pairs), 8192)]
            return pairs[(np.concatenate([np.zeros(0, np.int64), *common]) + 1e-6 >= (slack[x] + slack[y]) / 2) | full[x] & full[y]]

        for holders in at.values():
            if len(holders) > 1:
                i, rest = (np.array(x) for x in zip(*holders))
                apart = (c[i][:, None] != c[i][None, :]) & ~(near[i][:, None] & near[i][None, :])
                good = np.triu(apart & ((slack[i][:, None] + slack[i][None, :]) / 2 <= np.minimum(rest[:, None], rest[None, :]) + 1e-6), 1)
                x, y = np.nonzero(good)
                if len(x):
                    seen.append(i[x] * len(rows) + i[y])
                    if sum(map(len, seen[1:])) > 1 << 20:  # the first ones have been looked at
                        seen = [np.union1d(seen[0], alike(np.setdiff1d(np.concatenate(seen[1:]), seen[0])))]
        pairs = np.union1d(seen[0], alike(np.setdiff1d(np.concatenate(seen[1:]), seen[0]))) if len(seen) > 1 else seen[0]
        if len(pairs):
            yield out(doc[pairs // len(rows)], doc[pairs % len(rows)], None)

    both = _with_units(around.join(parts, "p"), units, "doc", "p").select("p", "doc", "c", "pc", "parts", "x", "y")
    return both.mapInArrow(deal, DEALT).groupBy("p", "part").applyInArrow(meet, "a long, b long, key long")


def _clusters(members: DataFrame, units: DataFrame, threshold: float, small: int, most: int) -> DataFrame:
    """(node, component) of the documents of ``members`` that are linked to another."""
    best = members.groupBy("doc").agg(F.max(F.struct("company", (-F.col("p")).alias("minus"))).alias("best")).select("doc", (-F.col("best.minus")).alias("p"))
    tested = _tested(best.select(F.col("doc").alias("a"), F.col("p").alias("b")), None, units, threshold)
    ends = tested.filter("linked")
    label = best.join(ends, (F.greatest("doc", "p") == F.col("a")) & (F.least("doc", "p") == F.col("b"))).select("doc", F.col("p").alias("label"))
    rows = members.join(label, "doc", "left").select("key", "doc", "m", "p", F.coalesce("label", "doc").alias("c"))
    few = rows.filter(F.col("m") <= small)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, "key").filter("x.c < y.c").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    tested = _tested(pairs.unionByName(rows.filter((F.col("m") > small) & (F.col("c") != F.col("p"))).select(F.col("doc").alias("a"), F.col("p").alias("b"))), tested, units, threshold)
    found = components(tested.filter("linked"))
    members = members.filter(F.col("m") > small)
    while True:
        around = written(_open(members, found), "around")
        if around.isEmpty():
            return found
        met = written(_met(around, units, threshold, most), "met")
        pivots = around.select(F.col("doc").alias("a"), F.col("p").alias("b"))
        tested = _tested(met.filter("b is not null").select("a", "b").unionByName(pivots), tested, units, threshold)
        found = components(tested.filter("linked"))
        hot = met.filter("key is not null").select("key", F.col("a").alias("doc")).distinct()
        if hot.isEmpty():
            return found
        members, most = _members(hot), most * 2  # so that rounds are few


def clustered(docs: DataFrame, *, words: int, threshold: float, bands: int, rows: int, small: int, most: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` written with the columns of SKETCH; (n, c1, c2, component) of its texts; the names of the sketch's columns."""
    names = unused(docs, *(f.split()[0] for f in SKETCH))
    row, n, c1, c2, band = names
    base = written(sketches(docs, names, words=words, bands=bands, rows=rows), "sketches")
    classes = base.filter(F.col(n) > 0).groupBy(F.col(n).alias("n"), F.col(c1).alias("c1"), F.col(c2).alias("c2")).agg(F.min(row).alias("node"), F.first(band).alias("bands"))
    classes = written(classes, "classes")
    members = _members(classes.select(F.explode("bands").alias("key"), F.col("node").alias("doc")))
    wanted = members.select(F.col("doc").alias("node")).distinct()
    # a merge, whatever the sizes: neither side is bounded
    texts = base.select(F.col(row).alias("node"), F.col("text").alias("text")).join(wanted.hint("merge"), "node", "left_semi")
    found = _clusters(members, written(unit_lists(texts, words), "units"), threshold, small, most)
    return base, classes.join(found, "node", "left").select("n", "c1", "c2", F.coalesce("component", "node").alias("component")), names


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, small: int = 32, most: int = 512) -> DataFrame:
    """(doc_id, class_id, kept) for each row of ``docs``: class_id is the smallest doc_id linked to it, directly or not.

    Words are lower-cased runs without ASCII white space; similarity is the weighted Jaccard
    similarity of shingle counts. Null and empty texts (no words) are classes of their own. A row is
    known by its text: rows that share a doc_id and differ in text belong to the class of each text.
    A null doc_id is never a class_id while a row of the class has another; where none has, class_id
    is null and kept is true. Texts of any length are taken whole, one row in a task at a time. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    At ``threshold`` a pair is missed with probability (1 - threshold ** rows) ** bands, 6e-5 for the
    defaults. ``small`` and ``most`` say from what size on a key's documents are refined, not which
    pairs are found.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base, classes, (row, *same, _) = clustered(docs, words=words, threshold=threshold, bands=bands, rows=rows, small=small, most=most)
    base = base.select("doc_id", *same)
    ids = base.groupBy(*same).agg(F.min("doc_id").alias("least")).join(classes, same)
    least = ids.groupBy("component").agg(F.min("least").alias("class_id"))
    of_class = ids.join(least, "component").select(*same, "class_id", F.lit(True).alias("found"))
    out = base.join(of_class, same, "left")
    return out.select("doc_id", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")).withColumn("kept", F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).withColumn("kept", F.coalesce("kept", F.lit(False)))


def one_of_each(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, small: int = 32, most: int = 512) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row of the smallest doc_id (null last) stays, and every row without words.

    ``docs`` has doc_id and text; all columns come back as they are. Rows that share a doc_id are
    dropped only where their texts are near-duplicates; of equal rows one stays. An empty table stays empty.
    """
    base, classes, (row, *same, band) = clustered(docs, words=words, threshold=threshold, bands=bands, rows=rows, small=small, most=most)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("best")
    ids = base.groupBy(*same).agg(best).join(classes.withColumnsRenamed(dict(zip(("n", "c1", "c2"), same))), same)
    kept = ids.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return base.join(kept.hint("merge"), row, "left_semi").unionByName(base.filter(F.col(same[0]) == 0)).select(*docs.columns)
