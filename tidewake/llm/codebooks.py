"""Vector code compression: codebooks by position of a vector's parts, with kd-trees for the nearest entries.

Components become integers, floor(1024 x), and vectors are cut into equal consecutive parts. Each part
position has a codebook. A round sends the codebooks' kd-trees to all tasks, assigns every part to its
nearest entry there, and adds up integers by (position, entry): at most parts x entries rows leave a task
and as many reach the driver, however many vectors there are. All arithmetic is on integers, so results depend neither
on how rows are dealt to tasks nor on their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import unused, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf of a tree.
LEAF = 8
#: Vectors searched for side by side.
BATCH = 4096


class KdTree:
    """Nearest entries of a codebook by branch and bound, for many parts at once.

    A node is split at the median of its widest dimension and knows the box around its entries. A node
    is left out for a part only if its box is farther than the nearest entry found: one at
    an equal distance is visited, as it may hold an entry of a lower index.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._node(np.arange(len(entries))) if len(entries) else None

    def _node(self, members: np.ndarray) -> tuple:
        rows = self.entries[members]
        low, high = rows.min(axis=0), rows.max(axis=0)
        if len(members) <= LEAF or (low == high).all():
            return low, high, np.sort(members), None, None
        order = np.argsort(rows[:, int(np.argmax(high - low))], kind="stable")
        half = len(members) // 2
        return low, high, None, self._node(members[order[:half]]), self._node(members[order[half:]])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of each row; of equally near entries the lowest index."""
        best, found = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), -1, np.int64)
        if len(parts):
            self._visit(self.root, parts, np.arange(len(parts)), best, found)
        return found, best

    @staticmethod
    def _gap(node: tuple, parts: np.ndarray) -> np.ndarray:
        d = np.maximum(np.maximum(node[0] - parts, parts - node[1]), 0)
        return np.einsum("ij,ij->i", d, d)

    def _visit(self, node: tuple, parts: np.ndarray, at: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """``at`` are the rows of ``parts`` whose box distance to ``node`` doesn't rule it out."""
        _, _, members, left, right = node
        if members is not None:
            x, near, who = parts[at], best[at], found[at]
            for i in members:
                d = x - self.entries[i]
                d = np.einsum("ij,ij->i", d, d)
                better = (d < near) | ((d == near) & (i < who))
                near[better], who[better] = d[better], i
            best[at], found[at] = near, who
            return
        x = parts[at]
        gaps = self._gap(left, x), self._gap(right, x)
        first = gaps[0] <= gaps[1]
        for near, far, mine in ((0, 1, first), (1, 0, ~first)):
            for side in (near, far):  # what the near side found may rule the far one out
                go = mine & (gaps[side] <= best[at])
                if go.any():
                    self._visit((left, right)[side], parts, at[go], best, found)


def kept_vectors(vectors: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """The rows whose vector isn't null or empty and has no null or non-finite component."""
    sound = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & sound, F.lit(False)))


def bound_of(wide: int) -> int:
    """The largest integer that a component may be: squared distances of ``wide`` components stay under 2^62."""
    return 1 << (62 - (wide - 1).bit_length()) // 2 - 1


def as_integers(embedding: Column, length: int, wide: int) -> Column:
    """floor(SCALE x) of the first ``length`` components, ``bound_of(wide)`` at most in magnitude, padded with zeros to ``wide`` ones."""
    most = float(bound_of(wide))
    whole = F.transform(F.slice(embedding, 1, length), lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(most)), F.lit(-most))))
    return F.slice(F.concat(whole, F.array_repeat(F.lit(0).cast("long"), wide)), 1, wide)


def _matrix(batch: pa.RecordBatch, column: str, wide: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, wide)


def _trees(books: np.ndarray) -> list[KdTree]:
    return [KdTree(book) for book in books]


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, total): count and sum of components of the parts nearest to each entry, added up in each task."""
    parts, entries, deep = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(_trees(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, deep), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.slice(start, BATCH), "whole", parts * deep)
                for p, tree in enumerate(shared.value):
                    mine = x[:, p * deep : (p + 1) * deep]
                    at, _ = tree.nearest(mine)
                    n[p] += np.bincount(at, minlength=entries)
                    np.add.at(total[p], at, mine)
        p, e = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * deep, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), lists], names=["part", "entry", "n", "total"])

    partial = rows.select("whole").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(deep))).alias("total"))


def learn(rows: DataFrame, order: list[Column], parts: int, entries: int, rounds: int, wide: int) -> np.ndarray:
    """Codebooks (parts, entries, components) of ``rows`` (with ``whole``) after ``rounds`` rounds; they start with the first rows of ``order``."""
    first = [r.whole for r in rows.orderBy(*order).limit(entries).select("whole").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, wide // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        for r in _sums(rows, books).collect():  # a row for each entry in use
            books[r.part, r.entry] = np.array(r.total, np.int64) // r.n
    return books


def compress(vectors: DataFrame, *, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vectors`` with code, error, label_error and codebooks_sha256: every column and row whose vector can be coded.

    Rows whose vector is null, empty or has a null or non-finite component go; zero vectors stay. ``code``
    has two hex digits a part (at most 256 entries), ``error`` is the sum of the parts' squared
    distances to their entries, ``label_error`` its sum over equal labels (null is a label). Codebooks start with
    the vectors of the smallest ids (null ids come last; rows that share an id are ordered by their integers), so
    fewer rows than ``entries`` give as many entries. Of equally near entries the lowest index counts, and unused entries stay. The
    most frequent length of a vector is that of all (the longest of equally frequent ones): others are cut or padded with
    zeros to it, as is a length that ``parts`` doesn't divide, at its end. Integers beyond ``bound_of``
    (2^27 for 64 components) count as that bound, and a ``label_error`` beyond 64 bits is null. Repeated rows each count and
    each come back; columns named like the result's are replaced; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits a part")
    spark = vectors.sparkSession
    kept = kept_vectors(vectors.drop("code", "error", "label_error", "codebooks_sha256"), id_col, embedding)
    length = kept.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    length = length.d if length else parts
    wide = -(-length // parts) * parts
    whole, at_label, total = unused(vectors, "whole", "at_label", "total_error")
    rows = kept.withColumn(whole, as_integers(F.col(embedding), length, wide))
    books = learn(rows.select(F.col(id_col).alias("id"), F.col(whole).alias("whole")), [F.asc_nulls_last("id"), F.asc("whole")], parts, entries, rounds, wide)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared, deep = spark.sparkContext.broadcast(_trees(books)), wide // parts
    kinds = {f.name: f.dataType for f in rows.schema if f.name != whole}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                x, codes, error = _matrix(piece, whole, wide), np.empty((piece.num_rows, parts), np.uint8), np.zeros(piece.num_rows, np.int64)
                for p, tree in enumerate(shared.value):
                    codes[:, p], far = tree.nearest(x[:, p * deep : (p + 1) * deep])
                    error += far
                text = codes.tobytes().hex()
                kept_columns = [piece.column(c) for c in kinds]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], names=[*kinds, "code", "error"])

    schema = rows.drop(whole).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    coded = written(rows.mapInArrow(run, schema), "codes", BATCH)
    # labels are as many as the data has, so their sums are joined by what they turn out to be: a hot label's rows are split
    errors = coded.groupBy(F.col(label).alias(at_label)).agg(F.try_sum("error").alias(total))
    joined = coded.join(errors, F.col(label).eqNullSafe(F.col(at_label)))
    return joined.select(*coded.columns, F.col(total).alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
