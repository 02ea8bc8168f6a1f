"""Document fingerprints: digests of a text's improbable byte windows, in chained Bloom filters.

Every window of WINDOW bytes has an entropy, and a window is the rarer the fewer windows of the corpus have its entropy. In
each neighbourhood of NEAR windows the rarest one (the leftmost of equally rare ones) gets a point; windows of
POINTS points are features. A feature's hash sets five bits of a Bloom filter of 2,048 bits; a filter takes
FEATURES features, then the next one of the chain begins. Two filters are compared by the bits they share, less those that
they would share by chance.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import small_batches, texts_of, unused

WINDOW, NEAR, POINTS, FEATURES = 32, 32, 8, 160
#: Entropies in thousandths of the largest one. Windows under DULL are never features.
LEVELS, DULL = 1001, 100
BITS, HASHES = 2048, 5
#: c log2 c for c bytes of a kind in a window, in integers, so that sums are exact.
WEIGHT = np.array([0] + [round(c * np.log2(c) * 2**20) for c in range(1, WINDOW + 1)], np.int64)
MORE = np.diff(WEIGHT)
#: Windows whose entropies are found at once; bytes of texts that are fingerprinted at once.
STRETCH, BATCH = 1 << 17, 2 << 20
#: A window that isn't one: it reaches out of its text, or is dull.
NONE = np.int64(LEVELS)
#: Of the shared bits beyond chance, the share that doesn't count.
CUT = 0.3


def entropies(buffer: np.ndarray) -> np.ndarray:
    """Entropy of each window of ``buffer`` in thousandths of the largest, 0 to 1000; a function of the window's bytes alone."""
    n = len(buffer) - WINDOW + 1
    out = np.empty(max(n, 0), np.int64)
    for at in range(0, n, STRETCH):
        b = buffer[at : at + STRETCH + WINDOW - 1]
        before, after = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)  # equal bytes among the WINDOW - 1 neighbours
        for d in range(1, min(WINDOW, len(b))):
            equal = (b[d:] == b[:-d]).view(np.uint8)
            before[d:] += equal
            after[:-d] += equal
        m = len(b) - WINDOW + 1
        sums = np.empty(m, np.int64)
        sums[0] = WEIGHT[np.bincount(b[:WINDOW], minlength=256)].sum()
        sums[1:] = MORE[before[WINDOW:]] - MORE[after[: m - 1]]  # a byte enters, one leaves
        sums = np.cumsum(sums)
        top = WINDOW * int(np.log2(WINDOW)) << 20
        out[at : at + m] = (top - sums) * (LEVELS - 1) // top
    return out


def in_one_text(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` windows lies inside one of the texts that begin at ``offsets``."""
    inside = np.ones(max(n, 0), bool)
    for o in offsets[1:-1]:
        inside[max(0, o - WINDOW + 1) : o] = False
    return inside


def entropy_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Windows by entropy over all of ``docs``: LEVELS integers, added up in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for piece in small_batches([batch], "text", BATCH):
                texts = texts_of(piece, "text")
                buffer = np.frombuffer(b"".join(texts), np.uint8)
                made = entropies(buffer)
                total += np.bincount(made[in_one_text(np.append(0, np.cumsum([len(t) for t in texts])), len(made))], minlength=LEVELS)
        level = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(total[level])], names=["level", "n"])

    total = np.zeros(LEVELS, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        total[r.level] = r.n
    return total


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest 0, ties by entropy; NONE for dull ones."""
    out = np.empty(LEVELS, np.int64)
    out[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    out[:DULL] = NONE
    return out


def features(buffer: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the features of ``buffer``, whose windows have ``rank``; windows of rank NONE between two texts keep them apart.

    Neighbourhoods at the ends of a text hold fewer windows, so that every window is in NEAR of them.
    """
    n = len(rank)
    points = np.zeros(n, np.uint8)
    for at in range(0, n + NEAR - 1, STRETCH):  # neighbourhoods that end before window at + 1, at + 2, ...
        low = at - NEAR + 1
        here = np.full(min(STRETCH, n + NEAR - 1 - at) + NEAR - 1, NONE)
        a, b = max(low, 0), min(low + len(here), n)
        here[a - low : b - low] = rank[a:b]
        key = here << 32 | np.arange(len(here))  # the smallest is the leftmost of the rarest
        whole = np.full(-(-len(key) // NEAR) * NEAR, NONE << 32)
        whole[: len(key)] = key
        rows = whole.reshape(-1, NEAR)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(key) - NEAR + 1
        least = np.minimum(behind[:m], ahead[NEAR - 1 : NEAR - 1 + m])
        best = (least & 0xFFFFFFFF)[least >> 32 < NONE]
        got = np.bincount(best, minlength=len(here)).astype(np.uint8)
        points[a:b] += got[a - low : b - low]
    return np.flatnonzero(points >= POINTS)


class Digest:
    """The chain of filters of a text: (filters, 32) integers of 64 bits, and the bits set in each."""

    __slots__ = ("chain", "bits")

    def __init__(self, chain: np.ndarray) -> None:
        self.chain, self.bits = chain, np.bitwise_count(chain).sum(axis=1, dtype=np.int64)

    def __str__(self) -> str:
        """The chain as text: its number of filters, a colon, and their bytes in base64."""
        return f"{len(self.chain)}:{base64.b64encode(self.chain.tobytes()).decode()}"

    @classmethod
    def read(cls, text: str) -> Digest:
        return cls(np.frombuffer(base64.b64decode(text.partition(":")[2]), "<u8").reshape(-1, BITS // 64))


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: the bits shared beyond chance by each filter of the shorter chain and its best match, weighted by bits; chains of equal length are taken both ways.

    1 for equal chains, of empty texts too; an empty chain is like no other.
    """
    if a.chain.shape == b.chain.shape and (a.chain == b.chain).all():
        return 1.0
    if not len(a.chain) or not len(b.chain):
        return 0.0
    if len(a.chain) > len(b.chain):
        a, b = b, a
    one, other = np.zeros(len(a.chain)), np.zeros(len(b.chain))
    for at in range(0, len(a.chain), wide := max(1, (1 << 16) // len(b.chain))):
        x, n = a.chain[at : at + wide], a.bits[at : at + wide, None]
        shared = np.bitwise_count(x[:, None, :] & b.chain[None, :, :]).sum(axis=2, dtype=np.int64)
        most, chance = np.minimum(n, b.bits), n * b.bits / BITS
        floor = chance + CUT * (most - chance)
        score = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0.0, 1.0)
        one[at : at + wide] = score.max(axis=1)
        other = np.maximum(other, score.max(axis=0))
    first = float((one * a.bits).sum() / a.bits.sum())
    return first if len(a.chain) != len(b.chain) else max(first, float((other * b.bits).sum() / b.bits.sum()))


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The fingerprint of each text. A text without features, unless it is empty, is one feature as a whole."""
    gap = bytes(NEAR)  # keeps the neighbourhoods of texts apart
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.append(0, np.cumsum(size + len(gap)))
    buffer = np.frombuffer(gap.join([*texts, b""]), np.uint8)
    made = rank[entropies(buffer)]
    for b, n in zip(begin.tolist(), size.tolist()):
        made[b + max(n - WINDOW + 1, 0) : b + n + len(gap)] = NONE
    at = features(buffer, made)
    view = buffer.data
    hashes = np.array([xxhash.xxh3_64_intdigest(view[i : i + WINDOW]) for i in at.tolist()], np.uint64)
    cut = np.searchsorted(at, begin)
    out = []
    for i, text in enumerate(texts):
        mine = hashes[cut[i] : cut[i + 1]]
        if not len(mine) and text:
            mine = np.array([xxhash.xxh3_64_intdigest(text)], np.uint64)
        _, first = np.unique(mine, return_index=True)
        mine = mine[np.sort(first)]  # a feature counts once
        chain = np.zeros((-(-len(mine) // FEATURES), BITS), bool)
        for k in range(HASHES):
            chain[np.arange(len(mine)) // FEATURES, (mine >> np.uint64(11 * k)).astype(np.int64) % BITS] = True
        out.append(Digest(np.packbits(chain, axis=1, bitorder="little").view("<u8")))
    return out


def fingerprint(docs: DataFrame, rank: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the chain of filters of each row's whole text as text.

    ``rank`` is the rarity of each entropy as ``ranks`` gives it; fingerprints are alike only if made with
    the same one. None takes it from ``docs``. Null texts are empty ones: they have no filters.
    """
    rank = ranks(entropy_counts(docs, text)) if rank is None else rank
    (mine,) = unused(docs, "text_bytes")
    rows = docs.drop("fingerprint")
    kinds = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in small_batches([batch], mine, BATCH):
                made = pa.array([str(d) for d in digests(texts_of(piece, mine), rank)], pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kinds), made], names=[*kinds, "fingerprint"])

    return rows.withColumn(mine, F.col(text)).mapInArrow(run, rows.withColumn("fingerprint", F.lit("")).schema)


#: Keys that the cuts between ranges are chosen from, for each range.
DRAWN = 16
#: Bytes of text in a range, and ranges at most: cuts are sent to every task.
RANGE_BYTES, RANGES = 64 << 20, 1 << 14
EDITED = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"


def _cuts(keys: DataFrame, partitions: int) -> list[tuple]:
    """The first key of each range of ``keys`` (no_id, down, digest, size); the first range begins with the first key of all."""
    key = F.struct("no_id", "down", "digest")
    whole = keys.agg(F.min(key).alias("first"), F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if not whole.n:
        return []
    ranges = int(min(RANGES, max(4 * partitions, whole.size // RANGE_BYTES)))
    drawn = keys.filter(F.pmod(F.xxhash64("no_id", "down", "digest"), F.lit(max(1, whole.n // (DRAWN * ranges)))) == 0)
    drawn = sorted((r.no_id, r.down, bytes(r.digest), r.size) for r in drawn.groupBy("no_id", "down", "digest").agg(F.sum("size").alias("size")).collect())
    share, cuts, held = sum(r[3] for r in drawn) / ranges, [(whole.first.no_id, whole.first.down, bytes(whole.first.digest))], 0
    for *key, size in drawn:
        if held >= share and tuple(key) > cuts[-1]:
            cuts.append(tuple(key))
            held = 0
        held += size + 1
    return cuts


def edited(text: str, after: str) -> str:
    """``text`` with its last third of characters replaced by as many of the first of ``after``, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def compare_edited(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The next row is that of the next smaller doc_id; after the last comes the first. Null ids come last, rows
    that share an id by their texts' SHA-256; rows equal in both are equal here. Null texts are
    empty. A table of one row is next to itself; an empty table gives no rows. Texts move
    once: rows go to ranges of that order, and the first row of a range goes to the one before, too. Rows of
    equal id and text of a task go as one row with their number. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rank = ranks(entropy_counts(rows)) if rank is None else rank
    down = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))  # falls as the id grows, without overflow
    keyed = rows.select("doc_id", "text", F.col("doc_id").isNull().alias("no_id"), down.alias("down"), F.unhex(F.sha2("text", 256)).alias("digest"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(keyed.select("no_id", "down", "digest", F.octet_length("text").cast("long").alias("size")), partitions)
    dealt = f"range int, guard boolean, no_id boolean, down long, digest binary, doc_id {kind}, text string, copies long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in small_batches([batch], "text"):
                keys = list(zip(*(piece.column(c).to_pylist() for c in ("no_id", "down", "digest"))))
                copies: dict[tuple, list[int]] = {}
                for i, key in enumerate(keys):
                    copies.setdefault(key, []).append(i)
                at, range_, guard, n = [], [], [], []
                for key, mine in copies.items():
                    r = bisect_right(cuts, key) - 1
                    at.append(mine[0]), range_.append(r), guard.append(False), n.append(len(mine))
                    if cuts[r] == key:
                        at.append(mine[0]), range_.append((r or len(cuts)) - 1), guard.append(True), n.append(0)
                out = piece.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(range_, pa.int32()), pa.array(guard), *(out.column(c) for c in ("no_id", "down", "digest", "doc_id", "text")), pa.array(n, pa.int64())], names=["range", "guard", "no_id", "down", "digest", "doc_id", "text", "copies"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (range, guard, doc_id, text, copies)
        size = 0
        for batch in batches:
            id_type[:] = [batch.schema.field("doc_id").type]
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "guard", "doc_id", "text", "copies"))):
                if held and held[-1][:2] == (row[0], True) and row[1]:
                    continue  # a range needs the row after it once
                held.append(row)
                size += len(row[3])
                if size >= BATCH and len(held) > 1:
                    yield made(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema(list(zip(names, [id_type[0], pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()])))
        pairs = []  # (row, next row, number)
        for i, (row, after) in enumerate(zip(held, held[1:])):
            if not row[1]:
                pairs += [(i, i + 1, 1)] + ([(i, i, row[4] - 1)] if row[4] > 1 else [])
        changed = [edited(held[i][3], held[j][3]).encode() for i, j, _ in pairs]
        prints = digests([row[3].encode() for row in held] + changed, rank)
        out = []
        for (i, j, n), text, print_ in zip(pairs, changed, prints[len(held) :]):
            out.append((held[i][2], len(held[i][3]), hashlib.sha256(text).hexdigest(), str(prints[i]), str(print_), likeness(prints[i], print_), likeness(prints[i], prints[j]), n))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    names = [c.split()[0] for c in EDITED.split(", ")]
    id_type: list[pa.DataType] = []
    ranged = keyed.mapInArrow(deal, dealt).repartition("range").sortWithinPartitions("range", "guard", "no_id", "down", "digest")
    out = ranged.mapInArrow(compare, EDITED.format(kind=kind))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")

