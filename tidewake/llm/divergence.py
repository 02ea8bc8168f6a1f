"""Source divergence audit: how far the words of the sources of a language are apart, in exact integers.

A lookup table over the concatenated UTF-8 bytes of a batch of texts finds the words, xxhash groups
equal ones, and the bytes of each word are compared with those of its group. What leaves a
task are counts by (language, source, word). Shares and divergences are taken in blocks, each the counts of some of the
words of a language as a CSR matrix with a row for each source: a block's size is bounded, and so are the rows
it gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import small_batches, written

#: What a byte of a word becomes: A-Z lower-case, a-z and all bytes of other alphabets as they are; 0 ends a word.
WORD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Words hashed and compared at once.
STRETCH = 1 << 16
#: Counts in a block, and sources that a block compares with all others.
BLOCK, WIDE = 1 << 16, 256
ROWS = "lang string, source string, term string, n long, docs long"


def pieces(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as they count, start, end, text) of the words of texts that stand one after the other in ``buffer``."""
    low = WORD_BYTES[buffer]
    inside = low != 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))  # a word ends with its text
    start[offsets[full]], end[offsets[full + 1] - 1] = inside[offsets[full]], inside[offsets[full + 1] - 1]
    start = np.flatnonzero(start)
    return low, start, np.flatnonzero(end) + 1, np.searchsorted(offsets, start, side="right") - 1


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of slices, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def same_words(low: np.ndarray, start: np.ndarray, end: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each word, a word of each group): words of a group have equal bytes, different groups different ones.

    Words whose bytes differ from those of the first of their hash get groups of their own.
    """
    view, hashes = low.data, np.empty(len(start), np.uint64)
    for k in range(0, len(start), STRETCH):
        hashes[k : k + STRETCH] = [digest(view[a:b]) for a, b in zip(start[k : k + STRETCH].tolist(), end[k : k + STRETCH].tolist())]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, odd = end - start, []
    for k in range(0, len(start), STRETCH):
        at = slice(k, k + STRETCH)
        model = first[group[at]]
        equal = size[at] == size[model]
        rows = np.flatnonzero(equal)
        n = size[at][rows]
        differ = low[_flat(start[at][rows], n)] != low[_flat(start[model[rows]], n)]
        equal[rows[np.repeat(np.arange(len(rows)), n)[differ]]] = False
        odd += (k + np.flatnonzero(~equal)).tolist()
    seen: dict[bytes, int] = {}
    extra: list[int] = []
    for i in odd:
        word = bytes(view[start[i] : end[i]])
        if word not in seen:
            seen[word] = len(first) + len(extra)
            extra.append(i)
        group[i] = seen[word]
    return group, np.append(first, extra).astype(np.int64)


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """ROWS of a batch (lang, source, text without nulls): occurrences and texts by language, source and word, and a row with an empty word for each (lang, source)."""
    text = batch.column("text").cast(pa.binary())
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    buffer = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    low, start, end, doc = pieces(buffer, offsets - offsets[0])
    word, model = same_words(low, start, end)
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    kinds, owner, of = np.unique(pair, return_index=True, return_inverse=True)
    docs = len(text)
    key, n = np.unique((word * len(kinds) + of[doc]) * docs + doc, return_counts=True)  # by word, group, text
    both = key // docs
    begin = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
    both, total = both[begin], np.add.reduceat(n, begin) if len(begin) else n
    size = (end - start)[model]
    starts = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(model), pa.py_buffer(starts), pa.py_buffer(low[_flat(start[model], size)]))
    own = np.concatenate((owner[both % len(kinds)], owner))
    term = pa.concat_arrays([words.take(pa.array(both // len(kinds))), pa.array([""] * len(kinds), pa.string())])
    zero = np.zeros(len(kinds), np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column("lang").take(pa.array(own)), batch.column("source").take(pa.array(own)), term, pa.array(np.append(total, zero)), pa.array(np.append(np.diff(np.append(begin, len(key))), zero))],
        names=["lang", "source", "term", "n", "docs"],
    )


def shares(count: np.ndarray, of: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (of + kinds)), three decimal digits at a time, so that nothing leaves 64 bits."""
    whole, rest = np.zeros(np.broadcast(count, of).shape, np.int64), count + np.int64(1)
    by = np.maximum(of + kinds, 1)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // by, rest % by
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares stay in 64 bits."""
    return (p - q) * (p - q) // q


def row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix by reduceat, 0 for empty rows."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros(len(begin) - 1, np.int64)
    if len(full):
        out[full] = np.add.reduceat(values, begin[full])
    return out


def block_rows(counts: pa.Table, sizes: pa.Table, top: int, wide: int) -> pa.Table:
    """(lang, source, part, item, value) of a block: what its words add to the pairs of its sources, and the candidates among its words.

    ``counts`` are (source, term, n) of some words of a language, all sources of each; ``sizes`` are
    (source, total, terms, side) of all its sources, and rows are given for those of number side * wide to (side + 1) * wide.
    """
    order = pc.sort_indices(sizes.column("source").cast(pa.binary()))
    sizes = sizes.take(order)
    names, of, kinds, side = sizes.column("source").combine_chunks(), sizes.column("total").to_numpy(), sizes.column("terms")[0].as_py(), sizes.column("side")[0].as_py()
    mine = np.arange(side * wide, min((side + 1) * wide, len(names)))
    encoded = counts.column("term").combine_chunks().dictionary_encode()
    words = encoded.dictionary
    order = pc.array_sort_indices(words.cast(pa.binary())).to_numpy()
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))  # columns stand in the order of the words' bytes
    words, col = words.take(pa.array(order)), place[encoded.indices.to_numpy()]
    row = pc.index_in(counts.column("source").combine_chunks(), names).to_numpy().astype(np.int64)
    n = counts.column("n").to_numpy()
    by = np.lexsort((col, row))
    row, col, n = row[by], col[by], n[by]
    begin = np.searchsorted(row, np.arange(len(names) + 1))
    q, none = shares(n, of[row], kinds), shares(np.zeros(len(names), np.int64), of, kinds)
    overall = np.zeros(len(words), np.int64)
    np.add.at(overall, col, n)
    overall = shares(overall, of.sum(), kinds)
    levels, level = np.unique(none, return_inverse=True)
    out: list[tuple] = []
    for s in mine:
        at = slice(begin[s], begin[s + 1])
        p = np.full(len(words), none[s])
        p[col[at]] = q[at]
        own = np.zeros(len(words), bool)
        own[col[at]] = True
        # words of the other source; words of this one alone; words of neither
        value = row_sums(gaps(p[col], q), begin)
        alone = np.array([gaps(q[at], x).sum() for x in levels])[level] - row_sums(np.where(own[col], gaps(p[col], none[row]), 0), begin)
        neither = len(words) - (begin[s + 1] - begin[s]) - np.diff(begin) + row_sums(own[col].astype(np.int64), begin)
        value += alone + neither * gaps(none[s], none)
        other = np.delete(np.arange(len(names)), s)
        out.append((s, "pair", names.take(pa.array(other)), value[other]))
        up = q[at] > overall[col[at]]
        terms, value = col[at][up], gaps(q[at][up], overall[col[at][up]])
        best = np.lexsort((terms, -value))[:top]
        out.append((s, "term", words.take(pa.array(terms[best])), value[best]))
    source = np.concatenate([np.full(len(v), s) for s, _, _, v in out])
    part = pa.concat_arrays([pa.repeat(p, len(v)) for _, p, _, v in out])
    return pa.table({"source": names.take(pa.array(source)), "part": part, "item": pa.concat_arrays([i for *_, i, _ in out]), "value": np.concatenate([v for *_, v in out])})


def divergences(docs: DataFrame, least: int = 3, top: int = 200, *, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(lang, source, part, item, value, rank): the pairs of sources of each language, and the words that stand out in each source.

    Null text, lang and source are empty ones. Words are runs of letters and non-ASCII characters, A-Z lower-cased. A
    language keeps the words that occur in ``least`` of its rows; with V kept words, N occurrences of them in a source
    and ``n`` of one of them, its share is p = 1 + floor(10^9 (n + 1) / (N + V)), and f = floor((p - q)^2 / q) the gap to
    share q. Part ``pair`` has the sum of f over all kept words against each other source of the language, 0 without kept
    words; part ``term`` the words of the source whose share is over the language's, of rank ``top`` at most. Ties are ranked by the
    item's UTF-8 bytes. Repeated rows count as often as they occur, sources without words have pairs all the same, texts of
    any length are read whole. A block holds about ``block`` counts and rows for ``wide`` sources; results are the same at any value. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in small_batches([batch], "text"):
                yield counted(piece)

    counts = text.mapInArrow(count, ROWS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = W.partitionBy("lang", "term")
    counts = counts.withColumns({"held": F.sum("docs").over(word), "nth": F.row_number().over(word.orderBy("source"))}).filter((F.col("held") >= least) | (F.col("term") == ""))
    terms = written(counts.select("lang", "source", "term", "n", ((F.col("nth") == 1) & (F.col("term") != "")).cast("long").alias("first")), "terms")
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"), F.count_if(F.col("term") != "").alias("held"))
    lang = W.partitionBy("lang")
    sizes = written(sizes.select("lang", "source", "total", F.sum("first").over(lang).alias("terms"), F.sum("held").over(lang).alias("held"), F.count("*").over(lang).alias("sources")), "sizes")
    # a language's words go to so many blocks, its sources to so many sides
    blocks, sides = F.ceil(F.col("held") / block), F.ceil(F.col("sources") / wide)
    langs = sizes.groupBy("lang").agg(F.greatest(F.lit(1), F.max(blocks)).alias("blocks"), F.max(sides).alias("sides"))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = terms.filter("term <> ''").join(langs, "lang").withColumn("side", numbers("sides"))
    left = left.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "side", "source", "term", "n")
    right = sizes.join(langs, "lang").withColumn("side", numbers("sides")).withColumn("block", numbers("blocks"))
    right = right.select("lang", "block", "side", "source", "total", "terms")

    def rows_of(key: tuple, mine: pa.Table, whole: pa.Table) -> pa.Table:
        made = block_rows(mine, whole, top, wide)
        return made.add_column(0, "lang", pa.repeat(key[0].as_py(), made.num_rows))

    by = ["lang", "block", "side"]
    rows = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rows_of, "lang string, source string, part string, item string, value long")
    rows = rows.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a word is in one block
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
