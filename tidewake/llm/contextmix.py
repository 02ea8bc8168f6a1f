"""Language-model scores by online logistic context mixing over bytes, beside a word unigram base.

A text is its bytes (A-Z lowered) and one end symbol. A symbol is a path of binary decisions in a
fixed code tree, and each decision is predicted from several hashed contexts: the last symbol, the last 2 and the last 4
symbols, and the word so far. What is counted is grams: a context and the symbol after it. A decision's
zeros and ones are sums of its context's symbols on either side. The log odds of the contexts are
added with weights that are gated by how much each has seen there, and an adaptive table refines the
sum per node of the tree. The table is used for half of the final probability.

Grams are counted over all texts to learn from, in parts by hash that grow with the corpus; only those of frequent contexts
are broadcast. For the others a batch of texts asks each part, and is scored where the answers meet. The
weights (48 numbers) and the table are learnt online over all these texts, each once, in the order of their hashes. The first
about DRAW bytes are learnt in small steps: each is predicted with all counts less its own, and then corrects the weights. Then
steps grow to rounds, each GROWTH times all before it: their batches are predicted in parallel with all counts less the
predicted occurrence's own, and what they would correct is added up before it is applied. So weights and table depend
neither on tasks nor on the order of rows.

Equal decisions in equal contexts are computed once a batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import doc_crc_mod, small_batches, texts_of, written
from tidewake.llm.shingles import U64, WHITE, _powers, mix, word_hashes

END, PAD, ORDERS = 256, 4, 4  # contexts: 1, 2 and 4 symbols, the word so far
GATES, STEPS = 12, 24
BATCH = 31 << 16  # bytes of text that are counted, or scored, at once
DRAW, STEP_BYTES = 1 << 21, 1 << 14  # bytes of texts that weights are learnt from in small steps, and those of a step
GROWTH = 16  # all texts of a round and before it are so many times those before it
PART_BYTES = 24 << 20  # bytes of text for each part of the counts
SYMBOL = U64(511)  # a gram is 55 bits of its context's hash and 9 of its symbol
KEPT = 4_000_000  # grams that a task holds before it hands them on
ODD = U64(0x9E3779B97F4A7C15)
HEAD = 1 << 20  # words with at least this share of all tokens, one in HEAD, are broadcast: at most HEAD words
GRAMS = 1 << 22  # grams of the most frequent contexts, by powers of two, are broadcast: at most GRAMS


def code_tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per symbol the nodes and bits of its path and the path's length: a Huffman tree for ranks of letters by rule."""
    common = b" enthaiors\xc3dulc.gmbfpyvw\n,kqzxj\xa9\xa8*-'0123456789()"
    order = sorted(range(END + 1), key=lambda s: (common.find(s) % 256 if s < END else 40, s))
    heap = [(1.0 / (i + 3) ** 1.1 if i < 42 else 2.0**-13, s, s) for i, s in enumerate(order)]
    heapq.heapify(heap)
    paths: dict[int, list[tuple[int, int]]] = {s: [] for s in range(END + 1)}
    inside: dict[int, list[int]] = {s: [s] for s in range(END + 1)}
    for node in range(END):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, (_, _, name) in enumerate((a, b)):
            for s in inside[name]:
                paths[s].append((node, bit))
        inside[END + 1 + node] = inside.pop(a[2]) + inside.pop(b[2])
        heapq.heappush(heap, (a[0] + b[0], END + 1 + node, END + 1 + node))
    size = np.array([len(paths[s]) for s in range(END + 1)])
    nodes, bits = np.zeros((END + 1, size.max()), np.int64), np.zeros((END + 1, size.max()), np.int64)
    for s, path in paths.items():
        nodes[s, : len(path)], bits[s, : len(path)] = zip(*path[::-1])  # from the root
    return nodes, bits, size


NODES, BITS, SIZES = code_tree()
SHARED = np.logical_and.accumulate(
    (NODES[:, None] == NODES[None]) & (BITS[:, None] == BITS[None]) & (np.arange(NODES.shape[1]) < np.minimum(SIZES[:, None], SIZES[None])[..., None]), axis=2
).sum(axis=2)  # decisions that two symbols' paths have in common
STEP = NODES * 2 + BITS  # node and bit of each decision as one number
GATE = np.minimum(np.log2(np.arange(1 << 12) + 1), GATES - 1).astype(np.uint8)


def _last_four(sym: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The four symbols before each of ``at``, nine bits each, the last lowest."""
    back = (lambda k: sym[at.start - k : at.stop - k]) if isinstance(at, slice) else (lambda k: sym[at - k])
    out = back(4).astype(U64)
    for k in (3, 2, 1):
        out <<= U64(9)
        out |= back(k)
    return out


def _word_so_far(summed: np.ndarray, begun: np.ndarray, back: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of the symbols from the last gap (``begun``) to each of ``at``."""
    start = begun[at]
    return (summed[at] - summed[start]) * back[start]


class Distinct:
    """The distinct (context, symbol) cases of a batch: context hashes, symbols, how often each occurs, and where."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        # a text is PAD times END, its bytes, and END
        starts = np.cumsum(sizes + PAD + 1) - sizes - 1
        sym = np.frombuffer(b"\0" * PAD + (b"\0" * (PAD + 1)).join(texts) + b"\0" if texts else b"", np.uint8).astype(np.uint16)
        pads = (starts[:, None] - 1 - np.arange(PAD)).ravel()
        sym[pads] = sym[starts + sizes] = END
        text = np.ones(len(sym), bool)
        text[pads] = False
        gap = np.ones(END + 1, bool)
        gap[:END] = WHITE
        base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
        # the word so far: from the last gap to here, by differences of one running sum
        summed = np.zeros(len(sym) + 1, U64)
        np.multiply(sym + U64(1), _powers(base, len(sym)), out=summed[1:])
        np.cumsum(summed[1:], out=summed[1:])
        gaps = np.append(0, np.flatnonzero(gap[sym]) + 1)
        begun = np.repeat(gaps.astype(np.int32), np.diff(np.append(gaps, len(sym) + 1)))
        back, key = _powers(inverse, len(sym)), np.empty(len(sym), U64)
        for lo in range(PAD, len(sym), 1 << 15):  # blocks that stay in the processor's cache
            at = slice(lo, min(lo + (1 << 15), len(sym)))
            k = _last_four(sym, at) * ODD
            k += sym[at]
            k = mix(k)
            k += _word_so_far(summed, begun, back, at)
            key[at] = mix(k)
        scored = np.flatnonzero(text)
        bits = max(1, len(scored).bit_length())
        order = key[scored] >> U64(bits) << U64(bits)
        del key
        order |= np.arange(len(scored), dtype=U64)
        order.sort()
        self.where = (order & U64((1 << bits) - 1)).astype(np.int32)
        order >>= U64(bits)
        first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))[: len(order)]
        self.times = np.diff(np.append(first, len(order)))
        here = scored[self.where[first]]
        self.symbols = sym[here].astype(np.int64)
        four = _last_four(sym, here)
        last = [four & U64(511), four & U64((1 << 18) - 1), four, _word_so_far(summed, begun, back, here)]
        self.contexts = [mix(x + np.uint64((k + 1) * int(ODD) & (2**64 - 1))) for k, x in enumerate(last)]
        self.ends = np.cumsum(sizes + 1)

    @cached_property
    def _unique(self) -> tuple[np.ndarray, np.ndarray]:
        # orders have no grams in common: each is sorted by hash with its cases' numbers in the low bits
        n, bits = len(self.symbols), U64(max(1, len(self.symbols).bit_length()))
        firsts, places, met = [], np.empty((ORDERS, n), np.int64), 0
        for k, c in enumerate(self.contexts):
            gram = c & ~SYMBOL | self.symbols.astype(U64)
            order = mix(gram) >> bits << bits | np.arange(n, dtype=U64)
            order.sort()
            case = (order & ((U64(1) << bits) - U64(1))).astype(np.int64)
            order >>= bits
            fresh = np.append(True, order[1:] != order[:-1])[:n]
            places[k, case] = np.cumsum(fresh) + (met - 1)
            firsts.append(gram[case[fresh]])
            met += len(firsts[-1])
        grams = np.concatenate(firsts)
        order = np.argsort(grams)
        rank = np.empty(len(grams), np.int64)
        rank[order] = np.arange(len(grams))
        return grams[order], rank[places]

    @property
    def grams(self) -> np.ndarray:
        """The distinct grams of all orders."""
        return self._unique[0]

    @property
    def place(self) -> np.ndarray:
        """For each order where the cases' grams are in ``grams``."""
        return self._unique[1]

    @cached_property
    def gram_times(self) -> np.ndarray:
        return np.bincount(self.place.ravel(), np.tile(self.times, ORDERS), len(self.grams)).astype(np.int64)

    @cached_property
    def order_of(self) -> np.ndarray:
        out = np.zeros(len(self.grams), np.int8)
        for k in range(ORDERS):
            out[self.place[k]] = k
        return out

    def decisions(self, first: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(case, node, bit, places) of all binary decisions, in pieces; places of each order by the grams' ``first`` ones."""
        steps, wide = STEP.ravel(), STEP.shape[1]
        for i in range(0, len(self.symbols), most // 8):
            s = self.symbols[i : i + most // 8]
            n = SIZES[s]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            step = steps[np.repeat(s * wide, n) + nth]
            places = [np.repeat(first[at[i : i + len(s)]], n) for at in self.place]
            for at in places:
                at += nth
            yield np.repeat(np.arange(i, i + len(s)), n), step >> 1, step & 1, places

    def per_text(self, cost: np.ndarray) -> np.ndarray:
        """Sums of the cases' costs over each text."""
        placed = np.empty(len(self.where))
        placed[self.where] = np.repeat(cost, self.times)
        running = np.concatenate(([0.0], np.cumsum(placed)))
        return np.diff(running[np.concatenate(([0], self.ends))])


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of ``n`` places each."""
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


Counted = tuple[np.ndarray, np.ndarray]  # grams in order, and how often each occurs


def path_counts(grams: np.ndarray, counted: list[Counted], block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each decision of each gram's symbol how often its context went the same way and the other, and each gram's first place.

    A context's grams are all in one of ``counted``. A gram has a place for each decision and one more.
    """
    size = SIZES[(grams & SYMBOL).astype(np.int64)] + 1
    first = np.cumsum(size) - size
    left = np.zeros(int(size.sum()))  # by decision: symbols of the context that leave the path there; last the symbol itself
    todo = np.arange(len(grams))
    for keys, counts in counted:
        here = np.zeros(len(todo), bool)
        for i in range(0, len(todo), block):
            which = todo[i : i + block]
            g = grams[which]
            context = g & ~SYMBOL
            begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))  # grams that meet share their context
            run = np.diff(np.append(begin, len(g)))
            lo, hi = np.repeat(np.searchsorted(keys, context[begin]), run), np.repeat(np.searchsorted(keys, context[begin] | SYMBOL, side="right"), run)
            here[i : i + block] = hi > lo
            at, base = _ranges(lo, hi - lo), first[which[0]]
            cell = np.repeat(first[which] - base, hi - lo) + SHARED[np.repeat((g & SYMBOL).astype(np.int64), hi - lo), (keys[at] & SYMBOL).astype(np.int64)]
            n = int(first[which[-1]] + size[which[-1]] - base)
            left[base : base + n] += np.bincount(cell, counts[at], n)
        todo = todo[~here]
    same = np.cumsum(left)
    return np.subtract(np.repeat(same[first + size - 1], size), same, out=same), left, first


class Mixer:
    def __init__(self):
        self.keys, self.counts = np.empty(0, U64), np.empty(0, np.int64)  # grams in order
        self.weights = np.full((ORDERS, GATES), 0.3)
        self.refined = np.zeros((2, END * STEPS))  # ones, and all, per node and step of the log odds
        self.seen = 0.0
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def freeze(self) -> None:
        """Adds what was learnt since to the counts."""
        for keys, counts in self.fresh:
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == keys[inside]
            self.counts[at[known]] += counts[known]
            new = ~known
            self.keys, self.counts = np.insert(self.keys, at[new], keys[new]), np.insert(self.counts, at[new], counts[new])
        self.fresh = []

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All grams and counts; none stay."""
        self.freeze()
        got, self.keys, self.counts = (self.keys, self.counts), np.empty(0, U64), np.empty(0, np.int64)
        return got

    def look(self, cases: Distinct, counted: list[Counted], weigh: bool = True, own: int = 0) -> None:
        """Log odds of the ways that the symbols take, gates, and weighted odds if asked for, of all places of the cases' grams.

        ``own`` occurrences of each gram are left out of its counts.
        """
        same, other, self.first = path_counts(cases.grams, counted)
        if own:
            np.maximum(np.subtract(same, own, out=same), 0, out=same)
        self.gates = GATE[np.minimum(same + other, len(GATE) - 1).astype(np.int16)]
        self.odds = np.log((same + 0.05).astype(np.float32) / (other + 0.05).astype(np.float32))
        if weigh:
            order = np.repeat(cases.order_of.astype(np.int16) * np.int16(GATES), np.diff(np.append(self.first, len(same))))
            order += self.gates
            self.weighted = self.weights.astype(np.float32).ravel()[order] * self.odds

    @staticmethod
    def cells(total: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Cells of the adaptive table by the log odds of a one."""
        return node * STEPS + np.clip((total + 9) * (STEPS / 18), 0, STEPS - 1).astype(np.int64)

    def predict(self, total: np.ndarray, node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final probability of a one, the mixed one, and the cells of the adaptive table, by the weighted odds of ``bit``."""
        total = np.clip(total * (2 * bit - 1).astype(np.float32), -14, 14)
        p = 1 / (1 + np.exp(-total))
        cell = self.cells(total, node)
        return (0.5 * p + 0.5 * (self.refined[0][cell] + 8 * p) / (self.refined[1][cell] + 8)), p, cell

    def count(self, texts: list[bytes]) -> None:
        """Adds the grams of ``texts``."""
        cases = Distinct(texts)
        self.freeze()
        self.fresh.append((cases.grams, cases.gram_times))

    def learn(self, texts: list[bytes]) -> None:
        """Predicts ``texts`` with what was counted before, corrects the weights, and counts them."""
        cases = Distinct(texts)
        self.freeze()
        self.adapt(cases, [(self.keys, self.counts)])
        self.fresh.append((cases.grams, cases.gram_times))

    def adapt(self, cases: Distinct, counted: list[Counted]) -> None:
        """Corrects weights and table by how ``counted`` predicts the cases."""
        self.look(cases, counted, weigh=False)
        for found in self.errors(cases):
            self.correct(*found)

    def errors(self, cases: Distinct) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For pieces of the cases: sums of the errors' slopes and numbers of decisions by order and gate, and ones and all by cell of the table."""
        for case, node, bit, places in cases.decisions(self.first):
            times = cases.times[case]
            odds, gates = [self.odds[at] for at in places], [self.gates[at] for at in places]
            _, p, cell = self.predict(sum(w.astype(np.float32)[g] * o for w, g, o in zip(self.weights, gates, odds)), node, bit)
            toward = (bit - p) * times * (2 * bit - 1)
            slopes = np.array([np.bincount(gate, toward * o, GATES) for gate, o in zip(gates, odds)])
            yield slopes, np.array([np.bincount(gate, times, GATES) for gate in gates]), np.array([np.bincount(cell, times * bit, END * STEPS), np.bincount(cell, times, END * STEPS)])

    def correct(self, slopes: np.ndarray, met: np.ndarray, cells: np.ndarray) -> None:
        n = met[0].sum()
        if n:
            self.weights = self.weights + 0.4 / (1 + self.seen / 2e7) ** 0.5 * slopes / (met + 0.01 * n)
            self.refined += cells
            self.seen += float(n)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under the model."""
        self.freeze()
        return self.cost(Distinct(texts), [(self.keys, self.counts)])

    def cost(self, cases: Distinct, counted: list[Counted]) -> np.ndarray:
        """Bits of each text by the counted grams."""
        self.look(cases, counted)
        cost = np.zeros(len(cases.symbols))
        # the final probability of a way is a factor by cell of the mixed one and a rest by cell and way
        ones, seen = self.refined
        factor = (0.5 + 4 / (seen + 8)).astype(np.float32)
        rest = (0.5 * np.array([seen - ones, ones]) / (seen + 8)).astype(np.float32).ravel()
        for case, node, bit, places in cases.decisions(self.first):
            total = self.weighted[places[0]]
            for at in places[1:]:
                total += self.weighted[at]
            np.clip(total, -14, 14, out=total)
            cell = self.cells(total * (2 * bit - 1).astype(np.float32), node)
            np.exp(np.negative(total, out=total), out=total)
            total += 1
            final = np.divide(factor[cell], total, out=total)
            final += rest[cell + bit * (END * STEPS)]
            cost[case[0] : case[-1] + 1] = -np.add.reduceat(np.log2(final, out=final), np.flatnonzero(np.diff(case, prepend=-1)))
        return cases.per_text(cost)


def packed(x: np.ndarray) -> bytes:
    """Numbers of 0 or more, byte by byte of their places, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(U64).ravel()


def packed_keys(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=U64(0)))


def unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x), dtype=U64)


def filled(batches: Iterator[pa.RecordBatch], column: str, most: int, by: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of nearly ``most`` text bytes, where rows are small enough, and of one value of ``by``."""
    held: dict[int | None, list[pa.RecordBatch]] = {}
    size: dict[int | None, int] = {}
    whole = lambda key: pa.Table.from_batches(held.pop(key)).combine_chunks().to_batches()[0]
    for some in small_batches(batches, column, most):
        keys = pc.unique(some.column(by)).to_pylist() if by else [None]
        for key in keys:
            batch = some.filter(pc.equal(some.column(by), key)) if len(keys) > 1 else some
            n = int(pc.sum(pc.binary_length(batch.column(column))).as_py() or 0)
            if key in held and size[key] + n > most:
                yield whole(key)
            if batch.num_rows:
                size[key] = size[key] + n if key in held else n
                held.setdefault(key, []).append(batch)
    for key in list(held):
        yield whole(key)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes) % U64(parts)).astype(np.int64)


def _ordered_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of grams or contexts: in the order of the keys, all grams of a context in one."""
    return (((keys >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


GATHERED = "kind string, part long, a binary, b binary"


def _gather(docs: DataFrame, parts: int) -> DataFrame:
    """One pass over the texts to learn from: counts of words and grams, and numbers of texts, tokens and symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, hashes, counts, held, n_texts, n_tokens, n_symbols = Mixer(), [], [], 0, 0, 0, 0

        def out(kind: str, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            columns = [pa.array([kind] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "a", "b"])

        def words() -> pa.RecordBatch:
            keys, times = _merged(hashes, counts)
            part = _part(keys, parts)
            order = np.argsort(part, kind="stable")
            keys, times, part = keys[order], times[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            return out("words", [(p, keys[i:j].tobytes(), times[i:j].tobytes()) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i])

        def grams() -> pa.RecordBatch:
            keys, times = mixer.taken()
            at = np.searchsorted(_ordered_part(keys, parts), np.arange(parts + 1))
            return out("grams", [(p, packed_keys(keys[i:j]), packed(times[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i])

        for batch in filled(batches, "text", BATCH):
            texts = [t.lower() for t in texts_of(batch, "text")]
            h, n = word_hashes(texts)
            keys, times = np.unique(h, return_counts=True)
            hashes.append(keys)
            counts.append(times)
            held, n_texts, n_tokens = held + len(keys), n_texts + len(texts), n_tokens + int(n.sum()) + len(texts)
            if held > 4_000_000:
                yield words()
                hashes, counts, held = [], [], 0
            mixer.count(texts)
            n_symbols += sum(map(len, texts)) + len(texts)
            if len(mixer.keys) > KEPT:
                yield grams()
        if n_texts:
            if hashes:
                yield words()
            some = TaskContext.get().partitionId() % 64
            yield out("totals", [(some, np.array([n_texts, n_tokens, n_symbols]).tobytes(), b"")])
            yield grams()

    return docs.select("text").mapInArrow(run, GATHERED)


def _contexts(keys: np.ndarray, times: np.ndarray) -> Counted:
    """Where each context begins among the grams ``keys``, and how often it occurs."""
    begin = np.flatnonzero(np.append(True, (keys[1:] ^ keys[:-1]) > SYMBOL)) if len(keys) else np.empty(0, np.int64)
    return begin, np.add.reduceat(times, begin) if len(begin) else times[:0]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What tasks gathered of one kind and part, added up as it comes; n is the number of words, or of grams by the power of two that their context's count reaches."""
    kind = part = total = None
    keys, times, held = [], [], 0
    for batch in batches:
        for k, p, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "a", "b"))):
            kind, part = k, p
            if kind in ("words", "grams"):
                keys.append(np.frombuffer(a, U64) if kind == "words" else unpacked_keys(a))
                times.append(np.frombuffer(b, np.int64) if kind == "words" else unpacked(b).astype(np.int64))
                held += len(keys[-1])
                if held > 2 * len(keys[0]) + (1 << 20):
                    (k0, t0), held = _merged(keys, times), 0
                    keys, times = [k0], [t0]
            else:
                mine = [np.frombuffer(a, np.int64 if kind == "totals" else np.float64), np.frombuffer(b)]
                total = mine if total is None else [x + y for x, y in zip(total, mine)]
    if kind is None:
        return
    n = [0]
    if total is not None:
        a, b = total[0].tobytes(), total[1].tobytes()
    else:
        got, times = _merged(keys, times)
        if kind == "words":
            a, b, n = got.tobytes(), times.tobytes(), [len(got)]
        else:
            begin, each = _contexts(got, times)
            n = np.bincount(np.log2(each).astype(np.int64), np.diff(np.append(begin, len(got))), 64).astype(np.int64)
            a, b = packed_keys(got), packed(times)
    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), pa.array([part], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([n], pa.list_(pa.int64()))], names=["kind", "part", "a", "b", "n"])


class Model:
    """What all of scoring needs: the mixer with the grams of frequent contexts, the frequent words with their counts, and the totals."""

    def __init__(self, mixer: Mixer, head: np.ndarray, head_counts: np.ndarray, texts: int, tokens: int, types: int):
        self.mixer, self.head, self.head_counts = mixer, head, head_counts
        self.broad = (mixer.keys & ~SYMBOL)[_contexts(mixer.keys, mixer.counts)[0]]  # contexts of the mixer's grams
        self.texts, self.tokens, self.types = texts, tokens, types


class Trained:
    """What ``train`` has made of some texts: the broadcast model, the learnt weights and table, totals, the counts of all words (part, a, b, n) and grams (part, a, b), packed by part, and what the texts ask (SCORED)."""

    def __init__(self, shared: Broadcast, learnt: tuple[np.ndarray, np.ndarray], tokens: int, types: int, words: DataFrame, grams: DataFrame, asked: DataFrame):
        self.shared, self.learnt, self.tokens, self.types, self.words, self.grams, self.asked = shared, learnt, tokens, types, words, grams, asked


def train(docs: DataFrame, parts: int, draw: int = DRAW, step: int = STEP_BYTES) -> Trained:
    """The model of the texts of ``docs`` in ``parts`` parts; its weights are learnt from about ``draw`` bytes, ``step`` at a time, then from all others in rounds."""
    got = written(_gather(docs, parts).groupBy("kind", "part").applyInArrow(_summed, GATHERED + ", n array<long>"), "gathered")
    totals = [np.frombuffer(r.a, np.int64) for r in got.filter("kind = 'totals'").select("a").collect()]  # 64 short rows at most
    texts, tokens, symbols = (int(sum(t[i] for t in totals)) for i in (0, 1, 2))
    words = got.filter("kind = 'words'").select("part", "a", "b", "n")
    least = max(1, -(-tokens // HEAD))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                keys, times = np.frombuffer(a.as_py(), U64), np.frombuffer(b.as_py(), np.int64)
                much = times >= least
                yield pa.RecordBatch.from_arrays([pa.array([keys[much].tobytes()], pa.binary()), pa.array([times[much].tobytes()], pa.binary())], names=["a", "b"])

    rows = words.mapInArrow(frequent, "a binary, b binary").collect()  # HEAD words at most
    head = np.concatenate([np.frombuffer(r.a, U64) for r in rows] or [np.empty(0, U64)])
    counts = np.concatenate([np.frombuffer(r.b, np.int64) for r in rows] or [np.empty(0, np.int64)])
    order = np.argsort(head)
    mixer = Mixer()
    grams = got.filter("kind = 'grams'").select("part", "a", "b")
    classes = got.filter("kind = 'grams'").select(F.posexplode("n").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("class")).collect()  # 64 rows
    enough, held = 1 << 62, 0
    for r in classes:
        held += r.n
        if held > GRAMS:
            break
        enough = 1 << r["class"]

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                keys, times = unpacked_keys(a.as_py()), unpacked(b.as_py())
                begin, total = _contexts(keys, times)
                much = np.repeat(total >= enough, np.diff(np.append(begin, len(keys))))
                yield pa.RecordBatch.from_arrays([pa.array([packed_keys(keys[much])], pa.binary()), pa.array([packed(times[much])], pa.binary())], names=["a", "b"])

    rows = grams.mapInArrow(common, "a binary, b binary").collect()  # GRAMS grams at most
    if rows:
        mixer.keys, mixer.counts = _merged([unpacked_keys(r.a) for r in rows], [unpacked(r.b) for r in rows])

    types = int(words.agg(F.coalesce(F.sum(F.get("n", F.lit(0))), F.lit(0)).alias("n")).first().n) + (texts > 0)
    # sent once: the weights, which are learnt with it, follow by themselves
    shared = docs.sparkSession.sparkContext.broadcast(Model(mixer, head[order], counts[order], texts, tokens, types))
    del mixer, head, counts, rows
    rounds = 0
    while symbols > draw * GROWTH**rounds:
        rounds += 1
    dealt = docs.withColumn("_round", _round(draw / max(1, symbols), rounds, draw))
    asked = written(_asked(dealt.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"), "_round"), shared, parts), "asked")
    learnt = _opening(dealt.filter("_round = 0"), shared, grams, parts, step)
    for r in range(1, rounds + 1):
        _learn_round(asked.filter(F.col("place") == r), shared, grams, learnt)
    return Trained(shared, (learnt.weights, learnt.refined), tokens, types, words, grams, asked)


def _round(share: float, rounds: int, longest: int) -> Column:
    """The round that learns a text: 0 for ``share`` of the hashes and texts of at most ``longest`` bytes, then the shares grow."""
    hashed = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    if not rounds:
        return F.lit(0)
    out = F.when((hashed < share) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= longest), 0)
    for r in range(1, rounds):
        out = out.when(hashed < share * GROWTH**r, r)
    return out.otherwise(rounds)


def _less(counted: Counted, own: Counted) -> Counted:
    """``counted`` without the occurrences ``own``; both have their grams in order."""
    keys, counts = counted
    if not len(keys):
        return counted
    at = np.minimum(np.searchsorted(keys, own[0]), len(keys) - 1)
    hit = keys[at] == own[0]
    counts = counts.copy()
    counts[at[hit]] -= own[1][hit]
    return keys, counts


def _steps(texts: list[bytes], step: int) -> Iterator[list[bytes]]:
    """Runs of texts of ``step`` bytes at least, but for the last."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= step:
            yield held
            held, size = [], 0
    if held:
        yield held


ASKED = "kind string, batch long, part long, a binary, b binary"


def _ask_rows(texts: list[bytes], broad: np.ndarray, parts: int) -> list[tuple]:
    """(kind, part, a, b): the contexts of ``texts`` that aren't broadcast by part, and the texts."""
    rare = _rare_contexts(Distinct(texts), broad)
    cut = np.searchsorted(_ordered_part(rare, parts), np.arange(parts + 1))
    asks = [("ask", p, packed_keys(rare[i:j]), None) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
    return [*asks, ("texts", None, zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), packed(np.array([len(t) for t in texts])))]


def _asked_texts(row: pa.Table) -> list[bytes]:
    whole, ends = zstandard.ZstdDecompressor().decompress(row.column("a")[0].as_py()), np.cumsum(unpacked(row.column("b")[0].as_py()).astype(np.int64)).tolist()
    return [whole[i:j] for i, j in zip([0, *ends], ends)]


def _answer(asks: pa.Table, counted: pa.Table) -> pa.Table:
    """Symbols and counts of the contexts that each batch asked one part for."""
    rows = []
    keys, times = (unpacked_keys(counted.column("a")[0].as_py()), unpacked(counted.column("b")[0].as_py())) if counted.num_rows else (np.empty(0, U64), np.empty(0, U64))
    for batch, part, a in zip(asks.column("batch"), asks.column("part"), asks.column("a")):
        context = unpacked_keys(a.as_py())
        lo, hi = np.searchsorted(keys, context), np.searchsorted(keys, context | SYMBOL, side="right")
        at = _ranges(lo, hi - lo)
        rows.append((batch.as_py(), part.as_py(), packed(hi - lo), packed(keys[at] & SYMBOL), packed(times[at])))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("batch", pa.int64()), ("part", pa.int64()), ("n", pa.binary()), ("a", pa.binary()), ("b", pa.binary())))})


def _answers(asks: DataFrame, grams: DataFrame) -> DataFrame:
    return asks.select("batch", "part", "a").groupBy("part").cogroup(grams.groupBy("part")).applyInArrow(_answer, "batch long, part long, n binary, a binary, b binary")


def _answered(cases: Distinct, broad: np.ndarray, answers: pa.Table) -> Counted:
    """The counts of the cases' contexts that aren't broadcast, from what the parts answered."""
    answers = answers.sort_by("part")
    n, symbols, times = (np.concatenate([np.empty(0, U64), *(unpacked(x.as_py()) for x in answers.column(c))]) for c in ("n", "a", "b"))
    rare = _rare_contexts(cases, broad)
    return np.repeat(rare, n.astype(np.int64)) | symbols, times.astype(np.int64)


def _opening(docs: DataFrame, shared: Broadcast, grams: DataFrame, parts: int, step: int) -> Mixer:
    """A mixer whose weights and table are learnt from the texts of ``docs``, few as round 0 has, in the order of their hashes."""
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64("doc_id", "text").alias("order"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = sorted(zip(rows.column("order").to_pylist(), (t.lower() for t in texts_of(rows.combine_chunks().to_batches()[0], "text"))))
        made = _ask_rows([t for _, t in rows], shared.value.broad, parts)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        kind, part, a, b = (pa.array([r[i] for r in made], t) for i, t in enumerate(kinds))
        return pa.table({"kind": kind, "batch": pa.array(np.zeros(len(made), np.int64)), "part": part, "a": a, "b": b})

    def learn(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model, texts = shared.value, _asked_texts(texts)
        rare, mixer = _answered(Distinct(texts), model.broad, answers), Mixer()
        for some in _steps(texts, step):
            cases = Distinct(some)
            own = cases.grams, cases.gram_times
            mixer.adapt(cases, [_less((model.mixer.keys, model.mixer.counts), own), _less(rare, own)])
        return pa.table({"batch": pa.array([0], pa.int64()), "weights": pa.array([mixer.weights.tobytes()], pa.binary()), "refined": pa.array([mixer.refined.tobytes()], pa.binary()), "seen": pa.array([mixer.seen])})

    rows = written(hashed.groupBy(F.lit(0).alias("one")).applyInArrow(pack, ASKED), "draw")  # about DRAW bytes, so one task
    answers = _answers(rows.filter("kind = 'ask'"), grams)
    got = rows.filter("kind = 'texts'").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(learn, "batch long, weights binary, refined binary, seen double").collect()
    out = Mixer()
    for r in got:  # one row at most
        out.weights, out.refined, out.seen = np.frombuffer(r.weights).reshape(ORDERS, GATES), np.frombuffer(r.refined).reshape(2, -1).copy(), r.seen
    return out


SUMS = ((ORDERS, GATES), (ORDERS, GATES), (2, END * STEPS))


def _learn_round(asked: DataFrame, shared: Broadcast, grams: DataFrame, mixer: Mixer) -> None:
    """Corrects ``mixer`` once by all texts of ``asked``; an occurrence is predicted with all counts less its own, whatever else is in its batch."""
    weights = mixer.weights

    def errors(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model, mixer = shared.value, Mixer()
        mixer.weights, cases = weights, Distinct(_asked_texts(texts))
        mixer.look(cases, [(model.mixer.keys, model.mixer.counts), _answered(cases, model.broad, answers)], weigh=False, own=1)
        total = [np.zeros(shape) for shape in SUMS]
        for found in mixer.errors(cases):
            for x, y in zip(total, found):
                x += y
        return pa.table({"some": pa.array([texts.column("batch")[0].as_py() % 61], pa.int64()), "sums": pa.array([np.concatenate([x.ravel() for x in total]).tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, total = None, 0.0
        for batch in batches:
            for n, x in zip(*(batch.column(c) for c in ("some", "sums"))):
                some, total = n.as_py(), total + np.frombuffer(x.as_py())
        if some is not None:
            yield pa.RecordBatch.from_arrays([pa.array([some], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["some", "sums"])

    answers = _answers(asked.filter("kind = 'ask'"), grams)
    found = asked.filter("kind = 'texts'").select("batch", "a", "b").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(errors, "some long, sums binary")
    total = np.zeros(sum(a * b for a, b in SUMS))
    for r in written(found.groupBy("some").applyInArrow(added, "some long, sums binary"), "errors").orderBy("some").collect():  # 61 rows at most
        total += np.frombuffer(r.sums)
    mixer.correct(*(x.reshape(shape) for x, shape in zip(np.split(total, np.cumsum([a * b for a, b in SUMS])[:-1]), SUMS)))


def _rare_contexts(cases: Distinct, broad: np.ndarray) -> np.ndarray:
    """The contexts of the cases, in order, without those of ``broad``."""
    contexts = np.concatenate(cases.contexts) & ~SYMBOL
    contexts.sort()
    contexts = contexts[np.append(True, contexts[1:] != contexts[:-1])] if len(contexts) else contexts
    if not len(broad):
        return contexts
    return contexts[broad[np.minimum(np.searchsorted(broad, contexts), len(broad) - 1)] != contexts]


SCORED = "kind string, batch long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, part long, a binary, b binary"


def _asked(docs: DataFrame, shared: Broadcast, parts: int, sign: int = 1) -> DataFrame:
    """What the texts of ``docs`` (doc_id, text, held_out, _round) ask, in batches of one round; the round is the place of rows that aren't texts' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = shared.value, (TaskContext.get().partitionId() + 1) << 24
        end = np.log10(model.texts + 1.0)
        for batch in filled(batches, "text", BATCH, by="_round"):
            turn = batch.column("_round")[0].as_py()
            texts = [t.lower() for t in texts_of(batch, "text")]
            h, n = word_hashes(texts)
            place = np.repeat(np.arange(len(texts)), n)
            at = np.minimum(np.searchsorted(model.head, h), max(0, len(model.head) - 1)) if len(model.head) else np.zeros(len(h), np.int64)
            in_head = model.head[at] == h if len(model.head) else np.zeros(len(h), bool)
            logs = np.log10(model.head_counts + 1.0)
            base = np.bincount(place[in_head], logs[at[in_head]] if len(logs) else None, len(texts)) + end
            known = np.bincount(place[in_head], minlength=len(texts)) + (model.texts > 0)
            h, place = h[~in_head], place[~in_head]
            part = _part(h, parts)
            order = np.argsort(part, kind="stable")
            h, place, part = h[order], place[order].astype(np.uint32), part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            tails = [(p, h[i:j].tobytes(), place[i:j].tobytes()) for p, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
            none, k = pa.nulls, len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * k, pa.string()), pa.array(np.full(k, sign * number)), pa.array(np.arange(k, dtype=np.int32)), batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1), pa.array(known), pa.array(base), none(k, pa.int64()), none(k, pa.binary()), none(k, pa.binary())],
                names=[c.split()[0] for c in SCORED.split(", ")],
            )
            asked = _ask_rows(texts, model.broad, parts)
            kinds, tails = ["tail"] * len(tails) + [kind for kind, *_ in asked], [*tails, *(row for _, *row in asked)]
            k = len(tails)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(np.full(k, sign * number)), pa.array(np.full(k, turn, np.int32)), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), *(pa.array([t[i] for t in tails], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                names=[c.split()[0] for c in SCORED.split(", ")],
            )
            number += 1

    return docs.mapInArrow(run, SCORED)


def score(docs: DataFrame, *, folds: int = 7, held_out: int = 2, draw: int = DRAW, step: int = STEP_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits) of every row of ``docs``.

    Learns from the rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``; the score of such a row's text has its own
    counts in it. Weights are learnt from all these texts: from about ``draw`` bytes in steps of about ``step`` bytes, from the others in rounds. A null text is the
    empty text, one end token. Words are known by 64 bits of hash. ``bits`` is
    the whole text's code length; divide by its bytes for bits per byte. Rows that share a doc_id are
    scored each, equal texts alike. Without rows to learn from all counts are zero. A text of any
    length is scored whole, in a batch of its own. Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    out_of = doc_crc_mod("doc_id", folds) == held_out
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    parts = max(8, -(-size // PART_BYTES))
    trained = train(docs.filter(~out_of), parts, draw, step)
    shared, learnt, words, grams = trained.shared, trained.learnt, trained.words, trained.grams

    # texts that weren't learnt from; their batches are told apart from those of the others by their signs
    held = docs.filter(out_of).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True).alias("held_out"), F.lit(-1).alias("_round"))
    scored = trained.asked.unionByName(written(_asked(held, shared, parts, sign=-1), "asked"))

    def look_up(tails: pa.Table, counts: pa.Table) -> pa.Table:
        """Counts of one part's words, for every batch that asked: sums per place."""
        rows = []
        if counts.num_rows:
            keys, times = np.frombuffer(counts.column("a")[0].as_py(), U64), np.frombuffer(counts.column("b")[0].as_py(), np.int64)
            for batch, a, b in zip(tails.column("batch"), tails.column("a"), tails.column("b")):
                h, place = np.frombuffer(a.as_py(), U64), np.frombuffer(b.as_py(), np.uint32)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                places, nth = np.unique(place[hit], return_inverse=True)
                rows.append((batch.as_py(), places.tobytes(), np.bincount(nth, np.log10(times[at[hit]] + 1.0), len(places)).tobytes(), np.bincount(nth, minlength=len(places)).tobytes()))
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("batch", pa.int64()), ("places", pa.binary()), ("logs", pa.binary()), ("known", pa.binary())))})

    def per_place(table: pa.Table) -> pa.Table:
        places = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("places")]).astype(np.int64)
        logs, known = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("logs", np.float64), ("known", np.int64)))
        n = int(places.max(initial=-1)) + 1
        return pa.table({"batch": pa.array(np.full(n, table.column("batch")[0].as_py()), pa.int64()), "place": pa.array(np.arange(n, dtype=np.int32)), "more": pa.array(np.bincount(places, logs, n).astype(np.float64)), "more_known": pa.array(np.bincount(places, known, n).astype(np.int64))})

    def cost(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Bits of the texts of one batch, with what the parts answered."""
        model, asked = shared.value, _asked_texts(texts)
        model.mixer.weights, model.mixer.refined = learnt
        cases = Distinct(asked)
        counted = [(model.mixer.keys, model.mixer.counts), _answered(cases, model.broad, answers)]
        n = len(asked)
        return pa.table({"batch": pa.array([texts.column("batch")[0].as_py()] * n, pa.int64()), "place": pa.array(np.arange(n, dtype=np.int32)), "bits": pa.array(model.mixer.cost(cases, counted))})

    answers = _answers(scored.filter("kind = 'ask'"), grams)
    texts = scored.filter("kind = 'texts'").select("batch", "a", "b")
    bits = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cost, "batch long, place int, bits double")
    tails = scored.filter("kind = 'tail'").select("batch", "part", "a", "b")
    sums = tails.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(look_up, "batch long, places binary, logs binary, known binary")
    sums = sums.groupBy("batch").applyInArrow(per_place, "batch long, place int, more double, more_known long")
    rows = scored.filter("kind = 'doc'").drop("part", "a", "b").join(bits, ["batch", "place"]).join(sums, ["batch", "place"], "left")
    scale, log2 = float(np.log10(trained.tokens + trained.types + 1.0)), float(np.log10(2.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"), (-F.col("bits") * log2).alias("score"), "bits",
    )
