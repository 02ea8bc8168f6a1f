"""Fingerprints, codebooks and the source audit against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.test_queries import SF
from tidewake.llm import codebooks, contextmix, divergence, fingerprints, flatgraph, licenses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("range", "guard", "copies", "digest", "term", "side", "block", "whole", "code", "fingerprint", "_copy")})


# --- 11 ----------------------------------------------------------------------------------------


def entropy_of(window: bytes) -> int:
    top = fingerprints.WINDOW * int(math.log2(fingerprints.WINDOW)) << 20
    return (top - sum(int(fingerprints.WEIGHT[c]) for c in Counter(window).values())) * 1000 // top


def filters_of(text: bytes, rank: list[int]) -> list[set[int]]:
    """The bits of each filter, window by window and neighbourhood by neighbourhood."""
    n, w, near = len(text), fingerprints.WINDOW, fingerprints.NEAR
    ranked = [rank[entropy_of(text[i : i + w])] for i in range(n - w + 1)]
    points = Counter()
    for s in range(1 - near, len(ranked)):
        here = [(ranked[i], i) for i in range(max(0, s), min(len(ranked), s + near))]
        if here and min(here)[0] < fingerprints.NONE:
            points[min(here)[1]] += 1
    found = [text[i : i + w] for i in range(len(ranked)) if points[i] >= fingerprints.POINTS] or ([text] if text else [])
    hashes = list(dict.fromkeys(xxhash.xxh3_64_intdigest(f) for f in found))
    return [{h >> 11 * k & 2047 for h in hashes[i : i + 160] for k in range(5)} for i in range(0, len(hashes), 160)]


def like(a: list[set[int]], b: list[set[int]]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0

    def score(x, y):
        most, chance = min(len(x), len(y)), len(x) * len(y) / 2048
        floor = chance + 0.3 * (most - chance)
        return min(1.0, max(0.0, (len(x & y) - floor) / max(most - floor, 1e-9)))

    one = lambda x, y: sum(len(f) * max(score(f, g) for g in y) for f in x) / sum(len(f) for f in x)
    return one(a, b) if len(a) < len(b) else one(b, a) if len(b) < len(a) else max(one(a, b), one(b, a))


def bits(text: str) -> list[set[int]]:
    return [set(np.flatnonzero(np.unpackbits(f.view(np.uint8), bitorder="little")).tolist()) for f in fingerprints.Digest.read(text).chain]


def compared(rows: list[tuple], counts: Counter) -> Counter:
    """The operator's rows by brute force; ``counts``: windows by entropy."""
    order = sorted(range(1001), key=lambda e: (counts[e], e))
    rank = [0] * 1001
    for i, e in enumerate(order):
        rank[e] = i if e >= fingerprints.DULL else int(fingerprints.NONE)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).digest()))
    out, made = Counter(), {}
    of = lambda t: made.setdefault(t, filters_of(t.encode(), rank))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        changed = t[: len(t) - k] + after[:k]
        key = lambda x: tuple(tuple(sorted(f)) for f in of(x))
        out[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), key(t), key(changed), round(like(of(t), of(changed)), 9), round(like(of(t), of(after)), 9)] += 1
    return out


def given(df) -> Counter:
    key = lambda x: tuple(tuple(sorted(f)) for f in bits(x))
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, key(r.fingerprint), key(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def windows(rows: list[tuple]) -> Counter:
    return Counter(entropy_of(b[i : i + 32]) for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 31))


def test_fingerprints_by_brute_force(spark, monkeypatch):
    random.seed(5)
    words = "the tide wakes over grey stones près du rivage während Möwen rufen 日本語の文".split()
    prose = lambda n: " ".join(random.choices(words, k=n))
    odd = [None, "", "a", "a" * 500, "ab" * 40, "x" * 31, "y" * 32, "z" * 33, prose(5), "".join(map(chr, range(33, 160)))]
    rows = [(i, prose(random.randint(1, 300))) for i in range(30)] + list(enumerate(odd, 100)) + [(7, "other text of the same id"), (7, None), (None, prose(50)), (None, prose(60))] + [(55, prose(80))] * 5 + [(-3, prose(1500)), (9, prose(9))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = compared(rows, windows(rows))
    assert given(fingerprints.compare_edited(docs)) == want
    monkeypatch.setattr(fingerprints, "BATCH", 700)  # rows that are carried from batch to batch
    monkeypatch.setattr(fingerprints, "DRAWN", 1)
    assert given(fingerprints.compare_edited(docs.repartition(5))) == want
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0
    assert given(fingerprints.compare_edited(spark.createDataFrame([(1, prose(40))], "doc_id long, text string"))).total() == 1


def test_features_in_stretches(monkeypatch):
    rng = np.random.default_rng(4)
    buffer, rank = rng.integers(97, 101, 5000).astype(np.uint8), rng.permutation(1001)
    levels = fingerprints.entropies(buffer)
    assert levels.tolist() == [entropy_of(buffer[i : i + 32].tobytes()) for i in range(len(buffer) - 31)]
    found = fingerprints.features(buffer, rank[levels])
    for stretch in (64, 257):
        monkeypatch.setattr(fingerprints, "STRETCH", stretch)
        assert (fingerprints.entropies(buffer) == levels).all() and (fingerprints.features(buffer, rank[levels]) == found).all()


def test_fingerprints_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()][:40]
    made = fingerprints.compare_edited(docs.filter(F.col("doc_id").isin([i for i, _ in rows])))
    assert given(made) == compared(rows, windows(rows))


def test_fingerprints_tell_copies_from_others(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9)))
    text = " ".join(word() for _ in range(2000))
    long = " ".join(word() for _ in range(400_000))
    near, other = text[:3000] + " an edit of a few words " + text[3040:], " ".join(word() for _ in range(2000))
    docs = spark.createDataFrame([(1, text), (2, near), (3, other), (4, text), (5, long), (6, None)], "doc_id long, text string")
    made = {r.doc_id: r for r in fingerprints.fingerprint(docs.withColumn("fingerprint", F.lit(1))).collect()}
    of = {i: fingerprints.Digest.read(r.fingerprint) for i, r in made.items()}
    assert made[1].fingerprint == made[4].fingerprint and fingerprints.likeness(of[1], of[2]) > 0.7
    assert fingerprints.likeness(of[1], of[3]) < 0.05 and fingerprints.likeness(of[5], of[5]) == 1.0
    assert len(of[5].chain) > 200 and fingerprints.likeness(of[5], of[1]) < 0.1 and made[6].fingerprint == "0:"


# --- 12 ----------------------------------------------------------------------------------------


def coded(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4) -> list[tuple]:
    """(vec_id, code, error, label_error, digest) of (vec_id, embedding, label) by comparing every part with every entry."""
    kept = [(i, [math.floor(1024 * x) for x in e], b) for i, e, b in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    deep = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * deep : (p + 1) * deep]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                held[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, i), mine in held.items():
            books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, b, [nearest(v, p) for p in range(parts)]) for i, v, b in kept]
    by = Counter()
    for _, b, at in found:
        by[b] += sum(d for d, _ in at)
    return sorted(((i, "".join(f"{e:02x}" for _, e in at), sum(d for d, _ in at), by[b], digest) for i, b, at in found), key=str)


def test_codebooks_by_brute_force(spark):
    random.seed(3)
    near = lambda: [random.choice([-0.5, 0.25, 0.0, 0.001, 1.0]) for _ in range(8)]  # noqa: E731  many ties
    rows = [(i, near(), random.choice([1, 1, 2, None])) for i in range(60)] + [(3, near(), 9), (None, near(), 1), (None, [0.0] * 8, None), (500, None, 1), (501, [float("nan")] * 8, 1), (502, [None, *[1.0] * 7], 1), (503, [], 1), (504, [float("inf")] * 8, 1)]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3))
    made = codebooks.compress(table, entries=16)
    got = sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in made.collect()], key=str)
    assert got == coded(rows, entries=16)
    assert {"range", "whole", "term"} <= set(made.columns)
    few = codebooks.compress(table.filter("vec_id < 3")).collect()
    assert len(few) == 3 and all(r.error == 0 for r in few)
    assert codebooks.compress(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        codebooks.compress(table, entries=257)


def test_codebooks_of_odd_lengths(spark):
    rows = [(1, [0.5] * 6, "a"), (2, [0.25] * 6, "a"), (3, [0.5] * 7, "b"), (4, [0.5], None), (5, [1e30] * 6, "b"), (6, [-1e30] * 6, "b")]
    made = {r.vec_id: r for r in codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert len(made) == 6 and made[1].code == made[3].code and all(r.error == 0 for r in made.values())


@pytest.mark.parametrize("deep", [1, 3, 16])
def test_kd_tree(deep):
    rng = np.random.default_rng(deep)
    for wide in (2, 40, 5000):
        entries, parts = rng.integers(-wide, wide, (200, deep)), rng.integers(-wide, wide, (700, deep))
        at, far = codebooks.KdTree(entries).nearest(parts)
        d = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
        assert (far == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()


# --- 13 ----------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audited(rows: list[tuple], top: int = 200) -> list[tuple]:
    rows = [tuple(x or "" for x in r) for r in rows]  # (lang, source, text)
    words = [(a, s, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(t)]) for a, s, t in rows]
    out = []
    for lang in {a for a, _, _ in words}:
        mine = [(s, w) for a, s, w in words if a == lang]
        held = Counter(x for _, w in mine for x in set(w))
        kept = sorted((x for x, n in held.items() if n >= 3), key=lambda x: x.encode())
        count = {s: Counter() for s, _ in mine}
        for s, w in mine:
            count[s].update(x for x in w if held[x] >= 3)
        whole = sum(count.values(), Counter())
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (c.total() + len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = [(sum(f(p[s][x], p[t][x]) for x in kept), t) for t in count if t != s]
            term = [(f(p[s][x], q[x]), x) for x in kept if count[s][x] and p[s][x] > q[x]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda i: (-i[0], i[1].encode()))
                out += [(lang, s, part, x, v, k) for k, (v, x) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergences_by_brute_force(spark):
    random.seed(2)
    words = ["Tide", "tide", "TIDE", "wAKE", "é", "É", "日本", "don't", "a1b", "x", "y", "z", "ſ", "K", "\x00", " q", "😀", "word_s", "[", "`", "{"]
    text = lambda: random.choice([" ", "-", "\n", ""]).join(random.choices(words, k=random.randint(0, 30)))
    rows = [(random.choice(["en", "fr", "", None]), random.choice(["a", "b", "ç", "", None, "B"]), random.choice([text(), text(), text(), None, ""])) for _ in range(200)]
    rows += [("de", "only", "lone words"), ("es", "s", None), ("es", "t", ""), ("en", "hot", "tide " * 50_000)] + [("en", "a", "copy copy of a text")] * 4
    docs = clashing(spark.createDataFrame(rows, "lang string, source string, text string").repartition(4))
    got = lambda n=200, **size: sorted(map(tuple, divergence.divergences(docs, top=n, **size).collect()))
    want = audited(rows)
    assert got() == want and got(2) == audited(rows, 2)
    assert got(block=5, wide=2) == want
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_words_of_equal_hashes_are_told_apart():
    texts = ["tide wake", "", "Wake tide TIDE", "grey"]
    buffer = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    low, start, end, doc = divergence.pieces(buffer, offsets)
    words = [bytes(low[a:b]).decode() for a, b in zip(start, end)]
    assert words == ["tide", "wake", "wake", "tide", "tide", "grey"] and doc.tolist() == [0, 0, 2, 2, 2, 3]
    for digest in (xxhash.xxh3_64_intdigest, lambda w: 1, lambda w: len(w), lambda w: w[0]):
        group, model = divergence.same_words(low, start, end, digest)
        assert [words[model[g]] for g in group] == words and len(set(group.tolist())) == 3 == len(model)


def test_exact_shares():
    n, of = np.array([0, 5, 10**12, 7 * 10**14]), np.array([10**13, 5, 10**13, 8 * 10**14])
    assert divergence.shares(n, of, 3).tolist() == [1 + 10**9 * (int(a) + 1) // (int(b) + 3) for a, b in zip(n, of)]
    table = divergence.counted(pa.RecordBatch.from_pydict({"lang": ["a", "a"], "source": ["s", "t"], "text": ["x x y", "x"]}))
    assert sorted(zip(*table.to_pydict().values())) == [("a", "s", "", 0, 0), ("a", "s", "x", 2, 1), ("a", "s", "y", 1, 1), ("a", "t", "", 0, 0), ("a", "t", "x", 1, 1)]


# --- 9: learnt weights, and whole scores by brute force ----------------------------------------


def cases_of(text: bytes):
    """(contexts, symbol) of each symbol of a text; a context is its order and what it has seen."""
    sym = [256] * 4 + list(text) + [256]
    for i in range(4, len(sym)):
        word = []
        for x in reversed(sym[4:i]):
            if x == 256 or x in b" \t\n\v\f\r":
                break
            word.append(x)
        yield [(1, *sym[i - 1 : i]), (2, *sym[i - 2 : i]), (4, *sym[i - 4 : i]), ("word", *word[::-1])], sym[i]


def scored(train: list[bytes], texts: list[bytes], step: int) -> tuple[np.ndarray, list[float]]:
    """Weights and bits of each text by dictionaries, a decision at a time; ``train`` in the order in which it is drawn."""
    counts = defaultdict(Counter)
    for t in train:
        for contexts, symbol in cases_of(t):
            for c in contexts:
                counts[c][symbol] += 1
    paths = [list(zip(contextmix.NODES[s, :n].tolist(), contextmix.BITS[s, :n].tolist())) for s, n in enumerate(contextmix.SIZES)]
    weights, seen = np.full((4, contextmix.GATES), 0.3), 0.0
    ones, total = Counter(), Counter()

    def decisions(text, less):
        for contexts, symbol in cases_of(text):
            for d, (node, bit) in enumerate(paths[symbol]):
                pairs = []
                for c in contexts:
                    same = other = 0
                    for t, n in counts[c].items():
                        n -= less[c][t] if c in less else 0
                        if paths[t][:d] == paths[symbol][:d] and len(paths[t]) > d:
                            same, other = (same + n, other) if paths[t][d] == (node, bit) else (same, other + n)
                    pairs.append((math.log((same + 0.05) / (other + 0.05)), int(min(math.log2(same + other + 1), contextmix.GATES - 1))))
                yield node, bit, pairs

    def probability(node, bit, pairs):
        z = sum(weights[k][g] * o for k, (o, g) in enumerate(pairs)) * (2 * bit - 1)
        z = min(14.0, max(-14.0, z))
        p = 1 / (1 + math.exp(-z))
        cell = node, int(min(max((z + 9) * contextmix.STEPS / 18, 0), contextmix.STEPS - 1))
        return 0.5 * p + 0.5 * (ones[cell] + 8 * p) / (total[cell] + 8), p, cell

    held: list[bytes] = []
    for i, t in enumerate(train):
        held.append(t)
        if sum(map(len, held)) < step and i + 1 < len(train):
            continue
        less = defaultdict(Counter)
        for x in held:
            for contexts, symbol in cases_of(x):
                for c in contexts:
                    less[c][symbol] += 1
        rows = [(*d, *probability(*d)[1:]) for x in held for d in decisions(x, less)]
        change, times, n = np.zeros_like(weights), np.zeros_like(weights), len(rows)
        for node, bit, pairs, p, cell in rows:
            for k, (o, g) in enumerate(pairs):
                change[k, g] += (bit - p) * (2 * bit - 1) * o
                times[k, g] += 1
            ones[cell] += bit
            total[cell] += 1
        weights = weights + 0.4 / (1 + seen / 2e7) ** 0.5 * change / (times + 0.01 * n)
        seen, held = seen + n, []
    bits_ = []
    for t in texts:
        bits_.append(sum(-math.log2(p if bit else 1 - p) for node, bit, pairs in decisions(t, {}) for p in [probability(node, bit, pairs)[0]]))
    return weights, bits_


def test_context_mixing_by_brute_force(spark):
    random.seed(7)
    texts = [" ".join(random.choices(["Tide", "wakes", "over", "grey", "stones", "\u00fcber", "x"], k=random.randint(0, 25))) for _ in range(16)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in contextmix.score(docs, step=150).collect()}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    low = lambda t: (t or "").encode().lower()
    learnt = [i for i in got if not got[i].held_out]
    drawn = [low(texts[i]) for i in sorted(learnt, key=lambda i: (order[i], low(texts[i])))]
    weights, want = scored(drawn, [low(t) for t in texts], 150)
    trained = contextmix.train(docs.filter(F.col("doc_id").isin(learnt)), 8, step=150)
    assert np.allclose(trained.learnt[0], weights, atol=1e-4) and np.abs(weights - 0.3).max() > 0.02
    assert len(got) == len(texts) and 0 < len(learnt) < len(texts)
    for i, bits_ in enumerate(want):
        assert abs(got[i].bits - bits_) < 2e-3 * max(1.0, bits_) and abs(got[i].score + got[i].bits * math.log10(2)) < 1e-9 * max(1.0, bits_)


def test_scores_do_not_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    one, many = ({r.doc_id: r.bits for r in contextmix.score(docs.repartition(n, "doc_id")).collect()} for n in (1, 12))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-5 * max(1, one[i]) for i in one) and size > 400_000
    learnt = contextmix.train(docs, 8).learnt[0]
    assert (np.abs(learnt - 0.3) > 0.01).mean() > 0.6


def test_weights_are_learnt_from_all_texts(spark):
    """Beyond the draw, too: the table has each decision of all texts once, weights depend on all of them and not on tasks."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices(["Tide", "wakes", "over", "grey", "stones", "\u00fcber"], k=rng.randint(0, 30))) for _ in range(60)] + ["", None, "tide " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = [(t or "").encode().lower() for t in texts]
    decisions = sum(int(contextmix.SIZES[list(t) + [contextmix.END]].sum()) for t in low)
    assert sum(map(len, low)) > 16 * 300
    one, many = (contextmix.train(docs.repartition(n), 8, draw=300, step=100).learnt for n in (1, 7))
    assert one[1][1].sum() == many[1][1].sum() == decisions
    assert np.allclose(one[0], many[0], atol=1e-9) and np.allclose(one[1], many[1])
    less = contextmix.train(docs.filter("doc_id <> 62"), 8, draw=300, step=100).learnt
    assert one[1][1].sum() - less[1][1].sum() == contextmix.SIZES[list(low[62]) + [contextmix.END]].sum()
    assert np.abs(one[0] - less[0]).max() > 1e-4


def test_counts_less_the_occurrence_itself():
    mixer = contextmix.Mixer()
    mixer.count([b"abracadabra abba", b"cab", b"abra"])
    mixer.freeze()
    cases = contextmix.Distinct([b"abra", b"cab"])
    mixer.look(cases, [(mixer.keys, mixer.counts)], weigh=False, own=1)
    for i, (gram, first) in enumerate(zip(cases.grams, mixer.first)):
        counts = mixer.counts - (mixer.keys == gram)
        same, other, _ = contextmix.path_counts(cases.grams[i : i + 1], [(mixer.keys, counts)])
        n = contextmix.SIZES[int(gram) & 511]
        assert np.allclose(mixer.odds[first : first + n], np.log((same[:n] + 0.05) / (other[:n] + 0.05)), atol=1e-5)


def test_context_mixing_without_a_text_to_draw(spark):
    long = spark.createDataFrame([(i, "tide " * 300) for i in range(20)], "doc_id long, text string")
    rows = contextmix.score(long, draw=1000).collect()  # each text is longer than the draw: weights stay at their start
    assert len(rows) == 20 and len({round(r.bits, 6) for r in rows}) == 1


# --- 8: licences inside lines and between them --------------------------------------------------


def test_licences_whatever_line_ends_lie_inside(spark):
    prose = "some words of prose that have nothing to do with any of it, over and over again "
    names = ["MIT", "ISC", "Zlib", "BSD-2-Clause", "BSL-1.0"]
    texts = {k: t for k, t in licenses.templates() if k in names and len(t) > 300}
    gpl = licenses.NOTICES[0].format("the GNU General Public License, version 3")
    rows, want = [], set()
    for i, (k, t) in enumerate([*texts.items(), ("GPL-3.0", gpl)]):
        words = t.split(" ")
        for j, made in enumerate([prose * 9 + t + " " + prose * 9, "/* " + t + " */\nint main(void) {\n" + prose, "\n".join(" ".join(words[a : a + 9]) for a in range(0, len(words), 9)) + "\ncode();\n" + prose, "\n\n".join([prose + " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :]) + " " + prose])]):
            rows.append((10 * i + j, made))
            want.add((10 * i + j, k))
    rows += [(1000, prose * 50), (1001, "permission is hereby granted, free of charge"), (1002, "mit " * 40_000)]
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got.keys() and not [k for k in got if k[0] >= 1000]
    assert all(r.dice >= 0.85 and r.n_passages + r.n_windows > 0 for r in got.values()) and any(r.n_windows and not r.n_passages for r in got.values())


def test_windows_by_brute_force():
    random.seed(6)
    words = [w.encode() for w in "this software is provided as is under the mit license in any event".split()]
    known = [(f"L{i}", b" ".join(random.choices(words, k=random.randint(3, 25))).decode()) for i in range(12)]
    scanner = licenses.Scanner(known, 0.85)
    for _ in range(60):
        name, text = random.choice(known)
        inner = text.encode().split()
        for _ in range(random.randint(0, 2)):
            inner[random.randrange(len(inner))] = b"other"
        held = random.choices(words, k=random.randint(0, 9)) + inner + random.choices(words, k=random.randint(0, 9))
        want: dict[str, list] = {}
        for k, t in known:
            w = t.encode().split()
            for start in range(-len(w), len(held) + 1):
                votes = sum(held[start + j : start + j + 2] == w[j : j + 2] for j in range(len(w) - 1) if 0 <= start + j < len(held) - 1)
                mine, grams = set(zip(held[max(0, start) : start + len(w)], held[max(0, start) + 1 : start + len(w)])) if start + len(w) > 0 else set(), set(zip(w, w[1:]))
                if votes and 2 * votes >= scanner.share * (len(w) - 1) - 1e-9 and 2 * len(mine & grams) / (len(mine) + len(grams)) >= 0.85:
                    want.setdefault(k, []).append((2 * len(mine & grams) / (len(mine) + len(grams)), start))
        assert scanner.windows(held) == {k: (max(d for d, _ in v), len({s for _, s in v})) for k, v in want.items()}


# --- 10: the audit of recall --------------------------------------------------------------------


def test_audit_tells_the_recall_of_isolated_pairs(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4500, 48))
    y = x[:1500] / np.linalg.norm(x[:1500], axis=1, keepdims=True)
    away = rng.normal(size=y.shape)
    away -= (away * y).sum(axis=1, keepdims=True) * y
    cosine = rng.uniform(0.901, 0.93, (1500, 1))
    pairs = cosine * y + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    v = np.concatenate((x, pairs)).astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(v)
    table = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<float>")
    rows = flatgraph.near_vectors(table, shard_rows=256, overlap=1, target=0.5, sure=0.3, worst=0.1).collect()
    assert len(rows) == 6000 and true >= 2900
    found = sum(r.n_links for r in rows)
    assert found <= true and abs(rows[0].recall - found / true) < 0.03
    better = flatgraph.near_vectors(table, shard_rows=256, overlap=1, target=0.98).collect()
    assert found <= sum(r.n_links for r in better) <= true and abs(better[0].recall - sum(r.n_links for r in better) / true) < 0.02


def test_lower_bounds():
    assert flatgraph.lower_bound(0, 0) == 0.0 and 0.99 < flatgraph.lower_bound(1000, 1000) < 1.0 and flatgraph.lower_bound(5, 5) < 0.6
    assert flatgraph.lower_bound(95, 100) < 0.95 < flatgraph.lower_bound(9800, 10000)
