"""The training-data operators against brute force, round trips and edge cases on small tables."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.test_queries import SF, TABLES, canonical
from tidewake.llm import bigru, bpe, chat, contextmix, dartminhash, flatgraph, licenses, mixing, nndescent, queries, shingles, warc
from tidewake.llm.common import fresh_path
from tidewake.llm.components import components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert canonical(got) == canonical(con.execute(queries.ORACLE_SQL[name]).df())


# --- 1 -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, None, None), (3, "u\r\nX: y", "x"), (3, "http://c", "x"), (None, "n", "x"), (5, "e", ""), (6, "l", "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages.withColumn("payload", F.lit("clash")).withColumn("sha", F.lit("clash")), frame_bytes=1000)
    out = warc.read_archives(manifest).collect()
    frames = manifest.select("bundle", "frame").distinct().count()
    assert frames > 2 and warc.read_archives(manifest, task_bytes=100).rdd.getNumPartitions() >= frames
    assert [r.url for r in warc.read_records(manifest, spark.createDataFrame([(None,), (None,), (77,)], "page_id long")).collect()] == ["n"]
    assert len(out) == len(rows)
    for r in out:
        text = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(text) and r.payload_digest == base64.b32encode(hashlib.sha1(text).digest()).decode()
        assert r.record_type == "revisit" or bytes(r.payload) == text
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert {(1, "revisit", 3), (3, "response", None), (None, "revisit", 3), (2, "revisit", 5), (5, "response", None)} <= kinds
    one = warc.read_records(manifest, spark.createDataFrame([(6,)], "page_id long")).collect()
    assert len(one) == 1 and one[0].payload_bytes == 600000
    big = warc.read_archives(warc.write_archives(pages, min_bytes=100)).filter("record_type = 'revisit'")
    assert big.count() == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# --- 2 -----------------------------------------------------------------------------------------


def test_chat_layouts(spark):
    record = "named_struct('instruction', 'do', 'input', cast(null as string), 'output', 'done') as r"
    assert [tuple(t) for t in chat.canonical_turns(spark.range(1).selectExpr(record), "r").first().turns] == [("system", "do"), ("user", ""), ("assistant", "done")]
    texts = ['{"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]}', '{"prompt": "p", "response": "q"}', '{"odd": 1}', None, "{broken"]
    rows = chat.canonical_turns(spark.createDataFrame([(t,) for t in texts], "r string"), "r", aliases=chat.ALIASES).collect()
    assert [[tuple(t) for t in r.turns] if r.turns is not None else None for r in rows] == [[("user", "a"), ("assistant", "b")], [("user", "p"), ("assistant", "q")], None, None, None]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1).selectExpr("named_struct('z', 1) as r"), "r")
    texts = [
        '{"id": 7, "dialog": [{"speaker": "gpt", "utterance": "a"}]}', '{"messages": []}', '{"messages": [{"role": "user", "content": "a"}, {"role": "user", "value": "LOST"}]}',
        '{"conversations": [{"from": "x", "value": null}, {"from": "y", "value": "b"}]}', '{"turns": "none"}', '{"messages": ["a"]}',
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, r string").withColumns({"_fingerprint": F.lit(1), "_parts": F.lit(2)})
    made = chat.format_turns(chat.canonical_turns(table, "r"))
    rows = made.orderBy("i").collect()
    assert [[tuple(t) for t in r.turns] if r.turns is not None else None for r in rows] == [[("gpt", "a")], [], None, [("x", ""), ("y", "b")], None, None]
    assert all(r["_fingerprint"] == 1 and r["_parts"] == 2 for r in rows) and rows[1].formatted == "" and rows[2].formatted is None
    for again in (lambda: chat.canonical_turns(made, "r"), lambda: chat.format_turns(made)):
        with pytest.raises(ValueError):
            again()
    assert chat.canonical_turns(table.limit(0), "r").count() == 0


def test_chat_layouts_of_the_query(spark):
    long = "x" * 3_000_000
    rows = [(c, t, r, x) for c in range(8) for t, (r, x) in enumerate([("user", "a\\u0000\n\u2028\"é"), ("gpt", long if c == 3 else ""), ("assistant", None)])] + [(1, 1, "gpt", ""), (None, 0, None, "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.canonical_turns(chat.conversation_json(chat.conversation_records(table)), "record").collect()
    for r in made:
        assert [tuple(t) for t in r.turns] == [(b or "", x or "") for _, _, b, x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
    assert len({r.record[:6] for r in made}) == 4


def test_chat_reads_back_what_it_wrote(spark):
    random.seed(4)
    pieces = ["</turn>", "###", "\\", "\n", ": ", "### Assistant: ", "\\t", "\\h", "a", "é", "</turn>\n", "=", " "]
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool: x", "", None]), random.choice(["".join(random.choices(pieces, k=random.randint(0, 9))), None])) for c in range(30) for t in range(random.randint(1, 5))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.chat_digest(chat.format_turns(chat.canonical_turns(chat.conversation_records(table), "record"))).collect()
    for r in made:
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.loss_chars == len(loss) and r.n_turns == len(turns)


# --- 3 -----------------------------------------------------------------------------------------


def weighted_jaccard(a, b, n=5):
    def grams(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()

    x, y = grams(a), grams(b)
    common = sum((x & y).values())
    return common / max(1, sum(x.values()) + sum(y.values()) - common)


def grouped(texts, least=0.8):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and texts[i].split() and texts[j].split() and weighted_jaccard(texts[i], texts[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def varied(seed, n, words=120, edits=8):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,most", [(32, 512), (4, 6)])
def test_near_duplicates_match_brute_force(spark, small, most):
    texts = [*varied(1, 60), *varied(2, 20), None, "", "  \n", "one two", "one two", "One  two", "a b c d e f", "unlike all the others here", "z " * 4000, "z " * 4000]
    got = dartminhash.near_duplicates(docs_of(spark, texts).withColumn("bands", F.lit(1)).withColumn("row", F.lit(1)), small=small, most=most).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == grouped(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert dartminhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("small,most", [(4, 512), (4, 3)])
def test_near_duplicates_inside_a_longer_text(spark, small, most):
    """Excerpts of one text that share nothing it lacks; two bands of one row, so that all share every key."""
    rng = random.Random(8)
    long = [f"w{i}" for i in range(1300)]
    texts = [" ".join(w if rng.random() > 0.001 else "y" for w in long) for _ in range(12)]
    texts += [" ".join(long[i : i + 1000]) for i in (0, 90, 150, 210, 300)]
    texts += [" ".join(long[i : i + 400]) for i in (0, 40, 500, 530, 880)]
    got = dartminhash.near_duplicates(docs_of(spark, texts), small=small, most=most, bands=64, rows=1).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == grouped(texts)


def test_groups_around_a_pivot_meet_exactly(spark):
    """All that share a key, whatever their size: the pairs that are found cover every linked pair of different components."""
    rng = random.Random(6)
    base = [rng.randrange(1 << 32) for _ in range(60)]
    sets = [sorted({*rng.sample(base, rng.randrange(30, 61)), *(rng.randrange(1 << 32) for _ in range(rng.randrange(12)))}) for _ in range(150)]
    sets += [sorted({*s[: len(s) - 2], rng.randrange(1 << 32)}) for s in sets[100:]]
    sets[0] = sorted(base)
    units = spark.createDataFrame([(i, bytearray(np.array(s, np.uint32).tobytes())) for i, s in enumerate(sets)], "node long, units binary")
    for most in (512, 5):
        around = spark.createDataFrame([(i, 0, i) for i in range(len(sets))], "doc long, p long, c long")
        met = dartminhash._met(around, units, 0.8, most).collect()
        pairs = {frozenset((r.a, r.b)) for r in met if r.b is not None}
        keys = {}
        for r in met:
            if r.key is not None:
                keys.setdefault(r.key, set()).add(r.a)
        like = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.8
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if like(i, j)]
        assert len(linked) > 60 and all(frozenset(x) in pairs or all(like(i, 0) for i in x) or any({*x} <= k for k in keys.values()) for x in linked)
        assert all(len(k) > most for k in keys.values()) and (most > 5 or keys)


def test_members_around_a_pivot_that_are_unlike_make_no_pairs(spark):
    """Each lacks other 40 of the pivot's 100 units: all meet on a prefix, none is linked to another, so few pairs may be written, not all 19,900."""
    rng = random.Random(7)
    base = sorted(rng.sample(range(1 << 32), 100))
    sets = [base, *(sorted(rng.sample(base, 60)) for _ in range(200))]
    sets.append(sorted(sets[1][:-1] + [rng.randrange(1 << 32)]))  # like one of them
    units = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint32).tobytes())) for i, s in enumerate(sets)], "node long, units binary")
    around = spark.createDataFrame([(i, 0, i) for i in range(len(sets))], "doc long, p long, c long")
    pairs = {frozenset((r.a, r.b)) for r in dartminhash._met(around, units, 0.8, 512).collect()}
    assert frozenset((1, 201)) in pairs and len(pairs) < 200


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(None, text), (1, text), (1, text), (2, text), (2, "quite another text of some words"), (None, "p q r s t u"), (None, "p q r s t u"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, dartminhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (None, None, True), (None, None, True), (None, None, True)], key=str)
    kept = dartminhash.one_of_each(docs.selectExpr("doc_id", "text", "doc_id as n", "text as bands"))
    assert kept.columns == ["doc_id", "text", "n", "bands"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (2, rows[4][1]), (None, rows[5][1]), (None, None)], key=str)
    assert dartminhash.one_of_each(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_similarity():
    texts = [t.encode() for t in varied(7, 12, 300, 12)]
    made = dartminhash.dart_signatures(*shingles.shingle_counts(texts), 512)
    assert np.isfinite(made).all()
    for i in range(11):
        true = weighted_jaccard(texts[i].decode(), texts[i + 1].decode())
        assert abs((made[i] == made[i + 1]).mean() - true) < 0.1


def test_darts_fall_on_weights_of_any_size():
    rng = np.random.default_rng(4)
    keys = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    sets = [rng.choice([0.0, 0.3, 1.0, 2.5, 7.0, 900.0], 40) for _ in range(6)]
    sets.append(sets[0] * np.where(rng.random(40) < 0.3, 0.8, 1))
    made = dartminhash.dart_signatures(np.tile(keys, len(sets)), np.concatenate(sets), np.full(len(sets), 40), 2000)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert abs((made[i] == made[j]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    assert np.isinf(dartminhash.dart_signatures(keys[:2], np.zeros(2), np.array([2, 0]), 8)).all()


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 91
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4 -----------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(3)
    odd = ["", None, " ", "a", "it's  we 're ́x", "e\ń ́", "<|endoftext|> a <|endoftext|>b", "a\x0bb\x0cc\x85d　e", "x" * 5000, "don 't I'LL", "ΑΣ Σ ß İ", "\x00\x01 \x7f"]
    texts = odd + ["".join(rng.choices("ab 'é\n\tΣ1!́", k=200)) for _ in range(40)] + [" ".join(rng.choices(["hello", "world", "ab-cd", "12,5"], k=3000))] * 2
    got = bpe.encode_texts(docs_of(spark, texts), WORD_BPE, every=3, with_ids=True, with_decoded=True).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_repairs_joins_that_disagree(tmp_path):
    """A tokenizer that keeps white space with the word after it and knows a token over a space: joins change their surroundings."""
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
                  "vocab": {c: i for i, c in enumerate([" ", "a", "b", "c", "d", "b ", "b c", "ab", "d "])}, "merges": [["b", " "], ["b ", "c"], ["d", " "]]},
    }
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    tok = Tokenizer.from_file(str(path))
    rng = random.Random(5)
    coder = bpe.ChunkEncoder(str(path), every=1)
    assert not coder.separable
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(30))
        for _ in range(2):
            assert " ".join(a for a, _ in coder.encode([text.encode()])[0]) == " ".join(map(str, tok.encode(text, add_special_tokens=False).ids))


def test_bpe_knows_when_white_space_separates():
    spec = json.loads(open(WORD_BPE).read())
    assert bpe.separable(spec) and bpe.lowers(spec)
    assert not bpe.separable(spec | {"normalizer": {"type": "NFKC"}}) and not bpe.separable(spec | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True, "trim_offsets": True}})
    tok, rng = Tokenizer.from_file(WORD_BPE), random.Random(7)
    letters = "aB'Σσςß́ǅİ漢ก한ع١9.,!<|>\x85\u3000\u2028\x1c_-"
    coder = bpe.ChunkEncoder(WORD_BPE, every=2, pieces=400, chunk_bytes=5000, joins=100)
    for _ in range(300):
        text = "".join(rng.choices([*letters, *" \n\t\x0b", "<|endoftext|>", "<|ENDOFTEXT|>", "Word, ", "don't "], k=120))
        got = coder.encode([text.encode(), b"", text[7:].encode()])
        for parts, x in zip(got, (text, "", text[7:])):
            assert " ".join(a for a, _ in parts) == " ".join(map(str, tok.encode(x, add_special_tokens=False).ids))


@pytest.mark.parametrize("text", ["漢字かな" * 1500 + "\n" + "語ü" * 5000 + " end", "a" + " " * 10_000 + "b", "\x0c a b", "\x0b\x0c \x0bx\x0by \x0c", "one\x0ctwo three\x0b four", "漢" * 2000 + " x", "x " + "漢" * 3000, "ไทย" * 2000 + "\n한국어 " * 900 + "عربى " * 900, "AB <|EndOfText|> <|endoftext|>Cd"])
def test_bpe_of_long_runs_and_odd_white_space(text):
    coder = bpe.ChunkEncoder(WORD_BPE, every=1)
    ids = Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert " ".join(a for a, _ in coder.encode([text.encode()])[0]) == " ".join(map(str, ids))


def test_bpe_of_empty_tables_and_clashing_names(spark):
    docs = docs_of(spark, ["a b", "a b", None]).withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)})
    rows = bpe.encode_texts(docs, WORD_BPE).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [2, 2, 0] and rows[0].ids_sha256 == rows[1].ids_sha256
    assert bpe.encode_texts(docs.limit(0), WORD_BPE).count() == 0


# --- 5 -----------------------------------------------------------------------------------------


def test_mix_keeps_all_and_meets_the_limit(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "big" if i % 5 else "small", 0) for i in range(200)] + [(500, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_schedule(docs, block_tokens=100).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    uses = Counter((r.source, r.epoch) for r in out)
    assert all(e <= 2 for _, e in uses)
    tokens = Counter()
    for r in out:
        tokens[r.source] += r.n_tokens
    total = {s: sum(1 + i % 9 for i, *_, in [(r[0],) for r in rows[:200]] if (i % 5 == 0) == (s == "small")) for s in ("big", "small")}
    assert tokens["small"] / total["small"] <= 2.1 and tokens["big"] >= total["big"]
    assert sorted((r.block, r.place) for r in out) == sorted({(r.block, r.place) for r in out})
    assert mixing.mix_schedule(docs.limit(0)).count() == 0
    assert {r.doc_id for r in mixing.mixed(docs).collect()} == {r[0] for r in rows}
    flat = mixing.source_plan(spark.createDataFrame([("a", 1000), ("b", 10)], "source string, n long"), target_entropy=0.9).collect()
    w = [r.weight for r in flat]
    assert abs(-sum(x * math.log2(x) for x in w) - 0.9) < 1e-3


def test_mix_of_repeated_rows_ties_and_clashing_names(spark):
    rows = [(i % 7, "one two three", "s" if i % 3 else "t", i) for i in range(40)] + [(None, "", None, 99), (None, None, "u", 98)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _source int").withColumns({"_last": F.lit(1), "_use": F.lit(2), "n_tokens": F.lit(3), "weight": F.lit(4)})
    out = mixing.mix_schedule(docs, block_tokens=20).collect()
    assert sorted((r.block, r.place) for r in out) == sorted({(r.block, r.place) for r in out})
    want = Counter((r[0], r[2] or "") for r in rows)
    first = Counter((r.doc_id, r.source) for r in out if r.epoch == 0)
    assert first == want
    back = mixing.mixed(docs)
    assert back.columns == docs.columns
    uses = Counter(r["_source"] for r in back.collect())
    assert set(uses) == {r[3] for r in rows} and Counter((r.doc_id, r.source) for r in out) == Counter((r.doc_id, r.source or "") for r in back.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


# --- 6 and 10 ----------------------------------------------------------------------------------


def vectors_of(spark, seed=1, n=300, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[40:80] = x[40] + rng.normal(size=(40, dim)).astype(np.float32) * 0.05
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * dim, 0), (1002, [float("nan")] + [1.0] * (dim - 1), 0), (1003, [None] + [1.0] * (dim - 1), 0), (1004, [float("inf")] * dim, 0), (None, [1.0] * dim, 0)]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int"), x.astype(np.float64)


def test_nearest_against_brute_force(spark):
    table, x = vectors_of(spark)
    got = nndescent.nearest(table, k=20, block=64).orderBy("query_id", "rank").collect()
    found = total = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:20]
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        found, total = found + len({r.vec_id for r in mine} & set(order)), total + 20
    assert found / total >= 0.95
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    few = nndescent.nearest(table.filter("vec_id < 5 or vec_id = 20"), k=20).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, i) for q in (0, 20) for i in range(1, 6)]
    assert nndescent.nearest(table.limit(0)).count() == 0


def test_search_by_parts_of_a_list_and_from_a_narrower_search(spark):
    """Lists expanded a few nodes at a time and lists that go on from narrower ones find what brute force does."""
    x = np.random.default_rng(8).normal(size=(200, 12))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, vec array<double>")
    edges = [(i, int(j), float(x[i] @ x[j])) for i in range(200) for j in np.argsort(-(x @ x[i]))[:13].tolist() if i != j]
    graph = spark.createDataFrame(edges, nndescent.EDGES)
    queries = nodes.filter("rep % 40 = 0")
    true = {q: sorted((i for i in range(200) if i != q), key=lambda i: -(x[q] @ x[i]))[:10] for q in range(0, 200, 40)}
    narrow = nndescent.search(nodes, graph, queries, width=15, expand=4)
    wide = nndescent.search(nodes, graph, queries, start=narrow, width=60, expand=7)
    for found, width, least in ((narrow, 15, 0.7), (wide, 60, 0.95)):
        rows = found.collect()
        assert all(abs(r.score - x[r.query] @ x[r.node]) < 1e-9 and r.query != r.node for r in rows)
        assert len({(r.query, r.node) for r in rows}) == len(rows)
        mine = {q: {r.node for r in rows if r.query == q} for q in true}
        assert all(len(m) <= width for m in mine.values())
        assert np.mean([len(mine[q] & set(t)) / 10 for q, t in true.items()]) >= least


def test_a_hop_joins_a_row_for_each_open_node(spark, monkeypatch):
    """However many places a node's neighbours lie in, it has one row of links; what is found doesn't depend on places."""
    x = np.random.default_rng(9).normal(size=(200, 12))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, vec array<double>")
    edges = [(i, int(j), float(x[i] @ x[j])) for i in range(200) for j in np.argsort(-(x @ x[i]))[:13].tolist() if i != j]
    graph, queries, rows, kept = spark.createDataFrame(edges, nndescent.EDGES), nodes.filter("rep % 40 = 0"), [], nndescent.bucketed

    @contextmanager
    def counted(df, key):
        with kept(df, key) as out:
            rows.append((key, out.count(), out.select(key).distinct().count()))
            yield out

    monkeypatch.setattr(nndescent, "bucketed", counted)
    few, many = ({(r.query, r.node): r.score for r in nndescent.search(nodes, graph, queries, width=30, block=b).collect()} for b in (4096, 8))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-12 for k in few)
    assert [n == distinct for key, n, distinct in rows if key == "node"] == [True, True]
    assert [distinct for key, _, distinct in rows if key == "area"][1] > 8


def test_a_hop_takes_the_links_of_one_query_at_a_time(spark, monkeypatch):
    """Links of a query's open nodes are never collected into one row: rows of thousands of links, 256 of them in a batch, took an executor's memory."""
    x = np.random.default_rng(5).normal(size=(120, 8))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, vec array<double>")
    edges = [(i, int(j), float(x[i] @ x[j])) for i in range(120) for j in np.argsort(-(x @ x[i]))[:9].tolist() if i != j]
    plans, kept = [], nndescent.written

    def seen(df, name, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name, *rest)

    monkeypatch.setattr(nndescent, "written", seen)
    got = nndescent.search(nodes, spark.createDataFrame(edges, nndescent.EDGES), nodes.filter("rep % 40 = 0"), width=119, block=16).collect()
    hops = [p for p in plans if "areas" in p]
    assert hops and not any(re.search(r"collect_list\((areas|nbrs)", p) for p in hops)
    assert all(abs(r.score - float(x[r.query] @ x[r.node])) < 1e-12 for r in got)
    assert len({(r.query, r.node) for r in got}) == len(got) > 3 * 60


def test_first_lists_and_offers_are_arrays(spark):
    """A tree makes a row for each node, however many neighbours it has; nodes alone in their block have none."""
    x = np.random.default_rng(3).normal(size=(300, 6))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, vec array<double>")
    rows = nndescent._first_graph(nodes, 300, 8, 3, 64, 7).collect()
    assert len(rows) == 3 * 300 and max(len(r.nbrs) for r in rows) == 8
    assert all(r.node not in r.nbrs and np.allclose(x[r.nbrs] @ x[r.node], r.scores) for r in rows if r.nbrs)
    alone = nndescent._first_graph(nodes.limit(1), 1, 8, 2, 64, 7).collect()
    assert [(r.nbrs, r.scores) for r in alone] == [([], []), ([], [])]
    assert np.array_equal(nndescent._unpacked(nndescent._packed(x).slice(7, 20)), x[7:27]) and nndescent._unpacked(nndescent._packed(x[:0])).shape[0] == 0


def test_lists_merged_and_drawn_many_at_once():
    rng = np.random.default_rng(4)
    n, degree, sample = 40, 6, 2
    held = pa.table({"node": rng.permutation(n) * 10, "cell": np.arange(n), "nbrs": [[] for _ in range(n)], "scores": [[] for _ in range(n)], "new": [[] for _ in range(n)]})
    held = held.cast(pa.schema({"node": pa.int64(), "cell": pa.int64(), "nbrs": pa.list_(pa.int64()), "scores": pa.list_(pa.float64()), "new": pa.list_(pa.bool_())}))
    score, known = rng.normal(size=(n, n)), {i: {} for i in range(n)}
    for turn in range(4):
        node = rng.integers(0, n, 60)
        nbrs = [rng.choice(np.flatnonzero(np.arange(n) != i), 5, replace=False) for i in node]
        offers = pa.table({"node": node * 10, "nbrs": [(j * 10).tolist() for j in nbrs], "scores": [score[i, j].tolist() for i, j in zip(node, nbrs)]})
        before = {r["node"]: dict(zip(r["nbrs"], r["new"])) for r in held.to_pylist()}
        cells = dict(zip(held.column("node").to_pylist(), held.column("cell").to_pylist()))
        held = nndescent._merged(held, offers, degree, sample, turn)
        for i, j in zip(node, nbrs):
            known[i] |= {int(o) * 10: score[i, o] for o in j}
        for r in held.to_pylist():
            want = sorted(known[r["node"] // 10], key=lambda o: -known[r["node"] // 10][o])[:degree]
            was = before[r["node"]]
            assert r["nbrs"] == want and r["cell"] == cells[r["node"]] and r["added"] == len(set(want) - set(was))
            new = [o for o in want if was.get(o, True)]
            assert r["fresh"] == min(sample, len(new)) == len(set(r["drawn"][: r["fresh"]]) & set(new)) and len(r["drawn"]) - r["fresh"] == min(sample, len(want) - len(new))
            assert {o for o, f in zip(r["nbrs"], r["new"]) if f} == set(new) - set(r["drawn"])
    edges = [(j, r["node"], i < r["fresh"]) for r in held.to_pylist() for i, j in enumerate(r["drawn"])]
    drew = {}
    for j, i, new in edges:
        drew.setdefault((j, new), set()).add(i)
    mates = nndescent._mates(pa.table({c: [e[k] for e in edges] for k, c in enumerate(("node", "of", "new"))}), held, sample, 9).to_pylist()
    own = {r["node"]: (set(r["drawn"][: r["fresh"]]), set(r["drawn"])) for r in held.to_pylist()}
    for r in mates:
        new, every = {o for o, f in zip(r["of"], r["new"]) if f}, set(r["of"])
        assert own[r["at"]][0] <= new and own[r["at"]][1] <= every and len(r["of"]) == len(every) <= 4 * sample
        back = drew.get((r["at"], True), set())
        assert new - own[r["at"]][0] <= back and len(new & back) >= min(sample, len(back))
    assert {r["at"] for r in mates} == {i for i in own if own[i][0] or drew.get((i, True))}


def test_shards_of_queries_give_what_single_queries_give(spark, monkeypatch):
    """The lists of many queries meet in one task; what is found doesn't depend on how many do."""
    x = np.random.default_rng(6).normal(size=(150, 8))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, vec array<double>")
    edges = [(i, int(j), float(x[i] @ x[j])) for i in range(150) for j in np.argsort(-(x @ x[i]))[:7].tolist() if i != j]
    graph, found = spark.createDataFrame(edges, nndescent.EDGES), []
    for many in (1, 1000):
        monkeypatch.setattr(nndescent, "QUERIES_AT_ONCE", many)
        found.append({(r.query, r.node): r.score for r in nndescent.search(nodes, graph, nodes.filter("rep % 10 = 0"), width=25, block=32).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 15 * 25 and all(abs(s - found[1][k]) < 1e-12 for k, s in found[0].items())


def test_flat_graph_against_brute_force(spark):
    table, x = vectors_of(spark)
    got = {r.vec_id: r for r in flatgraph.near_vectors(table.withColumn("node", F.lit(1))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(300)])
    assert [got[i].n_links for i in range(300)] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(300)] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1005)) and None in got
    assert flatgraph.near_vectors(table.limit(0)).count() == 0


def test_flat_graph_over_shards_and_a_group_larger_than_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    x[:260] = x[0] + rng.normal(size=(260, 12)) * 0.12  # larger than a shard, and not all linked with all
    x[300:360] = np.repeat(x[300:320], 3, axis=0) + rng.normal(size=(60, 12)) * 0.2
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, [1.0, 2.0]), (7, [float(v) for v in x[400]])], "vec_id long, embedding array<double>")
    rows = flatgraph.near_vectors(table.withColumn("shards", F.lit(1)), shard_rows=100).collect()
    x = np.vstack([x, x[400]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in rows if r.vec_id != 7}
    assert len(rows) == 902 and rows[0].recall >= 0.999 and got[2000].n_links == 0
    found = sum(min(got[i].n_links, near[i].sum()) for i in range(900) if i != 7)
    assert found >= 0.999 * near[[i for i in range(900) if i != 7]].sum() and all(got[i].n_links <= near[i].sum() for i in range(900) if i != 7)
    assert got[400].n_links == 1 + (near[400].sum() - 1) and got[400].component_id == 7 and sorted(r.n_links for r in rows if r.vec_id == 7) == sorted([near[7].sum(), near[900].sum()])


def test_the_search_scores_what_it_looks_at_alone():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    x = np.vstack([x, x[:50] + 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = flatgraph.robust_prune(x, 12)
    lists = np.full((len(x), max(map(len, near))), -1)
    for i, o in enumerate(near):
        lists[i, : len(o)] = o
    s = flatgraph.range_search(x[:40], x, lists, flatgraph.medoids(x, lists), 0.9, 0.1, 16)
    true = x[:40] @ x.T
    looked = s > -np.inf
    assert np.allclose(s[looked], true[looked]) and looked.mean() < 0.7
    assert (looked & (true >= 0.9)).sum() >= 0.99 * (true >= 0.9).sum()


def test_nearest_over_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 10))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(40, [float(v) for v in x[40]]), (41, [float(v) for v in x[90]]), (3000, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(0)).withColumn("rank", F.lit(0))
    got = nndescent.nearest(table, k=10, query_divisor=100).collect()
    all_ids, all_x = [r[0] for r in rows[:-1]], np.vstack([x, x[40], x[90]])
    found = 0
    for q in range(0, 1500, 100):
        s = all_x @ x[q]
        best = sorted(((-v, i) for v, i in zip(s, all_ids) if i != q))[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        found += len({m[1] for m in mine} & {b[1] for b in best})
    assert found >= 0.95 * 150 and got[0].recall >= 0.9


# --- 7 -----------------------------------------------------------------------------------------


def test_gru_gradients_are_right():
    model = bigru.ByteBiGRU(["a", "b"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    data, sizes, _ = bigru.windows_of([b"hello there", b"xyz"])
    label = np.array([0, 1])
    grads, loss = model.gradients(data, sizes, label)
    for key in ("xf", "ub", "uf", "v", "c"):
        at = np.unravel_index(np.abs(grads[key]).argmax(), grads[key].shape)
        kept = model.weights[key][at]
        model.weights[key][at] = kept + 1e-2
        up = model.gradients(data, sizes, label)[1]
        model.weights[key][at] = kept - 1e-2
        down = model.gradients(data, sizes, label)[1]
        model.weights[key][at] = kept
        assert abs((up - down) / 2e-2 - grads[key][at]) < 0.05 * abs(grads[key][at]) + 1e-4


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    words = {"en": ["the", "with", "shall", "thing", "that"], "fr": ["été", "où", "leçon", "être", "pâte"]}
    texts = [(i, " ".join(rng.choices(words[lang], k=40)), lang, "s", 0) for i, lang in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame([*texts, (900, None, "en", "s", 0), (901, "12 34 !", "en", "s", 0), (902, "the with", None, "s", 0)], DOCS)
    got = {r.doc_id: r for r in bigru.identify(docs).collect()}
    assert len(got) == 123 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [t for t in texts if got[t[0]].held_out]
    assert sum(got[t[0]].lang_pred == t[2] for t in held) / len(held) >= 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert bigru.identify(docs.limit(0)).count() == 0


def test_network_against_a_loop_over_bytes():
    """Whole-text probabilities by a plain loop: windows, both directions, every position, the mean."""
    model, texts = bigru.ByteBiGRU(["a", "b", "c"], hidden=4), [b"hello there", "é ü 漢 ".encode() * 30, b"x" * 64, b""]
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(data, side):
        h, out = np.zeros(4), {}
        for t in range(len(data)) if side == "f" else range(len(data) - 1, -1, -1):
            x, u = w["x" + side][:, data[t]], w["u" + side] @ h
            z, r = sigmoid(x[:4] + u[:4]), sigmoid(x[4:8] + u[4:8])
            h = h + z * (np.tanh(x[8:] + r * u[8:]) - h)
            out[t] = h
        return out

    for text, got in zip(texts, model.documents(texts)):
        total = np.zeros(3)
        for i in range(0, len(text), bigru.WINDOW):
            data = text[i : i + bigru.WINDOW].ljust(bigru.WINDOW, b"\0")
            f, b = states(data, "f"), states(data, "b")
            for t in range(min(bigru.WINDOW, len(text) - i)):
                p = np.exp(w["v"] @ np.concatenate((f[t], b[t])) + w["c"][:, 0])
                total += p / p.sum()
        assert np.allclose(got, total / max(1, len(text)), atol=1e-4)


def test_language_of_odd_rows(spark):
    model = bigru.ByteBiGRU(["a", "b"], hidden=2)
    model.weights = {k: v * 0 for k, v in model.weights.items()}  # all ties
    docs = spark.createDataFrame([(1, "abc", 5), (1, "abc", 6), (None, "ü" * 200_000, 7), (2, "", 8)], "doc_id long, text string, label int").withColumn("score2", F.lit(1))
    rows = bigru.predict_language(docs, model).orderBy("label").collect()
    assert [(r.lang_pred, round(r.score, 6), r.label) for r in rows] == [("a", 0.5, 5), ("a", 0.5, 6), ("a", 0.5, 7), ("und", 0.0, 8)]
    with pytest.raises(ValueError):
        bigru.predict_language(docs.withColumn("Score", F.lit(1)), model)
    assert [r.lang_pred for r in bigru.predict_language(docs, None).collect()] == ["und"] * 4


# --- 8 -----------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = licenses.TEXTS["MIT"]
    texts = ["prose before\nReleased under the MIT License.\nprose", mit, "intro\n\n" + mit[:400] + "\n" + mit[400:] + "\n\nmore words", "nothing here", None, "word", "licensed UNDER cc-by-nc 4.0"]
    got = licenses.scan_licenses(docs_of(spark, texts).withColumn("license", F.lit("x"))).collect()
    assert {(r.doc_id, r.license) for r in got} == {(0, "MIT"), (1, "MIT"), (2, "MIT"), (6, "CC-BY-NC-4.0")}
    more = ["Copyright 2020 X. Released under the MIT License. And more", "Title\n\n" + mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS") + "\n\n" + "prose of some words " * 40, licenses.TEXTS["Zlib"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. "), "w " * 50_000, licenses.TEXTS["BSD-3-Clause"], None, None]
    again = licenses.scan_licenses(docs_of(spark, more)).collect()
    assert {(r.doc_id, r.license) for r in again if r.doc_id != 4} == {(0, "MIT"), (1, "MIT"), (2, "Zlib")} and (4, "BSD-3-Clause") in {(r.doc_id, r.license) for r in again}
    assert all(r.dice <= 1 for r in got) and next(r.dice for r in got if r.doc_id == 1) == 1.0
    assert licenses.scan_licenses(docs_of(spark, texts).limit(0)).count() == 0


# --- 9 -----------------------------------------------------------------------------------------


def test_scores_and_base(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["Alpha", "beta", "gamma", "ü", "delta"], k=rng.randrange(60))) for _ in range(80)] + [None, "", "unseen words only"]
    rows = {r.doc_id: r for r in contextmix.score(docs_of(spark, texts).withColumn("bits", F.lit(1))).collect()}
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    counts = Counter(x for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        want = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t))
        r = rows[i]
        assert abs(r.base_score - want) < 1e-9 * max(1, abs(want)) and r.n_tokens == len(tokens(t)) and r.n_known == sum(counts[x] > 0 for x in tokens(t)) and r.train_tokens == n and r.score < 0
    assert contextmix.score(docs_of(spark, texts).limit(0)).count() == 0


def test_scores_of_odd_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [(held[0], "alpha beta " * 30_000), (held[0], "alpha"), (held[0], "alpha"), (held[1], None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"kind": F.lit(1), "batch": F.lit(2)})
    rows = contextmix.score(docs).collect()  # nothing to learn from
    assert len(rows) == 4 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)
    assert len({r.score for r in rows if r.n_tokens == 2}) == 1 and sorted(r.n_tokens for r in rows) == [1, 2, 2, 60_001]
    more = contextmix.score(docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "kind", "batch"))).collect()
    assert len(more) == 8 and sum(r.doc_id is None for r in more) == 4 and all(r.n_known > 0 for r in more)


def test_mixer_is_a_distribution_and_learns():
    m = contextmix.Mixer()
    for _ in range(3):
        m.learn([b"abracadabra " * 40])
    m.freeze()
    # after one prefix, the probabilities of all next bytes and of the end add up to one
    before = m.bits([b"abra"])[0]
    ends = [2.0 ** -(m.bits([b"abra" + bytes([c])])[0]) for c in (97, 98)]
    assert before > 0 and max(ends) < 1
    cases = contextmix.Distinct([b"ab"])
    path = np.array([2.0 ** -sum(-np.log2(0.5) for _ in range(n)) for n in contextmix.SIZES])
    assert abs(path.sum() - 1) < 1e-12 and len(cases.symbols) == 3
    assert m.bits([b"abracadabra abracadabra"])[0] < 0.3 * m.bits([b"qzxjv wkpyg qzxjv wkpyg"])[0]
    assert np.allclose(m.bits([b"abra", b"", b"cad"]), np.concatenate([m.bits([b"abra"]), m.bits([b""]), m.bits([b"cad"])]))


def test_contexts_do_not_share_counts_however_many():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(90_000)]
    mixer = contextmix.Mixer()
    for _ in range(2):
        for i in range(0, len(words), 15_000):
            mixer.learn([" ".join(words[i : i + 15_000]).encode()])
    mixer.freeze()
    known = [w.encode() for w in rng.choices(words, k=2000)]
    assert mixer.bits([b" ".join(known)])[0] / (8 * len(known)) < 2.6


def test_path_counts_and_probabilities_by_brute_force():
    texts = [b"abracadabra abba", b"", b"cab \xc3\xbc cab"]
    cases = contextmix.Distinct(texts)
    counted = dict(zip(cases.grams.tolist(), cases.gram_times.tolist()))
    same, other, first = contextmix.path_counts(cases.grams, [(cases.grams[:0], cases.gram_times[:0]), (cases.grams, cases.gram_times)], block=5)
    for g, at in zip(cases.grams.tolist(), first):
        s, context = g & 511, [(t & 511, n) for t, n in counted.items() if t >> 9 == g >> 9]
        for d in range(contextmix.SIZES[s]):
            node, bit = contextmix.NODES[s, d], contextmix.BITS[s, d]
            ways = [sum(n for t, n in context for e in range(contextmix.SIZES[t]) if (contextmix.NODES[t, e], contextmix.BITS[t, e]) == (node, b)) for b in (bit, 1 - bit)]
            assert [same[at + d], other[at + d]] == ways
    # a node's probability doesn't depend on the symbol that is asked for: those of all symbols add up to one
    mixer = contextmix.Mixer()
    for _ in range(3):
        mixer.learn(texts * 9)
    mixer.freeze()
    cases = contextmix.Distinct([bytes([c]) for c in range(256)] + [b""])
    mixer.look(cases, [(mixer.keys, mixer.counts)])
    case, node, bit, places = next(cases.decisions(mixer.first))
    final = mixer.predict(sum(mixer.weighted[at] for at in places), node, bit)[0]
    begins = cases.contexts[0] == contextmix.Distinct([b""]).contexts[0][0]
    probability = np.exp(np.bincount(case, np.log(np.where(bit == 1, final, 1 - final)), len(begins)))
    assert begins.sum() == 257 and abs(probability[begins].sum() - 1) < 1e-4


def test_asked_contexts_score_like_broadcast_ones(spark, monkeypatch):
    rng = random.Random(4)
    docs = docs_of(spark, [" ".join(rng.choices(["Alpha", "beta", "gamma", "ü", "delta"], k=rng.randrange(60))) for _ in range(60)] + [None, "", "unseen"])
    got = []
    for grams in (0, 400, 1 << 40):
        monkeypatch.setattr(contextmix, "GRAMS", grams)
        got.append({r.doc_id: r.bits for r in contextmix.score(docs).collect()})
    assert len(got[0]) == 63 and all(x.keys() == got[0].keys() and all(abs(x[i] - got[0][i]) < 1e-6 * max(1, got[0][i]) for i in x) for x in got)


# --- every operator on an empty table, and the stages on odd rows ---


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    words = ["th" + c + d for c in "aeiou" for d in "nrst"]
    rng = random.Random(3)
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", i) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s1", 20), (3, "a wholly different text that shares the number of another one", "en", None, 21), (None, texts[4], None, "s0", 22), (None, "one more text without any number at all here", None, None, 23), (40, None, "en", "s0", 24), (41, "", "en", "s0", 25), (42, "99 -- 99", "en", "s1", 26), (43, "word " * 40_000, "en", "s1", 27)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("mine"), "lang_pred": F.col("n_chars"), "row": F.col("n_chars"), "_use": F.lit(1), "bands": F.lit(2), "ids": F.lit(0)})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "encode":
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns and all(r.score == "mine" and r.lang_pred == r.n_chars == r.row for r in out.collect())
        assert stage(spark, empty, SF).count() == 0
    got = {r.n_chars for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()}
    assert {0, 1, 2, 4, 21, 23, 24, 25, 27} <= got and len(got & {3, 20}) == 1 and 22 not in got
    assert {r.n_chars for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}.isdisjoint({24, 25, 26})


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("th", "sh", "wi", "an", "er") for b in ("at", "ing", "ou", "ed")]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", "12345 !!", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)], DOCS)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        where = fresh_path(spark, name)
        stage(spark, docs, SF).write.parquet(where)
        docs = steps[name] = spark.read.parquet(where)
        assert name == "encode" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in steps["language"].collect()} == set(range(42))
    assert {r.doc_id for r in steps["near_duplicates"].collect()} == {i for i, c in enumerate(grouped(texts[:42])) if i == c}
    uses = Counter(r.doc_id for r in steps["mix"].collect())
    assert set(uses) == {r.doc_id for r in steps["near_duplicates"].collect()} and max(uses.values()) <= 3
    tok = Tokenizer.from_file(WORD_BPE)
    for r in steps["encode"].collect():
        assert r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert Counter(r.doc_id for r in steps["encode"].collect()) == uses


def test_costs_are_those_of_the_predicted_ways():
    """The folded table of ``cost`` gives what ``predict`` gives decision by decision, and a run of places has the symbols that single places have."""
    texts, rng = [b"the ship keeps its course", b"a course the ship kept", b"", b"zzz"], np.random.default_rng(4)
    mixer = contextmix.Mixer()
    mixer.count(texts[:2])
    mixer.freeze()
    mixer.refined[1] += rng.integers(0, 300, mixer.refined.shape[1])
    mixer.refined[0] += np.floor(mixer.refined[1] * rng.random(mixer.refined.shape[1]))
    cases = contextmix.Distinct(texts)
    got = mixer.cost(cases, [(mixer.keys, mixer.counts)])
    bits = np.zeros(len(cases.symbols))
    for case, node, bit, places in cases.decisions(mixer.first):
        final = mixer.predict(sum(mixer.weighted[at] for at in places), node, bit)[0]
        np.add.at(bits, case, -np.log2(np.where(bit == 1, final, 1 - final)))
    assert np.allclose(got, cases.per_text(bits), rtol=1e-5)
    sym = rng.integers(0, 257, 40).astype(np.uint16)
    assert (contextmix._last_four(sym, slice(5, 40)) == contextmix._last_four(sym, np.arange(5, 40))).all()
