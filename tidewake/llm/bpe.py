"""BPE encoding and decoding of whole texts with reuse of content-defined chunks.

A text is cut at white space where a rolling hash of the bytes before it hits a fixed residue, so that
copies and shared passages are cut alike wherever they stand. A worker encodes each chunk once and
keeps what it made (up to a bound, across documents and tasks). The ids of a text are its chunks' ids
joined, and each join is repaired: the last run without white space before it and the first one after
it are encoded as one text, which must give the ids of both sides. Where it doesn't, the two chunks
become one, which is encoded as a whole, until all joins agree. What is known of a join holds for that
pair of runs alone.

A new chunk is put together from its runs, which are kept in the same way, if the tokenizer's file
shows that white space separates what it makes of them (``separable``); else it is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewake.llm.common import small_batches, texts_of

WINDOW = 8
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # as bytes.split has it
PUNCTUATION = b".,;:!?"
_STATE: dict[tuple, "ChunkEncoder"] = {}


def cut_points(texts: list[bytes], every: int) -> list[list[int]]:
    """Where chunks of each text begin after its start: at the first white space of a run, if a hash of the ``WINDOW`` bytes before hits 0 modulo ``every``."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(size + 1) - size - 1
    white = SPACE[raw]
    spaces = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    owner = np.searchsorted(begins, spaces, side="right") - 1
    inside = (spaces - begins[owner] >= WINDOW) & (spaces - begins[owner] < size[owner])
    spaces, owner = spaces[inside], owner[inside]
    value = np.zeros(len(spaces), np.uint64)
    for k in range(WINDOW, 0, -1):
        value = value * np.uint64(1099511628211) + raw[spaces - k]
    value ^= value >> np.uint64(29)
    hit = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) < np.uint64((1 << 24) // every)
    spaces, owner = spaces[hit], owner[hit]
    at, ends = (spaces - begins[owner]).tolist(), np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [at[i:j] for i, j in zip(ends, ends[1:])]


#: Splits that match runs of letters, single digits, runs of other signs, or English suffixes: none matches white space.
KNOWN_SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
SAFE_NORMALIZERS = {"NFC", "NFD", "Lowercase"}


def separable(spec: dict) -> bool:
    """True if ASCII white space between two runs surely separates what the tokenizer makes of them.

    It does where (1) the normalizer is made of canonical forms, which neither compose nor reorder across a
    space as it is a starter that composes with nothing; of lower case taken letter by letter; and of
    white space turned into one space; (2) the first pre-tokenizer drops all that its pattern doesn't match, and no
    match holds white space, so that matches before, inside and after a run are found independently;
    (3) BPE works inside matches; and (4) no added token holds white space or takes any off its sides.
    """

    def parts(x: dict | None, key: str) -> list[dict]:
        return [] if not x else x[key] if x["type"] == "Sequence" else [x]

    normal = all(n["type"] in SAFE_NORMALIZERS or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in parts(spec.get("normalizer"), "normalizers"))
    first, *rest = parts(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": ""}]
    dropped = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in KNOWN_SPLITS
    plain = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in rest)
    added = all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    return normal and dropped and plain and added and spec["model"]["type"] == "BPE" and not spec.get("post_processor")


def lowers(spec: dict) -> bool:
    """True if A-Z are lowered anyway."""
    return any(n["type"] == "Lowercase" for n in ((spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {"type": ""}]))


class Bounded:
    """A cache of at most ``most`` units in two generations: what isn't asked for again goes with the older one."""

    def __init__(self, most: int):
        self.most, self.held, self.now, self.old = most // 2, 0, {}, {}

    def get(self, key, weight: int = 1):
        value = self.now.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value, weight)
        return value

    def put(self, key, value, weight: int = 1) -> None:
        if self.held + weight > self.most:
            self.old, self.now, self.held = self.now, {}, 0
        self.now[key] = value
        self.held += weight


class ChunkEncoder:
    """Encodes texts by chunks. A result is (ids, tokens), both as text joined by spaces.

    ``pieces`` bounds the runs that are kept, ``chunk_bytes`` the text of the chunks that are kept,
    ``joins`` the pairs of runs around joins that are known to agree.
    """

    def __init__(self, path: str, every: int = 96, pieces: int = 300_000, chunk_bytes: int = 4 << 20, joins: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("a tokenizer whose decoder is other than joining tokens by spaces isn't supported")
        with open(path) as f:
            spec = json.load(f)
        self.separable = separable(spec)
        self.lowers, self.added = self.separable and lowers(spec), [t["content"].encode()[:2] for t in spec.get("added_tokens") or []]
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.numbers = [str(i) for i in range(len(self.names))]
        self.every, self.most = every, pieces // 2
        self.chunks, self.joins = Bounded(chunk_bytes), Bounded(joins)
        self.ids: dict[bytes, str] = {}
        self.tokens: dict[bytes, str] = {}
        self.older: tuple[dict[bytes, str], dict[bytes, str]] = ({}, {})
        self.silent: set[bytes] = set()  # runs without tokens

    def _encoded(self, texts: list[bytes]) -> list[tuple[str, str]]:
        numbers, names = self.numbers, self.names
        made = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return [(" ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids])) for ids in made]

    def _know(self, runs: Iterable[bytes]) -> None:
        """Sees to it that all of the runs are in ``ids`` and ``tokens``."""
        if len(self.ids) > self.most:
            self.older, self.ids, self.tokens, self.silent = (self.ids, self.tokens), {}, {}, set()
        missing = set(runs).difference(self.ids)
        kept = missing.intersection(self.older[0])
        self._keep((r, (self.older[0][r], self.older[1][r])) for r in kept)
        missing -= kept
        if not missing:
            return
        split = {}
        if self.separable:  # letters and signs after them are matched apart
            for run in missing:
                if run[-1] in PUNCTUATION and (core := run.rstrip(PUNCTUATION)).isalpha() and core.isascii():
                    split[run] = core, run[len(core) :]
            missing = missing.difference(split)
            more = set(chain.from_iterable(split.values())).difference(self.ids)
            kept = more.intersection(self.older[0])
            self._keep((r, (self.older[0][r], self.older[1][r])) for r in kept)
            missing |= more - kept
        unknown = list(missing)
        self._keep(zip(unknown, self._encoded(unknown)))
        self._keep((run, (f"{self.ids[a]} {self.ids[b]}", f"{self.tokens[a]} {self.tokens[b]}")) for run, (a, b) in split.items())

    def _keep(self, made: Iterable[tuple[bytes, tuple[str, str]]]) -> None:
        for run, (ids, tokens) in made:
            self.ids[run], self.tokens[run] = ids, tokens
            if not ids:
                self.silent.add(run)

    def _joined(self, runs: list[bytes]) -> tuple[str, str]:
        if self.silent and not self.silent.isdisjoint(runs):
            runs = [r for r in runs if r not in self.silent]
        return " ".join(map(self.ids.__getitem__, runs)), " ".join(map(self.tokens.__getitem__, runs))

    def _plain(self, chunk: bytes) -> bytes:
        """The chunk lowered, if that changes nothing of what the tokenizer sees."""
        return chunk.lower() if self.lowers and chunk.isascii() and not any(a in chunk for a in self.added) else chunk

    def _make(self, chunks: Iterable[bytes], whole: set[bytes]) -> dict[bytes, tuple[str, str]]:
        """Results of the chunks, from the cache or new."""
        made = {}
        for c in chunks:
            if c not in made:
                made[c] = self.chunks.get(c, len(c))
        new = [c for c, r in made.items() if r is None]
        apart = [c for c in new if self.separable and c not in whole]
        runs = [c.split() for c in apart]
        self._know(chain.from_iterable(runs))
        for c, x in zip(apart, runs):
            made[c] = self._joined(x)
        rest = [c for c in new if made[c] is None]
        made.update(zip(rest, self._encoded(rest)))
        for c in new:
            self.chunks.put(c, made[c], len(c))
        return made

    def _disagree(self, pairs: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
        """The pairs of neighbouring chunks whose join changes what is around it."""
        around = {}
        for a, b in pairs:
            if (right := b.split(None, 1)) and (left := a.rsplit(None, 1)):
                left, right = left[-1], right[0]
                sample = left + b[: len(b) - len(b.lstrip()) + len(right)]
                if self.joins.get(sample) is None:
                    around[a, b] = sample, left, right
        if not around:
            return set()
        self._know(chain.from_iterable(x[1:] for x in around.values()))
        samples = list({x[0] for x in around.values()})
        got = dict(zip(samples, self._encoded(samples)))
        bad = set()
        for pair, (sample, left, right) in around.items():
            if got[sample] == self._joined([left, right]):
                self.joins.put(sample, True)
            else:
                bad.add(pair)
        return bad

    def encode(self, texts: list[bytes]) -> list[list[tuple[str, str]]]:
        """For each text the results of its parts, in order; parts without tokens are left out."""
        parts = []
        for text, cuts in zip(texts, cut_points(texts, self.every)):
            at = [0, *cuts, len(text)]
            parts.append([self._plain(text[i:j]) for i, j in zip(at, at[1:]) if j > i])
        whole: set[bytes] = set()
        while bad := self._disagree({pair for p in parts for pair in zip(p, p[1:])}):
            for p in parts:
                i = 0
                while i + 1 < len(p):
                    if (p[i], p[i + 1]) in bad:
                        p[i : i + 2] = [p[i] + p[i + 1]]
                        whole.add(p[i])
                    else:
                        i += 1
        made = self._make(chain.from_iterable(parts), whole)
        return [[made[c] for c in p if made[c][0]] for p in parts]


def encoder(path: str, every: int) -> ChunkEncoder:
    """The worker's own encoder; it outlives tasks."""
    key = (path, every)
    if key not in _STATE:
        _STATE[key] = ChunkEncoder(path, every)
    return _STATE[key]


def encode_texts(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", every: int = 96, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Encodes and decodes each whole text: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Null and empty texts give no tokens and the digests of the empty text. A text of any length is
    held by one task as a whole, batches are cut by bytes. Repeated rows are encoded each (their chunks
    once). Other columns are ignored, whatever their names; an empty table gives an empty result.
    ``every`` is the mean number of runs of white space in a chunk.
    """
    more = ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, every)
        for batch in small_batches(batches, text_column, 1 << 20):
            made = coder.encode(texts_of(batch, text_column))
            ids, decoded = ([" ".join([m[k] for m in x]) for x in made] for k in (0, 1))
            n = np.array([x.count(" ") + 1 if x else 0 for x in ids], np.int64)
            digests = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c], pa.string()) for c in (ids, decoded)]
            columns = {id_column: batch.column(id_column), "n_tokens": pa.array(n), "ids_sha256": digests[0], "decoded_sha256": digests[1]}
            if with_ids:
                flat = pa.array([" ".join([x for x in ids if x])]) if n.any() else pa.array([], pa.string())
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pc.split_pattern(flat, " ").flatten().cast(pa.int32()))
            if with_decoded:
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(id_column, text_column).mapInArrow(run, schema)
