"""Alignment of two tokenizers over a corpus: which of their tokens stand for the same bytes.

Both tokenizers' tokens cover the same bytes of a text. Where both end at once the text is cut into
groups; every token of one tokenizer is linked with every token of the other in its group. A pair of
ids counts the documents that hold it linked.

A pair is one integer, the first id above 32 bits and the second below. Tasks count the pairs of
their documents with ``np.unique``; the partial counts are sorted over the whole corpus by one range
exchange, and a task sums the runs of equal keys in its range. It leaves them as a shard: two files
in the shared folder, sorted keys and their counts. The last pass maps these files into memory and
finds the counts of its own pairs by binary search, so no task holds the table of counts, and
nothing of it is broadcast but the first and last key of each shard.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parcelgraph.sources.shared import delete, shared_dir

from . import bpe, util

#: Links expanded at a time, tokens of documents taken together, partial counts that a task holds.
_LINKS, _TOKENS, _HELD = 2_000_000, 500_000, 2_000_000
#: Pairs in a shard, about.
_SHARD = 1_000_000


@dataclass(frozen=True)
class _Pair:
    """The files of a byte-level tokenizer and a piece tokenizer, as bytes, and the lengths in bytes
    of their ids."""

    spec: str
    unsure: frozenset[str]
    pieces: bytes
    lengths: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def read(byte_level_file: str, piece_file: str) -> _Pair:
        spec, model = Path(byte_level_file).read_text(encoding="utf-8"), Path(piece_file).read_bytes()
        vocab = json.loads(spec)["model"]["vocab"]
        first = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in vocab.items():
            first[k] = len(token)  # one printable character stands for each byte
        return _Pair(spec, bpe.unsure_characters(spec), model, (first, np.array([len(b) for b in bpe.piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=model))], np.int64)))


def encode(docs: DataFrame, pair: _Pair, id_col: str, text_col: str) -> DataFrame:
    """id, a and b: little-endian unsigned 16-bit ids of space + text under both tokenizers.

    Both are empty where the bytes of either's tokens are not those of space + text.
    """
    schema = T.StructType([util.field(docs, id_col), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    if max(map(len, pair.lengths)) > 1 << 16:
        raise ValueError("ids above 16 bits are not supported")

    def run(batches):
        files = shared.value
        first, second = bpe.ByteLevelEncoder(files.spec, files.unsure), bpe.PieceEncoder(files.pieces)

        def both(text: str) -> tuple[bytes, bytes]:
            b = second(text) if text else None
            return (b"", b"") if b is None else (first(" " + text), b)

        for batch in batches:
            for from_row in range(0, batch.num_rows, 1000):
                part = batch.slice(from_row, 1000)
                made = [both(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *(pa.array([m[k] for m in made], pa.binary()) for k in (0, 1))], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


class Block:
    """Some documents' tokens, one after another, cut into groups.

    All documents' bytes are covered by both tokenizers, so their ends end groups as well.
    """

    def __init__(self, a: list[bytes], b: list[bytes], lengths: tuple[np.ndarray, np.ndarray]):
        self.docs = len(a)
        self.ids = [np.frombuffer(b"".join(x), "<u2").astype(np.int64) for x in (a, b)]
        ends = [np.cumsum(n[i]) for n, i in zip(lengths, self.ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        self.group = [np.searchsorted(common, e) for e in ends]
        self.sizes = [np.bincount(g, minlength=len(common)) for g in self.group]
        self.tokens = [np.array([len(x) // 2 for x in side], np.int64) for side in (a, b)]
        # a document's last token of the first tokenizer tells the group in which it ends
        last = np.cumsum(self.tokens[0])
        upto = np.where(last > 0, self.group[0][last - 1] + 1, 0) if len(common) else np.zeros(self.docs, np.int64)
        self.groups = np.diff(upto, prepend=0)
        self.doc_of_group = np.repeat(np.arange(self.docs), self.groups)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, times): how often each document links each pair of ids."""
        ids, group = self.ids, self.group
        times = self.sizes[1][group[0]]  # partners of each token of the first tokenizer
        start = (np.cumsum(self.sizes[1]) - self.sizes[1])[group[0]]
        doc = self.doc_of_group[group[0]] if len(group[0]) else group[0]
        upto = np.cumsum(times)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(times):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + _LINKS, "right")))
            n = times[begin:end]
            total = int(n.sum())
            partner = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[begin:end], n)
            # document above 32 bits, ids below them in 16 bits each
            packed = np.repeat((doc[begin:end] << 32) | (ids[0][begin:end] << 16), n) | ids[1][partner]
            found.append(np.unique(packed, return_counts=True))
            begin = end
        packed, count = _summed(found)
        return packed >> 32, ((packed >> 16 & 0xFFFF) << 32) | (packed & 0xFFFF), count

    def texts(self) -> list[str]:
        """Each document's groups: ids of the first tokenizer, |, ids of the second; groups by ;"""
        before = [np.cumsum(s) - s for s in self.sizes]
        n = [len(i) for i in self.ids]
        parts = np.empty(sum(n), object)
        for k, (own, sign) in enumerate(((self.ids[0], "|"), (self.ids[1], ";"))):
            if not len(own):
                continue
            g = self.group[k]
            last = np.append(g[1:] != g[:-1], True)
            at = np.arange(n[k]) + (before[1][g] if k == 0 else before[0][g] + self.sizes[0][g])
            parts[at] = np.where(last, _decimals(sign)[own], _decimals(",")[own])
        ends = np.cumsum(self.tokens[0] + self.tokens[1])
        return ["".join(parts[e - m : e].tolist())[:-1] for e, m in zip(ends, self.tokens[0] + self.tokens[1], strict=True)]


_decimal: dict[str, np.ndarray] = {}


def _decimals(sign: str) -> np.ndarray:
    if sign not in _decimal:
        _decimal[sign] = np.array([f"{k}{sign}" for k in range(1 << 16)], object)
    return _decimal[sign]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all lists and their counts added up."""
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def blocks(batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, Block]]:
    """(first row, rows, block) over a batch of :func:`encode`, of about _TOKENS tokens or one row."""
    a, b = batch.column(batch.schema.get_field_index("a")).to_pylist(), batch.column(batch.schema.get_field_index("b")).to_pylist()
    begin, size = 0, 0
    for k in range(len(a) + 1):
        more = len(a[k]) // 2 if k < len(a) else 0
        if k > begin and (k == len(a) or size + more > _TOKENS):
            yield begin, k - begin, Block(a[begin:k], b[begin:k], lengths)
            begin, size = k, 0
        size += more


def partial_counts(tokens: DataFrame, lengths: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, n: documents with each pair, as counted by each task."""
    schema = "key long, n long"
    arrow = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    shared = tokens.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        found, fresh = [], 0
        for batch in batches:
            for _, _, block in blocks(batch, shared.value):
                _, keys, _ = block.links()
                found.append(np.unique(keys, return_counts=True))
                fresh += len(found[-1][0])
                if fresh > _HELD:
                    found = [_summed(found)]
                    fresh = 0
                    if len(found[0][0]) > _HELD:
                        yield from out(found.pop())
        yield from out(_summed(found))

    def out(pair):
        for k in range(0, len(pair[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in pair], schema=arrow)

    return tokens.select("a", "b").mapInArrow(run, schema)


def _store(uri: str) -> tuple[stores.FileSystem, str]:
    if uri.startswith("file:"):
        return stores.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (stores.LocalFileSystem(), uri) if "://" not in uri else stores.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Shards:
    """Sorted counts of pairs in files, and the largest count of each first id."""

    paths: list[str]
    firsts: np.ndarray
    sizes: np.ndarray
    best: np.ndarray

    def opened(self) -> CountShards:
        return CountShards(self)


class CountShards:
    """Looks counts up; a shard is mapped into memory when first asked for."""

    def __init__(self, shards: Shards):
        self.shards, self.held = shards, {}

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            path, n = self.shards.paths[k], int(self.shards.sizes[k])
            arrays = []
            for kind in ("keys", "counts"):
                store, at = _store(f"{path}.{kind}")
                if isinstance(store, stores.LocalFileSystem):
                    arrays.append(np.memmap(at, "<i8", "r", shape=(n,)))
                else:  # no file to map: one shard at a time is read whole
                    self.held.clear()
                    arrays.append(np.frombuffer(store.open_input_file(at).read(), "<i8"))
            self.held[k] = tuple(arrays)
        return self.held[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted ``keys``, all of which are in the shards."""
        out = np.empty(len(keys), np.int64)
        if not len(keys):
            return out
        shard = np.searchsorted(self.shards.firsts, keys, "right") - 1
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for begin, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            known, n = self._shard(int(shard[begin]))
            out[begin:end] = n[np.searchsorted(known, keys[begin:end])]
        return out


def count_shards(partial: DataFrame, to: str) -> Shards:
    """Sum the partial counts in ranges of keys and leave each range as a shard below ``to``.

    Each attempt of a task writes files of its own; those of the attempt that Spark keeps are
    listed, so lost and repeated tasks do no harm.
    """
    shards = max(1, -(-partial.count() // _SHARD))
    schema = "a int, best long, path string, first long, n long"
    arrow = pa.schema([("a", pa.int32()), ("best", pa.int64()), ("path", pa.string()), ("first", pa.int64()), ("n", pa.int64())])

    def run(batches):
        path = f"{to}/shard-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        best: dict[int, int] = {}
        first, total, rest = None, 0, None
        store, at = _store(path)
        store.create_dir(at.rsplit("/", 1)[0])
        with store.open_output_stream(f"{at}.keys") as keys_file, store.open_output_stream(f"{at}.counts") as counts_file:

            def put(keys, counts):
                nonlocal total
                keys_file.write(keys.astype("<i8").tobytes())
                counts_file.write(counts.astype("<i8").tobytes())
                total += len(keys)
                ids = keys >> 32
                cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                for i, m in zip(ids[cut].tolist(), np.maximum.reduceat(counts, cut).tolist(), strict=True):
                    best[i] = max(m, best.get(i, 0))

            for batch in batches:
                if not batch.num_rows:
                    continue
                new = (batch.column(0).to_numpy(), batch.column(1).to_numpy())
                keys, counts = _summed([new] if rest is None else [rest, new])
                # a key that goes on in the next batch stays behind
                first_of = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, counts = keys[first_of], np.add.reduceat(counts, first_of)
                if first is None:
                    first = int(keys[0])
                if len(keys) > 1:
                    put(keys[:-1], counts[:-1])
                rest = (keys[-1:], counts[-1:])
            if rest is not None:
                put(*rest)
        if total:
            rows = [(i, m, None, None, None) for i, m in sorted(best.items())] + [(None, None, path, first, total)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    ranges = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    made = util.materialize(ranges.mapInArrow(run, schema), "alignment-manifest")
    listed = made.where("path is not null").select("path", "first", "n").orderBy("first").collect()
    best = np.zeros(1 << 16, np.int64)
    for r in made.where("a is not null").groupBy("a").agg(F.max("best").alias("best")).collect():  # ids of a vocabulary
        best[r.a] = r.best
    util.drop_table(made)
    return Shards([r.path for r in listed], np.array([r["first"] for r in listed], np.int64), np.array([r.n for r in listed], np.int64), best)


@contextlib.contextmanager
def aligned(docs: DataFrame, byte_level_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> Iterator[DataFrame]:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for every row of ``docs``.

    The first tokenizer encodes space + text, the second text, before which it puts a space itself.
    n_links counts pairs of token occurrences in a group; n_best those whose pair has the largest
    count of all pairs of its first id; count_sum adds the counts of all links' pairs. groups is the
    alignment as text: ``a1,a2|b1;a3|b2,b3``. Special tokens' strings inside texts are plain text.

    A text that is null, empty, or that either tokenizer doesn't give back byte for byte has no
    tokens: zeros and an empty string, and it counts for no pair. Repeated rows and null ids are
    documents like others; an empty table gives no rows; other columns are not read. Texts of any
    length are aligned whole. The frame reads tables that end with the context: write what is needed
    of it before.
    """
    pair = _Pair.read(byte_level_file, piece_file)
    tokens = util.materialize(encode(docs, pair, id_col, text_col), "alignment-tokens", compression="zstd")
    to = f"{shared_dir(docs.sparkSession)}/alignment-counts-{uuid.uuid4().hex}"
    partial = util.materialize(partial_counts(tokens, pair.lengths), "alignment-partial", compression="zstd")
    shards = count_shards(partial, to)
    util.drop_table(partial)
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([util.field(docs, id_col), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups", T.StringType())])
    arrow = to_arrow_schema(schema)
    # first keys of the shards and one number for each id of the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((pair.lengths, shards))

    def run(batches):
        lengths, known = shared.value
        found = known.opened()
        for batch in batches:
            for begin, n, block in blocks(batch, lengths):
                doc, keys, times = block.links()
                distinct, back = np.unique(keys, return_inverse=True)
                count = found.counts(distinct)[back]
                top = np.where(count == known.best[keys >> 32], times, 0)
                sums = [np.zeros(n, np.int64) for _ in range(3)]
                for total, by in zip(sums, (times, top, times * count), strict=True):
                    np.add.at(total, doc, by)
                ids = batch.column(0).slice(begin, n).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in (*block.tokens, block.groups, *sums)), pa.array(block.texts(), pa.string())], schema=arrow)

    try:
        yield tokens.mapInArrow(run, schema)
    finally:
        util.drop_table(tokens)
        delete(docs.sparkSession, to)
