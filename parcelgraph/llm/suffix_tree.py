"""Language-model scoring with a probabilistic suffix tree.

Symbols are all words of the training texts and the end of a text. Contexts of up to ``depth``
symbols are counted level by level. A context that occurs ``least_count`` times or more is retained
if its next-symbol distribution diverges from that of its longest retained suffix: if the relative
entropy, over all its occurrences, is at least ``divergence`` nats. A retained context gives each
symbol seen after it the share of its count less ``discount`` and hands the rest to its suffix, down
to the smoothed word counts, so every state's distribution sums to one. A context that isn't
retained is passed over. A text is scored by walking through the longest retained suffixes of its
past.

No threshold rises with the input, so the tree grows with it. It is kept as written tables of runs
of symbols (a context with its next symbol is a run), known by 64-bit hashes. A text's log10
probability is a sum over the runs that it holds: with the suffix's probability q, the share s and
the rest r, a seen symbol's probability is s + r q and another's r q; so a retained context adds
log10(r) wherever a symbol follows it, and a seen symbol log10(1 + s / (r q)) besides. Sums need no
order, so a text's runs meet the tree part by part.

Runs, requests and replies travel as packed columns, many in one row: a table's part is what hashes
into one range, and a task packs what it has for a part into one binary value. What is broadcast has
a fixed size and only saves requests, never changes the result: a filter that no known run fails, and
the values of runs that are at least a fixed share of all.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import shingles, util

#: The end of a text, among the words' hashes.
END = np.uint64(0xE1D0F7E87A3B5C19)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Distinct runs that a task gathers before it hands them on.
GATHERED = 1 << 19
#: Bytes of text that are worked on as one array, which the processor's caches hold, and of the
#: texts whose requests travel together.
PORTION, ASKED = 1 << 19, 1 << 22
#: Training tokens for each part of a table.
PART_TOKENS = 1_200_000
#: Bits of the filters of known runs, as a power of two, and tasks that fill one.
FILTER_BITS, FILTER_TASKS = 26, 6
#: A run whose count is at least this share of the training tokens is frequent: of each length
#: there are at most 2**21.
FREQUENT = 2.0**-21
#: The tree's parts are asked in so many slices, so that few requests are on disk at once.
SLICES = 3
#: Suffixes of contexts of more than one symbol are met in so many slices, for the same reason.
COUNT_SLICES = 2
#: Bytes of a word that are hashed by whole-array operations; longer words one by one.
_WORD_BYTES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Kinds of packed rows.
PARTIAL, SEEN, CONTEXT, WORD, TEXTS, REQUEST, OFTEN = range(7)
_RUNS = ("u8", "f4", "f4", "u8")  # run, value, probability of its last symbol, count
_PACKED = T.StructType([T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType())])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each as planes of equal bytes, which compress well where sorted."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)


def unpack(blobs: list, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of packed values, one value after another."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        raw = np.frombuffer(blob, np.uint8)
        n, at = len(raw) // sum(sizes), 0
        for into, kind, size in zip(out, kinds, sizes, strict=True):
            into.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
            at += n * size
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part that a hash belongs to: parts are ranges."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def starts(parts: int) -> np.ndarray:
    """The least hash of each part."""
    return np.array([-(-(k << 32) // parts) << 32 for k in range(parts)], np.uint64)


def part_slice(k: int, slices: int, parts: int) -> tuple[int, int]:
    """The first part of a slice and the first one after it: slices are ranges of parts."""
    return -(-k * parts // slices), -(-(k + 1) * parts // slices)


def _within(h: np.ndarray, first: int, after: int, parts: int) -> np.ndarray:
    """Whether hashes belong to the parts from ``first`` to before ``after``."""
    low, end = (-(-(k << 32) // parts) << 32 for k in (first, after))
    return h - np.uint64(low) <= np.uint64(end - low - 1)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``x``, and ``x`` in it. Of long arrays of hashes the leading bits are sorted
    with the positions behind them, which takes a fraction of the time of an ``argsort``."""
    if len(x) < 1 << 12 or x.dtype != np.uint64:
        order = np.argsort(x)
        return order, x[order]
    low, bits = x.min(), np.uint64((len(x) - 1).bit_length())
    key = (x - low) << np.uint64(min(63, 64 - int(x.max() - low).bit_length()))
    key >>= bits
    key <<= bits
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    key &= (np.uint64(1) << bits) - np.uint64(1)
    order = key.view(np.int64)
    out = x[order]
    for _ in range(8):  # neighbours that differ in the bits left out
        wrong = np.flatnonzero(out[1:] < out[:-1])
        if not len(wrong):
            return order, out
        wrong = wrong[np.r_[True, np.diff(wrong) > 1]]
        for a in (order, out):
            a[wrong], a[wrong + 1] = a[wrong + 1], a[wrong]
    order = np.argsort(x)
    return order, x[order]


def _stretches(x: np.ndarray):
    """(start, end) of the stretches of equal values."""
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]).tolist() if len(x) else []
    return zip(cuts, cuts[1:], strict=False)


def scatter(kind: int, parts: int, key: np.ndarray, *more: np.ndarray):
    """(part, kind, packed) of rows in the order of their key, for each part that has any."""
    order, key = _sorted(key)
    more = [m[order] for m in more]
    part = part_of(key, parts)
    for s, e in _stretches(part):
        yield int(part[s]), kind, pack(key[s:e], *(m[s:e] for m in more))


def _batch(rows, schema: T.StructType = _PACKED) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _table(rows) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _blobs(table: pa.Table, kind: int) -> list:
    return [x.as_buffer() for x, k in zip(table["data"], table["kind"].to_pylist(), strict=True) if k == kind]


def _summed(key: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the position of the first row of each, and sums of the weights."""
    order, key = _sorted(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], order[first], [np.add.reduceat(w[order], first) if len(first) else w for w in weights]


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sorted ``known`` and whether the wanted values are there."""
    order, by = _sorted(wanted)  # a search in order is many times faster
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(known, by)
    at[at == len(known)] = 0
    return at, known[at] == wanted if len(known) else np.zeros(len(wanted), bool)


def _ranged(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Sorted hashes, and where those of each of about as many equal ranges begin."""
    if not len(known):
        return known, np.zeros(0, np.int64), np.uint64(0)
    wide = int(known[-1] - known[0]).bit_length()
    shift = np.uint64(max(0, wide - len(known).bit_length()))
    many = np.bincount(((known - known[0]) >> shift).astype(np.int64))
    return known, np.cumsum(many) - many, shift


def _found_by_range(ranged: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_found`, for many searches of the same hashes."""
    known, begin, shift = ranged
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    near = np.clip(wanted, known[0], known[-1])
    at = begin[((near - known[0]) >> shift).astype(np.int64)]
    later = np.flatnonzero(known[at] < near)
    while len(later):
        at[later] += 1
        later = later[known[at[later]] < near[later]]
    return at, known[at] == wanted


def _numbered(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the number of each among them."""
    most = int(row.max()) + 1 if len(row) else 0
    if most > 8 * len(row):
        return np.unique(row, return_inverse=True)
    held = np.zeros(most, bool)
    held[row] = True
    return np.flatnonzero(held).astype(row.dtype), (np.cumsum(held) - 1)[row]


def _portions(batch: pa.RecordBatch, column: int, most: int = PORTION):
    """Slices of a batch whose ``column`` holds about ``most`` bytes each, one row at least."""
    ends = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end], eight bytes at a time; 8 bytes follow the last word."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    length = end - start
    out = shingles.mix((eight[start] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * _STEP)
    more = np.flatnonzero(length > 8)
    for at in range(8, _WORD_BYTES, 8):
        piece = eight[start[more] + at] & _MASKS[np.minimum(length[more] - at, 8)]
        out[more] = shingles.mix(out[more] * _STEP + piece)
        more = more[length[more] > at + 8]
    for k in more:
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    return out


def _read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, number of each in its text, lengths) of a portion; a null text is an empty one."""
    held = [x.as_buffer() if x.is_valid else b"" for x in texts]
    data = np.frombuffer(b" ".join([b"", *held, b" " * 8]).lower(), np.uint8)
    space = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    # texts begin after one blank each
    begins = 1 + np.cumsum([0] + [len(x) + 1 for x in held])
    lengths = np.diff(np.searchsorted(start, begins)) + 1
    stops = np.cumsum(lengths)
    symbols = np.full(lengths.sum(), END)
    words = np.ones(len(symbols), bool)
    words[stops - 1] = False
    symbols[words] = _word_hashes(data, start, end)
    return symbols, np.arange(len(symbols)) - np.repeat(stops - lengths, lengths), lengths


def runs(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1..order the hash of the run of words that ends at each position.

    A run is hashed from the runs that leave out its last and its first word; those that reach over
    the start of a text are void.
    """
    out = [words]
    for n in range(2, order + 1):
        first = np.zeros_like(words)
        first[1:] = out[-1][:-1]
        out.append(_joined(first, out[-1], n))
    return out


def _joined(first: np.ndarray, last: np.ndarray, order: int) -> np.ndarray:
    return shingles.mix(first * _STEP + last + np.uint64(order))


def _columns(data: str, *which: tuple[int, int]) -> Column:
    """Of packed runs (24 bytes each) the columns that begin at a byte and have so many."""
    n = f"(length({data}) div 24)"
    return F.expr("concat(" + ", ".join(f"substring({data}, cast({n} * {at} + 1 as int), cast({n} * {size} as int))" for at, size in which) + ")")


def _step(df: DataFrame, name: str) -> DataFrame:
    return util.materialize(df, name, **{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"})


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c): how often each word, or the end, occurs in all rows of ``docs``."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = []
        for batch in (b for whole in batches for b in _portions(whole, 0)):
            held.append(np.unique(_read(batch.column(0))[0], return_counts=True))
            if sum(len(k) for k, _ in held) > GATHERED:
                h, _, (c,) = _summed(*map(np.concatenate, zip(*held, strict=True)))
                held = [(h, c)]
                if len(h) > GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], schema=arrow)
                    held = []
        if held:
            h, _, (c,) = _summed(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], schema=arrow)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("h").agg(F.sum("c").alias("c"))


def packed_words(counts: DataFrame, total: int, parts: int) -> DataFrame:
    """The words' runs of one symbol, with their smoothed probability."""

    def run(batches):
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint64)
            yield _batch(scatter(WORD, parts, h, np.zeros(len(h), np.float32), ((c + 1.0) / total).astype(np.float32), c))

    return counts.mapInArrow(run, _PACKED)


def _bits(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - FILTER_BITS)
    return (filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def known_filter(values: DataFrame) -> np.ndarray:
    """Bits of fixed number that are set for every packed run that has a value, and by chance for
    others."""
    schema = T.StructType([T.StructField("bits", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        bits = _no_bits()
        for batch in batches:
            for blob in batch.column(0):
                g, v = unpack([blob.as_buffer()], ("u8", "f4"))
                _set_bits(bits, g[v != 0])
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], schema=arrow)

    out = _no_bits()
    for row in values.where(F.col("kind") != WORD).select("data").coalesce(FILTER_TASKS).mapInArrow(run, schema).toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _no_bits() -> np.ndarray:
    return np.zeros(1 << (FILTER_BITS - 3), np.uint8)


def _set_bits(bits: np.ndarray, h: np.ndarray) -> None:
    at = h >> np.uint64(64 - FILTER_BITS)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def count_runs(docs: DataFrame, text_col: str, order: int, parts: int, shared, slice_no: int = 0, slices: int = 1) -> DataFrame:
    """Packed partial counts of runs of ``order`` symbols. Those without whose first symbol
    (their suffix) is among the frequent runs that ``shared`` broadcasts: run without its last symbol,
    place of the suffix among them, count, by the part of the former (OFTEN). Others: suffix, run without
    its last symbol, count, by the part of the suffix (PARTIAL). Only contexts in the filter that
    ``shared`` broadcasts, if any, and of the slice: of contexts of one symbol these, else suffixes."""

    def merged(held):
        g, suf, ctx, c = map(np.concatenate, zip(*held, strict=True))
        g, first, (c,) = _summed(g, c)
        return g, suf[first], ctx[first], c

    def rows(suf, ctx, c, often, place):
        c = c.astype(np.uint32)
        slot = (suf & np.uint64(len(often) - 1)).astype(np.int64)
        hit = often[slot] == suf
        yield from scatter(OFTEN, parts, ctx[hit], place[slot[hit]], c[hit])
        yield from scatter(PARTIAL, parts, suf[~hit], ctx[~hit], c[~hit])

    def run(batches):
        hashes, _, filter_ = shared.value
        often = _slots(hashes, np.arange(len(hashes), dtype=np.uint32))
        first, after = part_slice(slice_no, slices, parts)
        held, raw = [], 0
        for batch in (b for whole in batches for b in _portions(whole, 0)):
            symbols, place, _ = _read(batch.column(0))
            end = runs(symbols, order - 1)[-1]
            inside = place >= order - 1
            if order > 2:
                inside &= _within(end, first, after, parts)
            else:
                inside[1:] &= _within(end[:-1], first, after, parts)
            at = np.flatnonzero(inside)
            if filter_ is not None:
                at = at[_bits(filter_, end[at - 1])]
            ctx, suf = end[at - 1], end[at]
            held.append((_joined(ctx, suf, order), suf, ctx, np.ones(len(at), np.int64)))
            raw += len(at)
            if raw > 3 * GATHERED:
                held, raw = [merged(held)], 0
                if len(held[0][0]) > GATHERED:
                    yield _batch(rows(*held.pop()[1:], *often))
        if held:
            yield _batch(rows(*merged(held)[1:], *often))

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, _PACKED)


def meet_suffixes(partial: DataFrame, shorter: DataFrame, order: int, parts: int) -> DataFrame:
    """Packed counts of whole runs of ``order`` symbols by the part of their context, with the
    probability of their last symbol after the suffix, which the packed runs that are shorter by one
    have (PARTIAL). Counts with frequent suffixes (OFTEN) pass through."""

    def with_suffix(table: pa.Table) -> pa.Table:
        suf, ctx, c = unpack(_blobs(table, PARTIAL), ("u8", "u8", "u4"))
        g, first, (c,) = _summed(_joined(ctx, suf, order), c.astype(np.int64))
        suf, ctx = suf[first], ctx[first]
        known, p = unpack(_blobs(table, SEEN) + _blobs(table, WORD), ("u8", "f4"))
        by, known = _sorted(known)
        at, hit = _found(known, suf)
        q = p[by][at[hit]]
        # a suffix that no table has belongs to a context that a filter let through by chance
        passed = [(part, kind, data.as_py()) for part, kind, data in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True) if kind == OFTEN]
        return _table([*passed, *scatter(PARTIAL, parts, ctx[hit], g[hit], c[hit].astype(np.uint32), q)])

    wanted = shorter.where(F.col("kind").isin(SEEN, WORD)).withColumn("data", _columns("data", (0, 8), (12, 4)))
    return partial.unionByName(wanted).groupBy("part").applyInArrow(with_suffix, _PACKED)


def fit_level(found: DataFrame, order: int, parts: int, shared, least: int, divergence: float, discount: float, last: bool) -> DataFrame:
    """Packed runs of ``order`` symbols (SEEN) and their contexts (CONTEXT), from their counts with the
    probabilities that their suffixes give them, or the places of these among the frequent runs that
    ``shared`` broadcasts; of the ``last`` level only what scores need."""

    def fit(table: pa.Table) -> pa.Table:
        hashes, probability, _ = shared.value
        ctx, g, c, q = unpack(_blobs(table, PARTIAL), ("u8", "u8", "u4", "f4"))
        ctx_, place, c_ = unpack(_blobs(table, OFTEN), ("u8", "u4", "u4"))
        g_, first, (c_,) = _summed(_joined(ctx_, hashes[place], order), c_.astype(np.int64))
        ctx, g, c, q = (np.concatenate(x) for x in ((ctx, ctx_[first]), (g, g_), (c.astype(np.int64), c_), (q, probability[place[first]])))
        order_, ctx = _sorted(ctx)
        g, c, q = g[order_], c[order_], q[order_].astype(float)
        first = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
        if not len(first):
            return _table([])
        over, each = lambda x: np.add.reduceat(x, first), np.diff(np.r_[first, len(ctx)])
        n = over(c)
        total, rest = np.repeat(n, each), discount * each / n
        s = (c - discount) / total
        p = s + np.repeat(rest, each) * q
        inside, outside = 1 - over(p), 1 - over(q)
        beyond = (inside > 1e-12) & (outside > 1e-12)
        gain = over(p * np.log(p / q)) + np.where(beyond, inside * np.log(np.where(beyond, inside, 1) / np.where(beyond, outside, 1)), 0)
        keep = (n >= least) & (gain * n >= divergence)
        kept = np.repeat(keep, each)
        p = np.where(kept, p, q)
        v = np.where(kept, np.log10(1 + s / (np.repeat(rest, each) * q)), 0)
        if last:
            g, v, p, c = g[kept], v[kept], np.zeros(kept.sum()), c[kept]
        rows = [*scatter(SEEN, parts, g, v.astype(np.float32), p.astype(np.float32), c.astype(np.uint64))]
        ctx, rest, n = ctx[first][keep], rest[keep], n[keep]
        rows += scatter(CONTEXT, parts, ctx, np.log10(rest).astype(np.float32), np.zeros(len(ctx), np.float32), n.astype(np.uint64))
        return _table(rows)

    return found.groupBy("part").applyInArrow(fit, _PACKED)


def frequent_rows(table: DataFrame, least: int, contexts_from: int | None = None) -> DataFrame:
    """The packed runs that occur ``least`` times (SEEN), one row a task that has any: a table has a row
    for each two parts, whose number grows with the square of its parts. If asked for, bits of fixed
    number besides (CONTEXT), which are set for every run that occurs ``contexts_from`` times."""

    def run(batches):
        held, bits = [], None if contexts_from is None else _no_bits()
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g, v, p, c = unpack([blob.as_buffer()], _RUNS)
                many = c >= least
                if many.any():
                    held.append((g[many], v[many], p[many], c[many] if kind == WORD else c[many] * np.uint64(0)))
                if bits is not None and kind == SEEN:
                    _set_bits(bits, g[c >= contexts_from])
        if held:
            yield _batch([(0, SEEN, pack(*map(np.concatenate, zip(*held, strict=True))))])
        if bits is not None:
            yield _batch([(0, CONTEXT, bits.tobytes())])

    of = table.select("kind", "data")
    return (of if contexts_from is None else of.coalesce(FILTER_TASKS)).mapInArrow(run, _PACKED).select("kind", "data")


def summary(table: DataFrame, least: int, contexts_from: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of the packed runs that occur ``least`` times, and the bits of :func:`frequent_rows`."""
    held, bits = [], _no_bits()
    for row in frequent_rows(table, least, contexts_from).toLocalIterator():
        if row.kind == SEEN:
            held.append(row.data)
        else:
            bits |= np.frombuffer(row.data, np.uint8)
    return unpack(held, _RUNS), bits


def frequent(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, value and count (0: no word) of the packed runs that occur ``least`` times."""
    return valued([summary(table, least)[0]])


def valued(columns: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs, their values and counts, of the columns of several summaries."""
    g, v, _, c = map(np.concatenate, zip(*columns, strict=True))
    g, first, (v, c) = _summed(g, v.astype(float), c)
    return g, v, c


def _slots(g: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Hashes and values by slot; of those that share one the last stays, others aren't found."""
    bits = max(4, int(len(g)).bit_length() + 1)
    mask = np.uint64((1 << bits) - 1)
    at = (g & mask).astype(np.int64)
    # an empty slot holds a hash that belongs in another one
    held = (np.arange(1 << bits, dtype=np.uint64) + np.uint64(1)) & mask
    held[at] = g
    out = [held]
    for x in values:
        into = np.zeros(1 << bits, x.dtype)
        into[at] = x
        out.append(into)
    return out


def score_texts(docs: DataFrame, train: Column, depth: int = 2, least_count: int = 8, divergence: float = 1.0, discount: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Words are runs of other characters than ASCII white space, A-Z lowered; each text ends with one
    more token. The model learns from the rows where ``train`` (a condition on the id) holds and
    scores all. base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score is the tree's
    log10 probability of the text; n_known counts tokens with c > 0. A null or empty text is its
    end alone. Repeated rows are learnt from and scored each; null ids are scored and, as ``train``
    says, learnt from. With no training rows every score is the base's. Other columns are not read;
    an empty table gives no rows; texts are read whole. Contexts of one symbol need no
    ``least_count``.
    """
    sc = docs.sparkSession.sparkContext
    learnt = docs.where(F.coalesce(train, F.lit(False)))
    counts = _step(count_words(learnt, text_col), "words")
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, parts = tokens + words + 1, max(8, -(-tokens // PART_TOKENS))
    tables = [_step(packed_words(counts, total, parts), "level0")]
    util.drop_table(counts)
    frequent_from, often = max(4, int(tokens * FREQUENT)), []

    def fitted(found: DataFrame, k: int, shared) -> DataFrame:
        return _step(fit_level(found, k + 1, parts, shared, least_count if k > 1 else 1, divergence, discount, k == depth), f"level{k}")

    for k in range(1, depth + 1):
        shorter = tables[-1]
        columns, bits = summary(shorter, frequent_from, least_count if k > 1 else None)
        often.append(columns)
        # of contexts, which are no suffixes, a table has no probability
        g, first, _ = _summed(columns[0][columns[2] > 0])
        shared = sc.broadcast((g, columns[2][columns[2] > 0][first], bits if k > 1 else None))
        made, met = [], []
        for j in range(COUNT_SLICES):
            partial = count_runs(learnt, text_col, k + 1, parts, shared, j, COUNT_SLICES)
            if k == 1:  # words are few, so all of them meet each slice of contexts
                made.append(fitted(meet_suffixes(partial, shorter, k + 1, parts), k, shared))
                continue
            first, after = part_slice(j, COUNT_SLICES, parts)
            met.append(_step(meet_suffixes(partial, shorter.where(F.col("part").between(first, after - 1)), k + 1, parts), "met"))
        tables.append(functools.reduce(DataFrame.unionByName, made or [fitted(functools.reduce(DataFrame.unionByName, met), k, shared)]))
        for table in met:
            util.drop_table(table)
        shared.destroy()
    tree = functools.reduce(DataFrame.unionByName, tables)
    often.append(summary(tables[-1], frequent_from)[0])
    # requests need neither probabilities nor counts of longer runs
    columns = F.when(F.col("kind") == WORD, _columns("data", (0, 8), (16, 8))).otherwise(_columns("data", (0, 12)))
    values = _step(tree.select("part", "kind", columns.alias("data")), "values")
    for table in tables:
        util.drop_table(table)
    shared = sc.broadcast((*valued(often), known_filter(values)))
    unseen = float(np.log10(1 / total))
    own = lambda c: np.log10((c + 1.0) / total)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([*_PACKED, T.StructField("portion", T.LongType()), T.StructField("ids", T.ArrayType(id_type))])
    names, sums = ("u8", "u8", "u4", "f8", "f8"), ("u4", "u4", "f8", "f8")
    # of a portion's texts: hash, tokens, known, base, gain; of those a part adds to: row, known, base, gain

    def ask(batches, slice_no):
        """For each portion of texts its sums over frequent runs, and to each part of the slice the
        other runs that it may know: words, then longer ones, each by hash."""
        *often, filter_ = shared.value
        often[2] = np.where(often[2] > 0, own(often[2]), 0)
        held, value, logs = _slots(*often)
        mask, portion = np.uint64(len(held) - 1), TaskContext.get().partitionId() << 32
        first, after = part_slice(slice_no, SLICES, parts)
        begin = starts(parts)[first:after]
        for batch in (b for whole in batches for b in _portions(whole, 1, ASKED)):
            sums, wanted = [], ([], [])
            for piece in _portions(batch, 1):
                symbols, place, lengths = _read(piece.column(1))
                n, row = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
                known, base, gain = np.zeros(n), np.zeros(n), np.zeros(n)
                before = sum(len(x[0]) for x in sums)
                for k, h in enumerate(runs(symbols, depth + 1)):
                    inside = _within(h, first, after, parts)
                    at = np.flatnonzero(inside & (place >= k) if k else inside)
                    h = h[at]
                    if k:
                        may = _bits(filter_, h)
                        at, h = at[may], h[may]
                    slot = (h & mask).astype(np.int64)
                    hit = held[slot] == h
                    if not k:
                        log = logs[slot]
                        hit &= log < 0
                    found = row[at[hit]]
                    gain += np.bincount(found, value[slot[hit]], n)
                    if not k:
                        base += np.bincount(found, log[hit], n)
                        known += np.bincount(found, minlength=n)
                    wanted[k > 0].append((h[~hit], (row[at[~hit]] + before).astype(np.uint32)))
                sums.append((lengths.astype(np.uint64), known.astype(np.uint32), base, gain))
            text = np.array([xxhash.xxh3_64_intdigest(x.as_buffer() if x.is_valid else b"") for x in batch.column(1)], np.uint64)
            rows = [(portion % parts, TEXTS, pack(text, *map(np.concatenate, zip(*sums, strict=True))), portion, batch.column(0).to_pylist())]
            asked = []
            for x in wanted:
                h, row = map(np.concatenate, zip(*x, strict=True)) if x else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
                order, h = _sorted(h)
                asked.append((row[order], h, np.r_[np.searchsorted(h, begin), len(h)].tolist()))
            (word_row, word, i), (run_row, run, j) = asked
            for k in range(len(begin)):
                w, r = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
                if i[k] < i[k + 1] or j[k] < j[k + 1]:
                    data = pack(np.concatenate([word_row[w], run_row[r]]), np.concatenate([word[w], run[r]]))
                    rows.append((first + k, REQUEST, np.uint32(i[k + 1] - i[k]).tobytes() + data, portion, None))
            yield _batch(rows, schema)
            portion += 1

    def answer(table: pa.Table) -> pa.Table:
        """What a part of the tree adds to the sums of those of each portion's texts that asked."""
        g, v = unpack(_blobs(table, SEEN) + _blobs(table, CONTEXT), ("u8", "f4"))
        w, c = unpack(_blobs(table, WORD), ("u8", "u8"))
        g, v, c = np.concatenate([g, w]), np.concatenate([v, np.zeros(len(w), np.float32)]), np.concatenate([np.zeros(len(g), np.int64), c.astype(np.int64)])
        g, _, (v, c) = _summed(g, v.astype(float), c)
        ranged, out = _ranged(g), []
        for k, (kind, portion) in enumerate(zip(table["kind"].to_pylist(), table["portion"].to_pylist(), strict=True)):
            if kind == TEXTS:
                out.append((0, kind, table["data"][k].as_py(), portion, table["ids"][k].as_py()))
            elif kind == REQUEST:
                data = table["data"][k].as_buffer()
                n_words = int(np.frombuffer(data[:4], np.uint32)[0])
                row, h = unpack([data[4:]], ("u4", "u8"))
                texts, row = _numbered(row)
                n = len(texts)
                at, hit = _found_by_range(ranged, h)
                gain = np.bincount(row[hit], v[at[hit]], n)
                at, hit, row = at[:n_words], hit[:n_words], row[:n_words]
                count = np.where(hit, c[at], 0) if len(c) else np.zeros(len(at))
                base = np.bincount(row, own(count), n)
                known = np.bincount(row[count > 0], minlength=n)
                out.append((0, kind, pack(texts, known.astype(np.uint32), base, gain), portion, None))
        return pa.Table.from_batches([_batch(out, schema)])

    part_sums = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("text", "n_tokens", "n_known")), T.StructField("base", T.DoubleType()), T.StructField("gain", T.DoubleType())])
    part_arrow = to_arrow_schema(part_sums)

    def add_up(table: pa.Table) -> pa.Table:
        head = table["kind"].to_pylist().index(TEXTS)
        ids = table["ids"][head].values.cast(part_arrow.field(0).type)
        text, length, known, base, gain = unpack([table["data"][head].as_buffer()], names)
        known = known.astype(np.int64)
        for data in _blobs(table, REQUEST):
            row, *more = unpack([data], sums)
            for into, x in zip((known, base, gain), more, strict=True):
                into[row] += x.astype(into.dtype)
        return pa.Table.from_arrays([ids, pa.array(text.view(np.int64)), pa.array(length.view(np.int64)), pa.array(known), pa.array(base), pa.array(gain)], schema=part_arrow)

    known = values.select("*", F.lit(None).cast("long").alias("portion"), F.lit(None).cast(schema["ids"].dataType).alias("ids"))
    made = None
    for k in range(SLICES):
        first, after = part_slice(k, SLICES, parts)
        asked = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lambda batches, k=k: ask(batches, k), schema)
        met = asked.unionByName(known.where(F.col("part").between(first, after - 1))).groupBy("part").applyInArrow(answer, schema)
        scored = _step(met.select("portion", "kind", "data", "ids").groupBy("portion").applyInArrow(add_up, part_sums), "scores")
        made = scored if made is None else made.unionByName(scored)
    shared.destroy()
    util.drop_table(values)
    # rows that repeat id and text have equal sums, so slices meet by these whatever the tasks were
    copies = F.count("*") / SLICES
    whole = made.groupBy("id", "text", "n_tokens").agg(copies.cast("int").alias("copies"), *((F.sum(c) / copies).alias(c) for c in ("n_known", "base", "gain")))
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(F.col("id").alias(id_col), "n_tokens", F.round("n_known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"))
