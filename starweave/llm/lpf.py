"""Removal of repeated byte strings by longest-previous-factor arrays, keeping what comes first.

A byte is removed if a string of ``span`` bytes that covers it also starts in a document with a smaller doc_id. No
suffix array of a whole corpus fits anywhere, so the suffixes are first dealt out such that equal strings meet:

1. every string of ``span`` bytes is represented by the least hash among its ``GRAM``-byte substrings. Neighbouring strings
   mostly share it, so a document gives about one row (hash, doc_id) for 18 bytes. One exchange by hash finds the hashes
   that several documents have; groups are streamed;
2. for these hashes alone the surrounding bytes (contexts) of each document are dealt out by hash. A block of whole
   groups gets its suffix order (ties by document) and the array of longest common prefixes. Previous and next smaller
   documents in this order, with the least common prefix on the way, give each suffix its longest previous factor; both are
   found for all suffixes at once by pointer jumping. Where the factor reaches ``span`` the string goes;
3. the covered ranges of each document are merged, and cut from its text.

Order and factors are cut off at ``span`` bytes: longer factors change nothing.

A passage that very many documents have is combined before each exchange, as partial sums are: of the documents that a
worker has seen with a hash, two travel to the hash's task and the others are known to share it; of equal contexts, only
that of the least document travels, the others are covered whole. What is known already is dealt out at random, not by its
hash. A group whose different contexts exceed ``GROUP_BYTES`` (around one very common substring) is dealt out anew by longer
substrings, up to whole strings of ``span`` bytes, of which all contexts are equal. So no task holds or reads an unbounded group.

* null text is empty. A null doc_id counts as a document after all others; two of these don't match each other.
* rows of one doc_id don't match each other either; each row is cut on its own, and repeated rows alike.
* very long texts are cut into overlapping parts before they are hashed; the parts' strings are those of the whole text.
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import NULL_ID, discard, doc_id, keep, keyed, partitions, table

SPAN = 50
GRAM = 16
#: Bytes of text hashed at a time, of contexts in one suffix array, and of one group's different contexts.
TEXT_AT_ONCE = 2_000_000
BLOCK_BYTES = 3_000_000
GROUP_BYTES = 12_000_000
#: Starts in one context at most.
LONGEST_RUN = 2048
#: Hashes that a worker remembers as shared; forgetting one only lets its rows travel.
REMEMBERED = 100_000
U = np.uint64


def words_at(data: bytes, n: int, offset: int, big: bool = False) -> np.ndarray:
    """The eight bytes from each of ``n`` places on, as numbers."""
    return np.ndarray((n,), dtype=">u8" if big else "<u8", buffer=data, offset=offset, strides=(1,)).astype(U)


def least_hashes(data: bytes, n: int, span: int, gram: int = GRAM) -> np.ndarray:
    """For each of ``n`` starts the least hash of the ``gram``-byte substrings of its ``span`` bytes. data: n + span + 8 bytes."""
    grams = span - gram + 1
    m = n + grams - 1
    h = np.zeros(m, dtype=U)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        h = (h ^ words_at(data, m, at)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
        h *= U(0xC2B2AE3D27D4EB4F)
        h ^= h >> U(32)
    width = 1
    while width * 2 <= grams:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < grams:
        h = np.minimum(h[: width - grams], h[grams - width :])
    return h[:n]


def segments(texts: list[bytes], span: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of bounded size: (bytes, row of each start, place of each start in the bytes, place in its text)."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - span + 1, TEXT_AT_ONCE):
            part = text[at : at + TEXT_AT_ONCE + span - 1]
            parts.append((row, at, part))
            size += len(part)
            if size >= TEXT_AT_ONCE:
                yield joined(parts, span)
                parts, size = [], 0
    if parts:
        yield joined(parts, span)


def joined(parts: list[tuple[int, int, bytes]], span: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = b"".join(p for _, _, p in parts) + bytes(span + 8)
    lengths = np.array([len(p) for _, _, p in parts], dtype=np.int64)
    starts = lengths - span + 1
    begin = np.cumsum(lengths) - lengths
    inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    row = np.repeat(np.array([r for r, _, _ in parts], dtype=np.int64), starts)
    return data, row, np.repeat(begin, starts) + inner, np.repeat(np.array([a for _, a, _ in parts], dtype=np.int64), starts) + inner


def runs_of(texts: list[bytes], span: int, gram: int = GRAM) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of starts with one least hash: (bytes, hash, row, place in bytes, place in text, number of starts)."""
    for data, row, place, inside in segments(texts, span):
        h = least_hashes(data, len(data) - span - 8, span, gram)[place]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(h)))
        if len(count) and count.max() > LONGEST_RUN:
            times = -(-count // LONGEST_RUN)
            more = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            count = np.minimum(LONGEST_RUN, np.repeat(count, times) - more * LONGEST_RUN)
            at = np.repeat(at, times) + more * LONGEST_RUN
        yield data, h[at].view(np.int64), row[at], place[at], inside[at], count


def packed(docs: DataFrame) -> DataFrame:
    """(_id, _tag, z): texts compressed one by one, for the exchanges that carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(zip_, batch.column(2).to_pylist()), pa.binary())], ["_id", "_tag", "z"])

    return docs.select("_id", "_tag", F.col("_text").cast("binary").alias("b")).mapInArrow(run, "_id long, _tag long, z binary")


def unpacked(column: pa.Array) -> list[bytes]:
    return [*map(zstandard.ZstdDecompressor().decompress, column.to_pylist())]


def sketch(docs: DataFrame, span: int) -> DataFrame:
    """(h, _id, _tag, sure) for each document and hash of its runs; ``sure``: this worker knows that several ids have the hash.

    The tag is 0 but for null ids: rows of one id may share a list of hashes, rows without an id may be too many for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_here = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            tags = np.where(ids == NULL_ID, batch.column(1).to_numpy(), 0)
            for _, h, row, *_ in runs_of(batch.column(2).to_pylist(), span):
                order = np.lexsort((row, ids[row], h))
                h, row = h[order], row[order]
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
                h, row = h[new], row[new]
                d = ids[row]
                head = np.append(True, h[1:] != h[:-1])
                other = np.cumsum(np.append(False, d[1:] != d[:-1]) & ~head)  # the ids of a hash are numbered from 0
                nth = other - other[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
                at = np.minimum(np.searchsorted(shared_here, h), max(0, len(shared_here) - 1))
                sure = nth >= 2
                if len(shared_here):
                    sure |= shared_here[at] == h
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), pa.array(tags[row]), pa.array(sure)], ["h", "_id", "_tag", "sure"])
                more = np.unique(h[nth >= 2])
                shared_here = more[:REMEMBERED] if len(shared_here) + len(more) > REMEMBERED else np.union1d(shared_here, more)

    return docs.select("_id", "_tag", F.col("_text").cast("binary").alias("b")).mapInArrow(run, "h long, _id long, _tag long, sure boolean")


def dealt(rows: DataFrame, settled: str) -> DataFrame:
    """Rows in order of (h, _id), those of one hash in one partition; settled ones anywhere."""
    key = F.when(F.expr(settled), F.xxhash64("_id", "_tag", "h")).otherwise(F.col("h"))
    return rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions("h", "_id")


def shared(rows: DataFrame) -> DataFrame:
    """The (h, _id, _tag) whose hash several ids have; groups are streamed."""
    return dealt(rows, "sure").mapInArrow(several_ids, "h long, _id long, _tag long")


def several_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, _id, _tag, sure) in order of (h, _id), those whose hash has another id too."""
    held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool)]  # the last group's rows while it has one id
    known = None  # the last group's hash, once it has several
    for batch in batches:
        h, d, t, s = (np.append(a, batch.column(k).to_numpy(zero_copy_only=False)) for k, a in enumerate(held))
        if not len(h):
            continue
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(begin, len(h)))
        many = (d[begin] != d[begin + size - 1]) | np.logical_or.reduceat(s, begin)
        if known is not None and h[0] == known:
            many[0] = True
        last = begin[-1]
        known = h[-1] if many[-1] else None
        # rows of one id wait for another one; no other comes after a null id
        to = last if many[-1] else last + 1 if d[last] == NULL_ID else len(h)
        held = [x[last:to] for x in (h, d, t, s)]
        out = np.repeat(many, size)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(d[out]), pa.array(t[out])], ["h", "_id", "_tag"])


CONTEXT = "h long, _id long, _tag long, a long, b long, bytes binary"


def context_rows(h: np.ndarray, ids: np.ndarray, tags: np.ndarray, a: np.ndarray, blob: pa.Array) -> pa.RecordBatch:
    """Contexts that travel (bytes, no end) or, where an equal context of a smaller id is at hand, ranges covered whole (no bytes)."""
    coded = blob.dictionary_encode()
    which = coded.indices.to_numpy()
    least = np.full(len(coded.dictionary), NULL_ID, dtype=np.int64)
    np.minimum.at(least, which, ids)
    later = ids > least[which]
    b = pa.array(a + pa.compute.binary_length(blob).to_numpy(), mask=~later)
    bytes_ = blob.take(pa.array(np.arange(len(ids)), mask=later))
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(tags), pa.array(a), b, bytes_], ["h", "_id", "_tag", "a", "b", "bytes"])


def cut_out(data: bytes, place: np.ndarray, size: np.ndarray) -> pa.Array:
    upto = np.cumsum(size)
    take = np.arange(upto[-1]) + np.repeat(place - (upto - size), size)
    flat = np.frombuffer(data, dtype=np.uint8)[take]
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, upto).astype(np.int32)), pa.py_buffer(flat)])


def contexts(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(h, _id, _tag, a, b, bytes): the bytes from ``a`` on that cover each run of a wanted hash; without bytes: covered whole, up to ``b``."""
    lists = wanted.groupBy("_id", F.col("_tag").alias("_null_tag")).agg(F.collect_list("h").alias("hs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            sets = [np.sort(x.values.to_numpy()) for x in hs]
            for data, h, row, place, inside, count in runs_of(unpacked(batch.column(2)), span):
                cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                ok = np.zeros(len(h), dtype=bool)
                for a, b in zip(cuts, np.append(cuts[1:], len(row)), strict=True):
                    known = sets[row[a]]
                    ok[a:b] = known[np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)] == h[a:b]
                if ok.any():
                    row = row[ok]
                    yield context_rows(h[ok], ids[row], tags[row], inside[ok], cut_out(data, place[ok], count[ok] + span - 1))

    rows = packed(docs).withColumn("_null_tag", F.when(F.col("_id") == NULL_ID, F.col("_tag")).otherwise(0))
    return rows.join(lists.hint("merge"), ["_id", "_null_tag"]).select("_id", "_tag", "z", "hs").mapInArrow(run, CONTEXT)


def finer_contexts(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """Contexts that are left over, dealt out anew by the least hash of longer substrings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, at = (batch.column(k).to_numpy() for k in range(3))
            for data, h, row, place, inside, count in runs_of(batch.column(3).to_pylist(), span, gram):
                yield context_rows(h, ids[row], tags[row], at[row] + inside, cut_out(data, place, count + span - 1))

    return rows.select("_id", "_tag", "a", "bytes").mapInArrow(run, CONTEXT)


def common_prefix(keys: list[np.ndarray], offsets: list[int], depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, up to ``depth``; 0 for the first."""
    n = len(keys[0])
    out = np.full(n, depth, dtype=np.int64)
    out[0] = 0
    same = np.ones(n, dtype=bool)
    same[0] = False
    for k, at in zip(keys, offsets, strict=True):
        differ = np.zeros(n, dtype=U)
        differ[1:] = k[1:] ^ k[:-1]
        ends = np.flatnonzero(same & (differ != 0))
        x = differ[ends]
        out[ends] = at + sum((x < U(1) << U(8 * b)).astype(np.int64) for b in range(1, 8))
        same[ends] = False
    return out


def nearest_smaller(doc: np.ndarray, prefix: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with the nearest place before it whose document is smaller; 0 if there is none.

    Pointer jumping: everything between a place and its candidate has no smaller document, so a candidate that isn't smaller
    hands on its own. Candidates whose prefix has fallen below ``least`` are given up.
    """
    candidate = np.arange(-1, len(doc) - 1)
    shares = prefix.copy()
    active = np.flatnonzero((candidate >= 0) & (shares >= least))
    active = active[doc[candidate[active]] >= doc[active]]
    while len(active):
        at = candidate[active]
        less, further = np.minimum(shares[active], shares[at]), candidate[at]
        shares[active], candidate[active] = less, further
        active = active[(further >= 0) & (less >= least)]
        active = active[doc[candidate[active]] >= doc[active]]
    found = (candidate >= 0) & (shares >= least)
    found[found] = doc[candidate[found]] < doc[found]
    return np.where(found, shares, 0)


def longest_previous(data: bytes, starts: np.ndarray, doc: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """The longest previous factor of each start: the longest string, up to ``depth`` bytes, that begins here and at a start of a
    smaller document; 0 if it is shorter than ``least``. data: ``depth`` bytes from each start on.

    The suffix order's previous and next smaller documents have it: anything further away shares no more.
    """
    offsets = [*range(0, depth - 8, 8), depth - 8]
    keys = [words_at(data, len(data) - depth + 1, o, big=True)[starts] for o in offsets]
    order = np.argsort(keys[0])
    first = keys[0][order]
    tie = np.zeros(len(order), dtype=bool)
    tie[1:] = first[1:] == first[:-1]
    tie[:-1] |= tie[1:]
    among = np.flatnonzero(tie)  # only these need the rest of their keys
    sub = order[among]
    order[among] = sub[np.lexsort((doc[sub], *(k[sub] for k in reversed(keys))))]
    prefix = common_prefix([k[order] for k in keys], offsets, depth)
    by_order = doc[order]
    before = nearest_smaller(by_order, prefix, least)
    after = nearest_smaller(by_order[::-1], np.append(prefix[1:], 0)[::-1], least)[::-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


RANGE = "_id long, _tag long, a long, b long, bytes binary"


def ranges(ids: np.ndarray, tags: np.ndarray, a: np.ndarray, b: np.ndarray, blob: pa.Array | None = None) -> pa.RecordBatch:
    blob = pa.nulls(len(ids), pa.binary()) if blob is None else blob
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(a), pa.array(b), blob], ["_id", "_tag", "a", "b", "bytes"])


def resolve(ids: np.ndarray, tags: np.ndarray, at: np.ndarray, blob: pa.Array, span: int) -> pa.RecordBatch:
    """The covered ranges of whole groups' contexts, in order of id within a group."""
    coded = blob.dictionary_encode()
    which, texts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    # of equal contexts the first in order of id stands for all: those of later ids are covered whole
    first = np.full(len(texts), len(ids))
    np.minimum.at(first, which, np.arange(len(ids)))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    count = size - span + 1
    begin = np.cumsum(size) - size
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    factor = longest_previous(b"".join(texts), np.repeat(begin, count) + inner, np.repeat(ids[first], count), span, span)
    own = factor >= span
    # runs of matched starts in each different context
    edge = np.zeros(len(own) + 1, dtype=bool)
    edge[np.cumsum(count) - count] = True
    edge[-1] = True
    up = own & (~np.append(False, own[:-1]) | edge[:-1])
    down = own & (~np.append(own[1:], False) | edge[1:])
    a, b, of = inner[up], inner[down] + span, np.repeat(np.arange(len(texts)), count)[up]
    later = ids > ids[first][which]
    each = np.flatnonzero(~later)
    # rows that stand for themselves take their context's runs
    per = np.bincount(of, minlength=len(texts))
    times = per[which[each]]
    row = np.repeat(each, times)
    k = np.repeat((np.cumsum(per) - per)[which[each]] - (np.cumsum(times) - times), times) + np.arange(len(row))
    whole = np.flatnonzero(later)
    rows = np.append(row, whole)
    return ranges(ids[rows], tags[rows], np.append(at[row] + a[k], at[whole]), np.append(at[row] + b[k], at[whole] + size[which[whole]]))


def matched(rows: DataFrame, span: int) -> DataFrame:
    """(_id, _tag, a, b, bytes): covered ranges; with bytes, contexts of groups that are to be dealt out anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, large = 0, None  # large: the hash of a group that doesn't fit, once known

        def arrays(parts: list[pa.RecordBatch]) -> tuple:
            t = pa.Table.from_batches(parts).combine_chunks()
            return (*(t.column(i).to_numpy() for i in range(4)), t.column(5).chunk(0))

        def left(part: pa.RecordBatch) -> pa.RecordBatch:
            return ranges(*(part.column(i).to_numpy() for i in (1, 2, 3, 3)), part.column(5))

        def weight(parts: list[pa.RecordBatch]) -> int:
            return sum(pa.compute.sum(pa.compute.binary_length(p.column(5))).as_py() or 0 for p in parts)

        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                known = batch.column(5).is_null()
                if pa.compute.any(known).as_py():
                    part = batch.filter(known)
                    yield ranges(*(part.column(i).to_numpy() for i in (1, 2, 3, 4)))
                    batch = batch.filter(pa.compute.invert(known))
                h = batch.column(0).to_numpy()
                if large is not None and len(h):
                    n = int(np.searchsorted(h, large, side="right"))
                    if n:
                        yield left(batch.slice(0, n))
                        batch, h = batch.slice(n), h[n:]
                    large = large if not len(h) else None
                if not len(h):
                    continue
                held.append(batch)
                size += weight([batch])
                if size < BLOCK_BYTES:
                    continue
                # the last group may go on; those before it are whole
                last, done, open_ = h[-1], [], []
                for p in held:
                    n = int(np.searchsorted(p.column(0).to_numpy(), last))
                    done += [p.slice(0, n)] if n else []
                    open_ += [p.slice(n)] if n < p.num_rows else []
                if done:
                    _, ids, tags, at, blob = arrays(done)
                    yield resolve(ids, tags, at, blob, span)
                held, size = open_, weight(open_)
                if size >= BLOCK_BYTES:
                    # one group: only different contexts need to wait, equal ones of later ids are covered whole
                    slim = context_rows(*arrays(held))
                    known = slim.column(5).is_null()
                    part = slim.filter(known)
                    yield ranges(*(part.column(i).to_numpy() for i in (1, 2, 3, 4)))
                    held = [slim.filter(pa.compute.invert(known))]
                    size = weight(held)
                    if size >= GROUP_BYTES:
                        yield from map(left, held)
                        held, size, large = [], 0, last
        if held:
            _, ids, tags, at, blob = arrays(held)
            yield resolve(ids, tags, at, blob, span)

    return dealt(rows, "bytes is null").mapInArrow(run, RANGE)


def repeated_ranges(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(_id, _tag, a, b): ranges of bytes (from 0, end excluded) that are to go; they may overlap."""
    wanted = keep(shared(sketch(docs, span)), "hashes")
    done = [keep(matched(contexts(docs, wanted, span), span), "ranges")]
    discard(wanted)
    for gram in ((span + GRAM) // 2, span):
        over = done[-1].where("bytes is not null")
        if not over.limit(1).count():
            break
        done.append(keep(matched(finer_contexts(over, span, gram), span), "ranges"))
    out = done[0].where("bytes is null").drop("bytes")
    for more in done[1:]:
        out = out.unionByName(more.where("bytes is null").drop("bytes"))
    return out


def cut(docs: DataFrame, ranges: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: ``_id``, n_bytes, n_removed, n_spans, kept_sha256, and on request the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(unpacked(batch.column(1)), batch.column(2), strict=True):
                kept, removed, n, end, begin = [], 0, 0, 0, None
                if spans.is_valid:
                    both = spans.values.flatten()
                    a, b = (x.to_numpy() for x in both)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > b[:-1])
                    begins, ends = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    n, removed = len(begins), int((ends - begins).sum())
                    for begin, stop in zip(begins.tolist(), ends.tolist(), strict=True):
                        kept.append(text[end:begin])
                        end = stop
                kept.append(text[end:])
                whole = b"".join(kept)
                rows.append((len(text), removed, n, hashlib.sha256(whole).hexdigest(), whole))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True))[: len(names) - 1], kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [x.split()[0] for x in schema.split(", ")]
    lists = ranges.groupBy("_id", "_tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # repeated rows bring theirs again
    return packed(docs).join(lists.hint("merge"), ["_id", "_tag"], "left").select("_id", "z", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, span: int = SPAN, with_text: bool = False) -> DataFrame:
    rows = keyed(docs)
    return cut(rows, repeated_ranges(rows, span), with_text)


def op10_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
