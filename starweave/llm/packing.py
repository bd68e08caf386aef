"""Best-fit packing of tokenised documents into fixed-length training sequences.

The instance is its histogram of piece lengths: at most ``capacity`` numbers, whatever the corpus size. A
Martello-Toth dominance reduction runs on it first: a set of the largest item with up to two partners that provably dominates
all alternatives is fixed for good and leaves the instance. What remains is packed best-fit over the histogram. The plan is a list of bin patterns with multiplicities; pieces find
their place by their rank among the pieces of their length, counted in hashed blocks so that no length lands in
one task.

* null text is an empty document: it has the end token only. Repeated rows are packed once each, and tie in their length's order.
* very long texts are encoded whole, then cut; a null doc_id is kept.
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.llm.common import doc_id, keep, keyed, table

#: Letters beyond ASCII that the fast splitter knows; other texts take the tokenizer's own splitter.
LATIN = "À-ÖØ-öø-ÿ"
#: Of how many words a worker remembers the ids.
WORDS_KEPT = 500_000
ROWS_PER_BLOCK = 1000
LETTER, DIGIT, OTHER, SPACE, STOP = range(5)
BYTES_AT_ONCE = 4_000_000


class ByteBpe:
    """The ids of ``byte_bpe_50k.json``: its vocabulary, read in its rank form, which has the same ids.

    Texts of ASCII and Latin-1 letters are cut into words for a whole batch at once by the classes of neighbouring
    bytes; each distinct word of the batch is then looked up, and encoded only if the worker hasn't met it before.
    Other texts, and those with an apostrophe, take the library's own splitter.
    """

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.full._core_bpe.encode_single_piece
        self.plain = re.compile(f"[\x00-\x1b\x20-\x26\x28-\x7f{LATIN}]*").fullmatch
        self.known: dict[bytes, list[int]] = {}
        self.kind = np.full(256, OTHER, dtype=np.uint8)
        self.kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
        self.kind[48:58] = DIGIT
        self.kind[[9, 10, 11, 12, 13, 32]] = SPACE

    def ids(self, word: bytes) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = self.piece(word)
            if len(self.known) < WORDS_KEPT:
                self.known[word] = found
        return found

    def encode_all(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text, the end token included."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if self.plain(t):
                plain.append(i)
            else:
                out[i] = np.array([*self.full.encode_ordinary(t), end_id], dtype="<u4")
        part, size = [], 0
        for i in plain:
            part.append(i)
            size += len(texts[i])
            if size >= BYTES_AT_ONCE or i == plain[-1]:
                for k, ids in zip(part, self._encode_plain([texts[k] for k in part], end_id), strict=True):
                    out[k] = ids
                part, size = [], 0
        return out

    def _encode_plain(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        data = b"\0".join(raw) + b"\0"
        byte = np.frombuffer(data, dtype=np.uint8)
        stops = np.cumsum([len(r) + 1 for r in raw]) - 1  # of the end marks
        kind = self.kind[byte]
        kind[stops] = STOP
        space = kind == SPACE
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[0], before[1:], after[-1], after[:-1] = STOP, kind[:-1], STOP, kind[1:]
        # a word begins where the kind changes; a blank belongs to the word after it, and of a run of
        # white space only the last character can
        blank = np.empty(len(byte), dtype=bool)
        blank[0], blank[1:] = False, byte[:-1] == 32
        blank &= before == SPACE
        begins = np.where(
            space,
            (before != SPACE) | ((after != SPACE) & (after != STOP)),
            (kind == STOP) | ((kind != before) & ~blank),
        )
        begins[0] = True
        at = np.append(np.flatnonzero(begins), len(byte)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        lists = [*map(self.ids, words.dictionary.to_pylist()), [end_id]]
        which = words.indices.to_numpy().copy()
        ends = np.flatnonzero(kind[at[:-1]] == STOP)
        which[ends] = len(lists) - 1
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter(chain.from_iterable(lists), dtype="<u4", count=int(sizes.sum()))
        size = sizes[which]
        upto = np.cumsum(size)
        shift = (np.cumsum(sizes) - sizes)[which] - (upto - size)
        ids = flat[np.arange(upto[-1]) + np.repeat(shift, size)]
        return np.split(ids, upto[ends])[:-1]


_encoders: dict[str, ByteBpe] = {}


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """``_id``, piece, start, length, ids_crc32 and on request the ids (bytes) of each piece.

    Only documents longer than ``capacity`` are cut; of their pieces only the first may be shorter.
    """
    path = public_tokenizers.path(f"{tokenizer}.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoders.get(path) or _encoders.setdefault(path, ByteBpe(path))
        gc.freeze()  # the vocabulary's and known words' objects need no search for cycles
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist(), end_id), strict=True):
                n = len(ids)
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[a:b].tobytes()
                    out.append((key, k, a, b - a, zlib.crc32(part), part if with_ids else None))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("_id", "piece", "start", "length", "ids_crc32", "ids")
                n = 5 + with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True))[:n], kinds, strict=False)], names[:n])

    schema = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return keyed(docs).select("_id", "_text").mapInArrow(encode, schema)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths, longest first) with how often each is used; together they hold every item once."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def _largest(left: Counter, most: int) -> int:
    """The largest length of at most ``most`` in the instance; else 0."""
    return next((n for n in range(most, 0, -1) if left[n] > 0), 0)


def _smallest(left: Counter, count: int, over: int = 0) -> list[int]:
    """The ``count`` smallest items longer than ``over``, with repeats; fewer if there are no more."""
    out: list[int] = []
    for n in sorted(x for x, c in left.items() if c > 0 and x > over):
        out += [n] * min(count - len(out), left[n])
        if len(out) == count:
            break
    return out


def _best_pair(left: Counter, room: int) -> tuple[int, int]:
    """Two items (longer first) of the largest sum that fits the room; of equal sums the pair with the longest item."""
    best = (0, 0)
    for a in range(room - 1, 0, -1):
        if left[a] <= 0:
            continue
        if 2 * a <= sum(best):
            break
        b = _largest(left, min(a, room - a))
        if b == a and left[a] < 2:
            b = _largest(left, a - 1)
        if b and a + b > sum(best):
            best = (a, b)
    return best


def _dominant(left: Counter, room: int) -> tuple[int, ...] | None:
    """The partners that dominate all others beside the largest item (taken out of ``left``), or None if that isn't proven."""
    one = _largest(left, room)
    if not one or one == room:
        return (one,) if one else ()
    small = _smallest(left, 3)
    if len(small) < 2 or small[0] + small[1] > room:
        return (one,)  # one partner at most: the largest dominates every other
    if len(small) == 3 and sum(small) <= room:
        return None  # four or more items may share the bin: left to best-fit
    a, b = _best_pair(left, room)
    if one >= a + b:
        return (one,)  # any pair fits where this partner was
    if a == one:
        beyond = _smallest(left, 2, over=b)
        if len(beyond) < 2 or sum(beyond) > room:
            return (a, b)  # of any other pair the longer is no longer than ``a`` and the shorter no longer than ``b``
    return None


def reduce_dominated(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix bins that dominate every alternative for their largest item; ``left`` shrinks in place.

    For a largest item ``n`` with room ``r = capacity - n``, sets of at most two partners are tested:

    * nothing fits beside it: the bin {n} is forced;
    * an item of exactly ``r`` exists: {n, r} dominates, since whatever else shares a bin with ``n`` fits where ``r`` was;
    * not even the two smallest items fit together beside it: the largest partner that fits dominates every other one;
    * not even the three smallest fit: the largest partner alone dominates if no fitting pair is longer than it; else the pair with
      the largest sum dominates, if it holds the largest partner and no fitting pair has two items longer than its shorter one.

    The tests depend on which lengths there are (and on the few smallest items), so they hold for as many bins as leave
    some of each length; these are fixed at once.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for n in range(capacity, 0, -1):
        while left[n]:
            left[n] -= 1
            partners = _dominant(left, capacity - n)
            left[n] += 1
            if partners is None:
                break
            used = Counter((n, *partners))
            times = max(1, min((left[x] - 4) // k for x, k in used.items())) if partners else left[n]
            for x, k in used.items():
                left[x] -= k * times
            fixed.append(((n, *partners), times))
    return fixed


def best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: open bins are counted by the room they have left."""
    rooms: dict[int, list[list]] = {}  # room: [pattern, times]
    for n in range(capacity, 0, -1):
        while left[n] > 0:
            room = next((r for r in range(n, capacity) if rooms.get(r)), None)
            if room is None:
                per = capacity // n
                full, rest = divmod(left[n], per)
                for bins, times in (((n,) * per, full), ((n,) * rest, 1)):
                    if times and bins:
                        rooms.setdefault(capacity - n * len(bins), []).append([bins, times])
                left[n] = 0
                break
            group = rooms[room][-1]
            per = min(room // n, left[n])
            times = min(group[1], left[n] // per)
            group[1] -= times
            if not group[1]:
                rooms[room].pop()
            left[n] -= times * per
            rooms.setdefault(room - n * per, []).append([group[0] + (n,) * per, times])
    return [(tuple(p), t) for groups in rooms.values() for p, t in groups]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, sequence of the first rank, offset): a run of equal places."""
    rank: Counter = Counter()
    sequence, out = 0, []
    for bins, times in plan:
        at = 0
        for n in bins:
            out.append((n, rank[n], rank[n] + times, sequence, at))
            rank[n] += times
            at += n
        sequence += times
    return out


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces`` (kept as a table: they are read more than once)."""
    spark = found.sparkSession
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    blocks = spark.createDataFrame([(n, c // ROWS_PER_BLOCK + 1) for n, c in histogram.items()], "length long, _blocks long")
    plan = spark.createDataFrame(slots(plan_bins(histogram, capacity)), "_length long, _from long, _to long, _sequence long, offset long")
    ranked = found.join(F.broadcast(blocks), "length").withColumn("_block", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.col("_blocks")))
    # where each block's ranks begin: one row for each length and block
    begins = (
        ranked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_begin", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_block", F.coalesce("_begin", F.lit(0)).alias("_begin"))
    )
    local = Window.partitionBy("length", "_block").orderBy("_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("_rank", F.row_number().over(local) - 1).join(begins, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_begin"))
    # a plan has a run of places for each pattern that a length takes part in: bounded by the capacity, not by the rows
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row for each piece."""
    found = keep(pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces")
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return pack(found, capacity).select(doc_id(), *columns)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
