"""Best-fit packing by exact-complement hashing.

Documents become token ids, with id 0 after each; only those over SIZE ids are cut. A plan is made from the counts of
lengths alone, SIZE numbers whatever the corpus. The sums of one, two and three lengths are indexed: a table by sum holds the pairs of
lengths with that sum, and one the largest parts of triples with it, whose rest is a pair of the first table; entries whose counts run
out are taken off. Going down the lengths, each piece's gap is looked up there, and the combination is taken as often as its counts
allow, so the sequence is exactly full. What no combination completes goes best-fit: each remaining piece into the sequence with the smallest gap
that holds it. Each step uses up a length or a kind of sequence, so the plan has some thousands of rows at most.

Pieces are then dealt to the plan's places by their rank among those of their length. The rank is counted in two steps, within
(length, salt) and over the salts' counts, so a length that a third of all pieces have is no single task's.

Defined results: null text counts as empty and gives one piece with id 0 alone; repeated rows are packed each; a null doc_id is kept;
no documents give no rows; ties are broken by doc_id and piece, so a run's result doesn't depend on the tasks' order; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, ready
from .tokens import encoder

SIZE, VOCABULARY, SALT_ROWS = 2048, "word_bpe_49k.json", 20_000


class Sums:
    """The sums of one, two and three lengths, indexed by sum over counts that only shrink. Entries are kept as bits: bit a of pairs[s] stands
    for the pair (a, s - a) with a the larger, bit a of triples[s] for a with a pair of pairs[s - a] whose parts are at most a. Pairs go when a
    count runs out, triples when they're looked up and their pair is gone. held: pieces that are spoken for."""

    def __init__(self, counts: list[int]):
        self.counts, self.there, self.triples = counts, 0, {}
        mirrored = 0
        for n, c in enumerate(counts[: SIZE + 1]):
            if c:
                self.there |= 1 << n
                mirrored |= 1 << (SIZE - n)
        self.pairs = [0, 0]
        for total in range(2, SIZE + 1):
            half = (total + 1) // 2
            both = (self.there & (mirrored >> (SIZE - total)) & ((1 << total) - 1)) >> half << half
            self.pairs.append(both & ~(1 << half) if total == 2 * half and counts[half] < 2 else both)

    def take(self, n: int, times: int) -> None:
        self.counts[n] -= times
        if self.counts[n] < 2 and 2 * n <= SIZE:
            self.pairs[2 * n] &= ~(1 << n)
        if not self.counts[n]:
            self.there &= ~(1 << n)
            for m in range(1, SIZE - n + 1):
                self.pairs[n + m] &= ~(1 << max(n, m))

    def enough(self, *parts: int) -> bool:
        return all(self.counts[n] >= parts.count(n) for n in parts)

    def pair(self, total: int, held: tuple[int, ...] = (), most: int = SIZE) -> tuple[int, int] | None:
        """Two lengths, the larger first and at most most, with this sum; the most even ones, to spare the short pieces."""
        left = self.pairs[total] & ((2 << most) - 1) if 2 <= total <= SIZE else 0
        while left:
            a = (left & -left).bit_length() - 1
            if self.enough(a, total - a, *held):
                return a, total - a
            left &= left - 1
        return None

    def triple(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, int, int] | None:
        """Three lengths, the largest first, with this sum."""
        if total not in self.triples:
            low, own = (total + 2) // 3, 0
            for a in range(low, total - 1):
                if self.there >> a & 1 and self.pairs[total - a] & ((2 << a) - 1):
                    own |= 1 << a
            self.triples[total] = own
        left = self.triples[total]
        while left:
            a = (left & -left).bit_length() - 1
            if not self.there >> a & 1 or not self.pairs[total - a] & ((2 << a) - 1):
                self.triples[total] &= ~(1 << a)
            elif two := self.pair(total - a, (a, *held), a):
                return a, *two
            left &= left - 1
        return None

    def complement(self, gap: int, held: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap."""
        if not 1 <= gap < SIZE:
            return None
        if self.counts[gap] and self.enough(gap, *held):
            return (gap,)
        return self.pair(gap, held) or self.triple(gap, held)


def plan(counts: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequence, as the lengths in order, and how often each is used. counts[n]: pieces of length n, up to SIZE."""
    counts = list(counts)
    out = [((SIZE,), counts[SIZE])] if counts[SIZE] else []
    counts[SIZE] = 0
    sums = Sums(counts)
    for n in range(SIZE - 1, 0, -1):
        while counts[n]:
            found = sums.complement(SIZE - n, (n,))
            if not found:
                break
            kind = (n, *found)
            times = min(counts[x] // kind.count(x) for x in set(kind))
            if not times:
                break
            for x in set(kind):
                sums.take(x, times * kind.count(x))
            out.append((kind, times))
    open_: dict[int, list[list]] = {}  # by gap: kinds that aren't full, and how many sequences there are of each

    def put(kind: tuple[int, ...], times: int, gap: int) -> None:
        open_.setdefault(gap, []).append([kind, times])

    for n in range(SIZE - 1, 0, -1):
        while counts[n]:
            gap = min((g for g in open_ if g >= n), default=None)
            if gap is None:
                each = min(SIZE // n, counts[n])
                times = counts[n] // each
                put((n,) * each, times, SIZE - n * each)
                counts[n] -= times * each
                continue
            kind, have = open_[gap][-1]
            each = min(gap // n, counts[n])
            times = min(have, counts[n] // each)
            counts[n] -= times * each
            open_[gap][-1][1] -= times
            if not open_[gap][-1][1]:
                open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            put(kind + (n,) * each, times, gap - n * each)
    return out + [(kind, times) for g in sorted(open_) for kind, times in open_[g]]


def places(kinds: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows of (length, first rank, first sequence_id, offset), sorted: pieces with ranks from the first on go to sequences from the first on."""
    rows, used, base = [], {}, 0
    for kind, times in kinds:
        offset = 0
        for n in kind:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    ready(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def cut(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(texts), strict=True):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * SIZE)):
                    part = ids[at : at + 4 * SIZE]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    work = Work(docs.sparkSession, "packing")
    cut = work.put(pieces(docs, path))
    counts = [0] * (SIZE + 1)
    for n, c in cut.groupBy("length").count().collect():  # SIZE rows at most
        counts[n] = c
    rows = places(plan(counts))
    salts = max(1, sum(counts) // SALT_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    keys = rows[:, 0] * (1 << 50) + rows[:, 1]

    def place(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, n * (1 << 50) + rank, side="right") - 1
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(rows[at, 2] + rank - rows[at, 1]), "offset": pa.array(rows[at, 3])})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
