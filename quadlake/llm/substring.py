"""Substring dedup: content-defined chunks, cut by a gear rolling hash, are deduplicated by digest.

A boundary stands where the top bits of the gear hash of the last 32 bytes are zero, so boundaries move with the content and an
insertion only changes the chunks around it. Chunks have MIN to MAX bytes (the last may be shorter), about 48. A chunk whose digest is found in two or
more documents is repeated, and the seed of a match with the first occurrence (smallest document, then place) of the chunk; neighbouring seeds join.
A seed's match is extended on both sides by comparing bytes, up to REACH of them, and cut back to whole words where it goes past
one. Matches of at least RUN bytes count on both their sides. What a document has from an earlier place is a run that isn't kept; what only
later places share is a run that is. Every byte of a run that isn't kept stands at an earlier place too, and the first of these places is never
in such a run, so taking all of them out (deduplicate()) loses no text.

A document is a doc_id with a text: two texts of one doc_id are two documents, ordered by text_id (a checksum), and equal rows are one.

Scale: a digest's first occurrence and counts are aggregated before their shuffle. Only repeated digests are joined with the chunks;
those that over 1/HOT of all chunks have (HOT of them at most) by broadcast, so no task gets all chunks of one digest. The chunks of a
document are read in order, one by one. First places that over 1/HOT of all seeds point at are joined by salts. What is
gathered for a document never has more rows than the document has chunks.

Defined results: null and empty texts have no chunks; repeats within one document alone are no finding; n_docs counts rows, so repeated
rows count each where other documents share the text; null doc_ids are documents like others, before all ids. Offsets are bytes of the
UTF-8 text. Other columns, whatever their names, are ignored by repeats() and kept by deduplicate().
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, ready

BITS, MIN, MAX, RUN, REACH, HOT = 5, 16, 256, 96, 512, 4096
NO_ID = -(1 << 63)  # what a null doc_id is inside
AGAIN = 1 << 31  # the bit of a place that says that its chunk stands before in its document
SPACES = b" \t\n\x0b\f\r"


def _gear() -> np.ndarray:
    """256 numbers from a fixed mixing rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its distance; by doubling the window."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks. Where no boundary comes within MAX bytes, as in periodic text, the place of the least hash is taken."""
    out, last, n, h = [], 0, len(data), rolling(data)
    for c in [*(np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist(), n]:
        while c - last > MAX:
            last += MIN + int(h[last + MIN - 1 : last + MAX].argmin())
            out.append(last)
        if c - last >= MIN and c < n:
            out.append(c)
            last = c
    if last < n:
        out.append(n)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").filter("text <> ''")


def text_id(data: bytes) -> int:
    return zlib.crc32(data) & 0x7FFFFFFF


def _text_id(text: Column) -> Column:
    return F.crc32(text.cast("binary")).bitwiseAND(0x7FFFFFFF)


def _batch(schema: list[tuple[str, pa.DataType]], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk: its digest (a, b; the last nine bits of b are its size), doc_id, and place (text_id, AGAIN, offset)."""
    ready(docs.sparkSession)
    schema = [(n, pa.int64()) for n in ("a", "b", "doc_id", "place")]

    def of(batches):
        for batch in batches:
            for ids, texts in ((batch.column("doc_id")[k : k + 100].to_pylist(), batch.column("text")[k : k + 100].to_pylist()) for k in range(0, batch.num_rows, 100)):
                digests, sizes, owners, places = [], [], [], []
                for doc_id, text in zip(ids, texts, strict=True):
                    data, last, seen = text.encode("utf-8", "surrogatepass"), 0, set()
                    high = text_id(data) << 32
                    for end in cuts(data):
                        d = hashlib.blake2b(data[last:end], digest_size=16).digest()
                        digests.append(d)
                        sizes.append(end - last)
                        owners.append(doc_id)
                        places.append(high | (AGAIN if d in seen else 0) | last)
                        seen.add(d)
                        last = end
                two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield _batch(schema, (two[:, 0], (two[:, 1] & ~511) | np.array(sizes, dtype=np.int64), owners, places))

    return _texts(docs).mapInArrow(of, "a long, b long, doc_id long, place long")


def forward(a: bytes, b: bytes, whole: bool = True) -> int:
    """Bytes that two texts go on alike from a match's end, cut back to the end of a word if there is white space among them."""
    n = min(len(a), len(b))
    if a[:n] != b[:n]:
        x = np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)
        n = int(x.argmax())
    if all(n == len(t) or t[n] in SPACES for t in (a, b)):
        return len(a[:n].rstrip(SPACES))
    k = max((a.rfind(bytes([c]), 0, n) for c in SPACES), default=-1)
    if k >= 0:
        return len(a[:k].rstrip(SPACES))
    while whole and n and n < len(a) and a[n] & 0xC0 == 0x80:  # whole characters
        n -= 1
    return n


def backward(a: bytes, b: bytes) -> int:
    """The same before a match's start."""
    n = forward(a[::-1], b[::-1], False)
    while n and a[len(a) - n] & 0xC0 == 0x80:
        n -= 1
    return n


SEED = [(n, pa.int64()) for n in ("doc_id", "text_id", "start", "end", "n_docs", "f_doc", "f_text", "f_start")]


def _seeds(hits: DataFrame) -> DataFrame:
    """Neighbouring hits (doc_id, place, size, n_docs, f_doc, f_place) whose first places are neighbours too, joined. Rows come sorted and are read in one pass."""

    def of(batches):
        held: np.ndarray | None = None  # the run that may go on
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in ("doc_id", "place", "size", "n_docs", "f_doc", "f_place")], axis=1) if batch.num_rows else np.empty((0, 6), dtype=np.int64)
            at, f_at = x[:, 1] & (AGAIN - 1), x[:, 5] & (AGAIN - 1)
            rows = np.stack([x[:, 0], x[:, 1] >> 32, at, at + x[:, 2], x[:, 3], x[:, 4], x[:, 5] >> 32, f_at], axis=1)
            if held is not None:
                rows = np.concatenate([held[None], rows])
            if not len(rows):
                continue
            a, b = rows[:-1], rows[1:]
            again = np.concatenate(([False], (a[:, :3] == b[:, :3]).all(axis=1) & (a[:, 5:] == b[:, 5:]).all(axis=1)))  # a repeated row of the document
            rows = rows[~again]
            a, b = rows[:-1], rows[1:]
            on = (a[:, [0, 1, 5, 6]] == b[:, [0, 1, 5, 6]]).all(axis=1) & (a[:, 3] == b[:, 2]) & (a[:, 2] - a[:, 7] == b[:, 2] - b[:, 7])
            starts = np.flatnonzero(np.concatenate(([True], ~on)))
            ends = np.concatenate((starts[1:], [len(rows)])) - 1
            out = rows[starts]
            out[:, 3] = rows[ends, 3]
            out[:, 4] = np.maximum.reduceat(rows[:, 4], starts)
            held, out = out[-1], out[:-1]
            yield _batch(SEED, out.T)
        if held is not None:
            yield _batch(SEED, held[:, None])

    ordered = hits.withColumn("text_id", F.shiftright("place", 32)).repartition("doc_id", "text_id").sortWithinPartitions("doc_id", "text_id", F.col("place").bitwiseAND(AGAIN - 1))
    return ordered.drop("text_id").mapInArrow(of, ", ".join(f"{n} long" for n, _ in SEED))


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text_id, start, end and up to REACH bytes before and after each place (doc_id, text_id, start, end)."""
    wanted = places.distinct().groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    rows = _texts(docs).withColumn("text_id", _text_id(F.col("text"))).join(wanted, ["doc_id", "text_id"])
    schema = [("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]

    def of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, d, v = batch.column("text")[k].as_py().encode("utf-8", "surrogatepass"), batch.column("doc_id")[k].as_py(), batch.column("text_id")[k].as_py()
                out = [(d, v, p["start"], p["end"], data[max(0, p["start"] - REACH) : p["start"]], data[p["end"] : p["end"] + REACH]) for p in batch.column("places")[k].as_py() if p["end"] <= len(data)]
                yield _batch(schema, zip(*out, strict=True) if out else [[]] * 6)

    return rows.mapInArrow(of, "doc_id long, text_id long, start long, end long, left binary, right binary").dropDuplicates(["doc_id", "text_id", "start", "end"])


MATCH = [*((n, pa.int64()) for n in ("doc_id", "text_id", "at", "start", "end", "n_docs", "first")), ("kept", pa.bool_())]


def _extended(pairs: DataFrame) -> DataFrame:
    """Matches on both their sides, from seeds with both contexts; at is where the side's seed begins."""

    def of(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = backward(r["left"], r["f_left"]), forward(r["right"], r["f_right"])
                size = r["end"] - r["start"]
                if size + right + left >= RUN:
                    for d, v, s, kept in ((r["doc_id"], r["text_id"], r["start"], False), (r["f_doc"], r["f_text"], r["f_start"], True)):
                        out.append((d, v, s, s - left, s + size + right, r["n_docs"], r["f_doc"], kept))
            yield _batch(MATCH, zip(*out, strict=True) if out else [[]] * len(MATCH))

    # Matches around one seed overlap, so their union is from the first start to the last end; a first place has one row then.
    found = pairs.mapInArrow(of, ", ".join(f"{n} {'boolean' if n == 'kept' else 'long'}" for n, _ in MATCH))
    return found.groupBy("doc_id", "text_id", "at", "kept").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("n_docs").alias("n_docs"), F.min("first").alias("first"))


def split(matches: list[tuple[int, int, int, int, bool]]) -> list[tuple[int, int, int, int, bool]]:
    """Runs (start, end, n_docs, first, kept) of one document from its matches, in order and apart: matches that aren't kept win."""
    out: list[tuple[int, int, int, int, bool]] = []
    for kept in (False, True):
        own: list[list] = []
        for s, e, n, first, _ in sorted(m for m in matches if m[4] == kept):
            if own and s <= own[-1][1]:
                own[-1][1:] = [max(own[-1][1], e), max(own[-1][2], n), min(own[-1][3], first)]
            else:
                own.append([s, e, n, first])
        if not kept:
            gone = [tuple(x) for x in own]
            out += [(*x, False) for x in gone]
            continue
        k = 0
        for s, e, n, first in own:
            while k < len(gone) and gone[k][1] <= s:
                k += 1
            j, at = k, s
            while j < len(gone) and gone[j][0] < e:
                if gone[j][0] > at:
                    out.append((at, gone[j][0], n, first, True))
                at = max(at, gone[j][1])
                j += 1
            if at < e:
                out.append((at, e, n, first, True))
    return sorted(out)


RUNS = [("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_docs", pa.int64()), ("first_doc_id", pa.int64()), ("kept", pa.bool_())]


def _runs(matches: DataFrame) -> DataFrame:
    lists = matches.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "end", "n_docs", "first", "kept")).alias("m"))

    def of(batches):
        for batch in batches:
            out = []
            for d, v, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "m")), strict=True):
                own = None if d == NO_ID else d
                out += [(own, v, s, e, n, None if f == NO_ID else f, kept) for s, e, n, f, kept in split([tuple(x.values()) for x in m])]
            yield _batch(RUNS, zip(*out, strict=True) if out else [[]] * len(RUNS))

    return lists.mapInArrow(of, ", ".join(f"{n} {'boolean' if n == 'kept' else 'long'}" for n, _ in RUNS))


def repeats(docs: DataFrame) -> DataFrame:
    """A row for each run of repeated text: doc_id, text_id, start, end, n_docs (most rows that share one of its chunks), first_doc_id (the
    smallest first document of its matches), kept."""
    work = Work(docs.sparkSession, "substring")
    all_ = work.put(chunks(docs))
    total, doc = all_.count(), F.xxhash64("doc_id", F.shiftright("place", 32))
    first = all_.groupBy("a", "b").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.min(doc).alias("h"), F.max(doc).alias("h2"), F.count_if(F.col("place").bitwiseAND(AGAIN) == 0).alias("n_docs"), F.count("*").alias("n")).filter("h <> h2")
    first = work.put(first.select("a", "b", F.col("f.doc_id").alias("f_doc"), F.col("f.place").alias("f_place"), "n_docs", "n"))
    hot = first.filter(F.col("n") * HOT > total)  # under HOT rows
    cold = all_.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(first.filter(F.col("n") * HOT <= total), ["a", "b"])
    hits = all_.join(F.broadcast(hot), ["a", "b"]).unionByName(cold).filter("doc_id <> f_doc OR place <> f_place")
    seeds = work.put(_seeds(hits.select("doc_id", "place", F.col("b").bitwiseAND(511).alias("size"), "n_docs", "f_doc", "f_place")))
    work.drop(all_), work.drop(first)
    seeds = seeds.withColumn("f_end", F.col("f_start") + F.col("end") - F.col("start"))
    place, f_place = ["doc_id", "text_id", "start", "end"], ["f_doc", "f_text", "f_start", "f_end"]
    firsts = seeds.select(*[F.col(a).alias(b) for a, b in zip(f_place, place, strict=True)])
    near = work.put(_contexts(docs, seeds.select(*place).unionByName(firsts)))
    there = near.select(*[F.col(b).alias(a) for a, b in zip(f_place, place, strict=True)], F.col("left").alias("f_left"), F.col("right").alias("f_right"))
    n = seeds.count()
    often = seeds.groupBy(*f_place).agg(F.count("*").alias("k")).filter(F.col("k") * HOT > n).select(*f_place, F.least("k", F.ceil(F.col("k") * HOT / F.lit(max(n, 1)))).cast("int").alias("salts"))  # under HOT rows, of HOT salts together twice at most
    often = F.broadcast(work.put(often))
    salted = seeds.join(often, f_place, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_id", "start"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    there = there.join(often, f_place, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return _runs(_extended(salted.join(near, place).join(there, [*f_place, "salt"])))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, without what stands at an earlier place; texts that become empty stay as empty texts."""
    gone = repeats(docs).filter("NOT kept").groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")).withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"})
    marked = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]) & (_text_id(docs["text"]) == gone["_text"]), "left").drop("_doc", "_text")
    names, text = docs.columns, docs.columns.index("text")

    def of(batches):
        for batch in batches:
            columns, spans = list(batch.columns[:-1]), batch.column(batch.num_columns - 1).to_pylist()
            columns[text] = pa.array([clean(t, [(s["start"], s["end"]) for s in x or ()]) for t, x in zip(columns[text].to_pylist(), spans, strict=True)], columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(of, T.StructType(docs.schema.fields))


def clean(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the given byte spans (sorted, apart); characters that a span would cut are left whole."""
    if text is None or not spans:
        return text
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in spans:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:start])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
