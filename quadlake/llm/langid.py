"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1- to 3-grams of the lower-cased text (runs of white space count as one space) go to BUCKETS hash buckets. The model is
fitted on documents with a language and text that are not held out, at most about TRAIN_DOCS of them, those with the smallest
hashes of doc_id; the bound is the only sampling. Its log-probability matrix (languages x BUCKETS) is small whatever the corpus and
goes to the workers with the task. Scoring takes every whole text, in numpy: an Arrow batch is one array of code points, and the
gathered log-probabilities are summed by document.

Defined results: null text, or text without a letter: `und`, score 0; ties go to the language that sorts first; without any
training row all are `und`; a null doc_id is never held out nor learned from. The score is the posterior of the prediction, tempered by length.
Rows are independent: repeated rows and null ids are kept (a null id is never held out, nor learnt from). Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

BUCKETS, TRAIN_DOCS, ALPHA, HELD_OUT = 1 << 14, 12_000, 0.05, 2
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and where each text's begin; a text is framed by spaces."""
    parts = [" ".join(t.lower().split()).encode("utf-32-le", "surrogatepass") for t in texts]
    code = np.frombuffer(b" \0\0\0" + b" \0\0\0".join(parts) + b" \0\0\0", dtype="<u4").astype(np.uint64)
    sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    one = code * MIX[0]
    two = one[:-1] * MIX[1] + one[1:]
    three = two[:-1] * MIX[2] + one[2:]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    n = int(starts[-1])
    pad = lambda a: np.concatenate((a[:n], np.zeros(max(0, n - len(a)), dtype=np.uint64)))
    mixed = np.stack([pad((a ^ (a >> np.uint64(31))) * MIX[1] >> shift) for a in (one, two, three)], axis=1)
    return mixed.astype(np.int64), starts


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log-probabilities."""
    ready(docs.sparkSession)
    able = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = able.select("doc_id").count()
    if n > TRAIN_DOCS:
        able = able.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * TRAIN_DOCS / n))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            at, starts = grams(texts)
            for k, lang in enumerate(langs):
                totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                totals[lang] += np.bincount(at[starts[k] : starts[k + 1]].ravel(), minlength=BUCKETS)
        for lang, c in totals.items():
            where = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(c[where], pa.int64())], names=["lang", "b", "n"])

    rows = able.select("text", "lang").mapInArrow(count, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.full((len(langs), BUCKETS), ALPHA)
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        np.add.at(table, ([place[x] for x in rows.column("lang").to_pylist()], rows.column("b").to_numpy()), rows.column("n").to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> list[tuple[str, float]]:
    out, some = [("und", 0.0)] * len(texts), [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not langs or not some:
        return out
    at, starts = grams([texts[k] for k in some])
    sums = np.empty((len(some), len(langs)))
    for j in range(len(langs)):
        sums[:, j] = np.add.reduceat(matrix[j][at].sum(axis=1, dtype=np.float64), starts[:-1])
    mean = sums / np.sqrt(np.diff(starts))[:, None]  # tempered: grams overlap, so their evidence isn't independent
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for k, best, row in zip(some, sums.argmax(axis=1), p, strict=True):
        out[k] = (langs[best], float(row[best]))
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    langs, matrix = fit(docs)

    def score(batches):
        for batch in batches:
            found = predict(batch.column("text").to_pylist(), langs, matrix)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, SCHEMA)
