"""Quality rules: a trusted-target against raw-corpus log-likelihood ratio over hashed n-grams, beside base rules. DataFrame functions only.

Model: word unigrams and bigrams go to BUCKETS hash buckets. Two multinomials are counted, one over the distinct texts of all documents
and one over a trusted target (all distinct texts labelled good and not toxic). Smoothing mixes both with PRIOR times the target's size of raw probability: a bucket's ratio is log((p_target / p_raw + PRIOR) / (1 +
PRIOR)), whatever the corpus' size. A document's score is the mean of its n-grams' ratios. It's kept if no base rule fails and the score
reaches the floor of its language.

Floors come from the target's own scores, each computed with the text's own n-grams taken out of the target (as for a text that isn't in
it): the median less SPREADS times its distance from the 5th percentile, by language for those with LEAST_OWN texts or more, over all of them
for the rest. All scores count, to DIGITS decimals, so a histogram of bounded size holds them. Copies of a text change neither the counts nor the floors.

Scale: texts are shuffled by digest, after equal ones of a partition became one, to count each distinct text once, and once more to find
the target's; which digests those are is found by ids and digests alone. The counts are aggregated before their shuffle and have BUCKETS rows
at most; they and the floors are all that reaches the driver, and come back as constant arrays (ratios of DIGITS decimals, as plans carry
them) and constants. Target scores and judging are a scan without a shuffle.

Defined results: null and empty texts have no words, fail the base rules and score null; without a target or raw counts every
ratio is 0 and only base rules decide; a target of one text has no score of its own and so no floor; repeated rows are judged each; null
doc_ids are kept as they are; a null or missing lang is a language of its own; other columns, whatever their names, are ignored by judge()
and kept as they are by keep().
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, let, words

BUCKETS, PRIOR, SPREADS, LEAST_OWN, DIGITS = 1 << 16, 0.1, 4, 50, 6
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "[#*$%&|<>]"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _with_later(hashes: Column, by: int) -> Column:
    """A hash of each element with the one that stands so many places later, for those that have one."""
    some = lambda from_: F.slice(hashes, from_, F.greatest(F.size(hashes) - by, F.lit(0)))
    return F.zip_with(some(1), some(1 + by), lambda a, b: F.xxhash64(a, b))


def _bucket(hash_: Column) -> Column:
    return hash_.bitwiseAND(BUCKETS - 1).cast("int")


def _ngrams(hashes: Column) -> Column:
    """Buckets of the unigrams and bigrams, from the word hashes."""
    return F.transform(F.concat(hashes, _with_later(hashes, 1)), _bucket)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of the trusted target."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


@dataclass
class Model:
    """The ratio of each bucket, and the floors by language, with one for the others (None: no floor)."""

    ratios: list[float]
    floors: dict[str, float]
    floor: float | None

    def reached(self, score: Column, lang: Column) -> Column:
        if self.floor is None:
            return F.lit(True)
        own = F.element_at(_constant(self.floors, "map<string,double>"), lang) if self.floors else F.lit(None).cast("double")
        return F.coalesce(score, F.lit(0.0)) >= F.coalesce(own, F.lit(self.floor))


def _constant(value, type_: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), type_)  # folded once; a literal for each number would be far slower to build


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _counts(texts: DataFrame) -> DataFrame:
    """b and n of each bucket that has n-grams."""
    grams = texts.select(_hashes(F.col("text")).alias("h")).select("h", _with_later(F.col("h"), 1).alias("p")).select(F.explode(F.concat("h", "p")).alias("x"))
    return grams.select(_bucket(F.col("x")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))


def _list(counts: DataFrame) -> list[int]:
    out = [0] * BUCKETS
    for b, n in counts.collect():  # BUCKETS rows at most
        out[b] = n
    return out


def _alone(texts: DataFrame, own: list[int], raw: list[int]) -> DataFrame:
    """lang, and the score of a target's text without its own n-grams; null if the target has no others."""
    total, n_raw, owns, raws = sum(own), sum(raw), _constant(own, "array<double>"), _constant(raw, "array<double>")
    grams = texts.select("lang", _hashes(F.col("text")).alias("h")).select("lang", _ngrams(F.col("h")).alias("b"))
    grams = grams.select("lang", F.sort_array("b").alias("b"), F.size("b").alias("n"), (F.lit(n_raw / (1 + PRIOR)) / F.nullif(F.lit(total) - F.size("b"), F.lit(0))).alias("f"))
    b = lambda i: F.get("b", i)
    state = lambda at, s: F.struct(at.alias("at"), s.alias("s"))

    def add(a: Column, i: Column) -> Column:  # at the last of a run of equal buckets, which began at a.at
        k = i + 1 - a.at
        return F.when(b(i).eqNullSafe(b(i + 1)), a).otherwise(state(i + 1, a.s + k * F.log((F.get(owns, b(i)) - k) * F.col("f") / F.get(raws, b(i)) + PRIOR / (1 + PRIOR))))

    return grams.select("lang", F.when(F.col("f").isNotNull() & (F.col("n") > 0), F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), state(F.lit(0), F.lit(0.0)), add, lambda a: a.s) / F.col("n")).alias("score"))


def _floors(target: DataFrame, own: list[int], raw: list[int], work: Work) -> tuple[dict[str, float], float | None]:
    """Floors from the target's scores without their own n-grams; target: digest, lang, text."""
    scores = _alone(target, own, raw).select("lang", F.round("score", DIGITS).alias("score"))
    scores = work.put(scores.groupBy("lang", "score").agg(F.count("*").alias("n"))).filter("score IS NOT NULL")  # before, it would score twice
    at = F.percentile("score", F.array(F.lit(0.05), F.lit(0.5)), F.col("n"))
    found = scores.groupBy("lang").agg(at.alias("q"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_OWN).select("lang", "q").unionByName(scores.agg(at.alias("q")).select(F.lit(None).cast("string").alias("lang"), "q")).collect()
    floors = {lang: q[1] - SPREADS * (q[1] - q[0]) - SPREADS * 10**-DIGITS for lang, q in found if q}
    return {k: v for k, v in floors.items() if k is not None}, floors.get(None)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, counted over all documents' distinct texts."""
    work = Work(docs.sparkSession, "quality")
    texts = docs.select("doc_id", _lang(docs).alias("lang"), "text").filter("text <> ''").withColumn("digest", F.xxhash64("text"))
    picked = texts.select("doc_id", "lang", "digest").join(trusted(docs, labels), "doc_id", "left_semi").groupBy("digest").agg(F.min("lang").alias("lang"))
    each = texts.groupBy("digest").agg(F.first("text").alias("text"))
    target = work.put(each.join(picked, "digest"))
    raw, own = _list(work.put(_counts(each.select("text")))), _list(work.put(_counts(target)))
    n_raw, n_own = sum(raw), sum(own)
    if not n_own:
        return Model([0.0] * BUCKETS, {}, None)
    share = [max(r, 1) / n_raw for r in raw]
    ratios = [round(math.log((t / n_own / s + PRIOR) / (1 + PRIOR)), DIGITS) if r else 0.0 for r, t, s in zip(raw, own, share, strict=True)]
    return Model(ratios, *_floors(target, own, raw, work))


def _covered(windows: Column) -> Column:
    """Words in windows of WINDOW words whose hash another window has. Sorted first as numbers of half a hash and the start; only windows whose
    neighbour there has the same half, which are few, are sorted by their whole hashes."""
    near = lambda s, x, j: F.coalesce(F.shiftright(F.get(s, j).bitwiseXOR(x), 32) == 0, F.lit(False))
    alike = lambda s: F.transform(F.filter(s, lambda x, i: near(s, x, i - 1) | near(s, x, i + 1)), lambda x: x.bitwiseAND((1 << 32) - 1).cast("int"))

    def covered(at: Column) -> Column:  # the sorted starts of repeated windows
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW), p - a.p)).alias("n"), p.alias("p")), lambda a: a.n)

    def starts(pairs: Column) -> Column:  # pairs: windows with their starts, sorted, so equal windows are neighbours
        same = lambda x, j: F.coalesce(F.get(pairs, j).h == x.h, F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.p))

    halves = F.sort_array(F.zip_with(windows, F.sequence(F.lit(0).cast("long"), F.size(windows).cast("long") - 1), lambda h, i: h.bitwiseAND(-1 << 32).bitwiseOR(i)))
    at = F.sort_array(F.transform(let(halves, alike), lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("p"))))
    return let(let(at, starts), covered)


def _repeated(pairs: Column) -> Column:
    """Words in windows of WINDOW (five) words that are found twice or more, from the hashes of neighbouring words. A window found twice holds two
    runs of four words found twice; only where there may be such, windows are hashed and compared."""
    return let(_with_later(pairs, 2), lambda fours: F.when(F.size(F.array_distinct(fours)) + 1 >= F.size(fours), 0).otherwise(let(_with_later(fours, 1), _covered)))


def rules(text: Column, lang: Column, model: Model) -> Column:
    """A struct of RULES, kept and the score."""
    text, ratios = F.coalesce(text, F.lit("")), _constant(model.ratios, "array<double>")

    def score(hashes: Column, pairs: Column) -> Column:
        return F.when(F.size(hashes) > 0, F.aggregate(F.concat(hashes, pairs), F.lit(0.0), lambda a, h: a + F.get(ratios, h.bitwiseAND(BUCKETS - 1))) / F.greatest(2 * F.size(hashes) - 1, F.lit(1)))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    sizes = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of_words(w: Column) -> Column:
        return let(let(F.struct(F.transform(w, lambda x: F.xxhash64(x)).alias("h"), F.char_length(F.array_join(w, "")).alias("c")), lambda x: F.struct(x.h.alias("h"), x.c.alias("c"), _with_later(x.h, 1).alias("p"))), of_hashes)

    def of_hashes(x: Column) -> Column:
        return F.struct(F.size(x.h).cast("long").alias("n_words"), x.c.cast("long").alias("word_chars"), _repeated(x.p).cast("long").alias("n_repeat_words"), score(x.h, x.p).alias("score"))

    def finish(x: Column) -> Column:
        failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > REPEAT_PERCENT * x.n_words)
        return F.struct(
            x.n_words.alias("n_words"), x.word_chars.alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), sizes.cast("long").alias("n_dup_lines"),
            x.n_repeat_words.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & model.reached(x.score, lang)).alias("kept"), x.score.alias("score"),
        )

    return let(let(words(text), of_words), finish)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base figures, kept and score of every document."""
    return docs.select("doc_id", rules(docs["text"], _lang(docs), fit(docs, labels)).alias("_r")).select("doc_id", "_r.*")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; no shuffle, each row is judged where it lies."""
    return docs.filter(rules(docs["text"], _lang(docs), fit(docs, labels)).getField("kept"))
