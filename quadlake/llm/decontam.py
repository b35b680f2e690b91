"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, template windows are joined by hash, and
the slots' values must map consistently, so re-parameterised questions are found too. DataFrame functions only.

A token is a white-space word without punctuation at its ends, in lower case. One that begins with a digit is a number; a known unit
after a number is a unit; a capitalised word that begins neither a sentence nor a line is a name. Windows of WIDTH tokens are hashed; items
shorter than that have one window of their own length. Each window is looked up literally (its words in lower case, so case and what
precedes a word don't matter) and as a template, both with ss for ß, unless it has under LEAST tokens or under half of them literal. A document holds an item
if at least ENOUGH of the item's windows are found, or half of them where it has fewer than twice as many; of all its windows or of those
with a template. A template window counts only in alignments where each of the item's slot values maps to one value; a literal
window counts always.

Scale: every document's windows are tested in its row against a constant Bloom filter of the benchmark's windows, of 64 bits a window and at most 1 <<
MOST_BITS in all, so nearly only hits leave the scan; a larger benchmark only lets more of the others pass, which the join drops. A window's
hash is folded from those of 1, 2 and 4 tokens. Equal texts are looked into once. The join by window hash deals windows that over 1/HOT of all hits have over salts.

Defined results: null and empty texts have no windows; items under LEAST tokens are found literally only; a repeated item is found under each
id; what a text holds is found by its text, so null and repeated doc_ids are found and dropped by the text of their row; equal rows are found
once by leaks() and kept or dropped together; items with a null item_id are left out. Values are compared in lower case. Other columns, whatever
their names, are ignored by leaks() and kept by drop().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, Work, bitmap, let, spread, words

WIDTH, LEAST, ENOUGH, MOST_BITS = 8, 5, 6, 24
PUNCTUATION = ".,;:!?()[]{}\"'`´…*#$%&|<>«»“”„‘’¿¡=+-–—/\\_~^@€£"
LINE = "\x02"  # before the first word of a line
NUMBER, NAME, UNIT = (k << 40 for k in (1, 2, 3))  # slots among the tokens' hashes, as 64-bit numbers
# Units.
UNITS = "kg g mg lb lbs oz t km m cm mm mi mile miles ft feet inch inches yd l ml cl gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds usd eur c f k w kw v a hz khz mhz ghz kb mb gb tb mph kmh kph".split()


def _digit(code: Column) -> Column:
    return (code >= 48) & (code <= 57)


def _raw(text: Column) -> Column:
    """The words of a text, with LINE before those that begin a line."""
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("SS"))
    return words(F.regexp_replace(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[\\n\\r][\\x20\\x09-\\x0D]*+", f" {LINE}"))


def _tokens(raw: Column, bare: Column, low: Column, hashes: Column) -> Column:
    """The template tokens of the words, one for each: a slot's number, or the hash of the literal word."""

    def canon(bare: Column, i: Column) -> Column:
        before, code = F.get(raw, i - 1), F.ascii(bare)
        capital = ((code >= 65) & (code <= 90)) | ((code >= 192) & (code <= 222))
        inside = before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?", ":") & ~F.get(raw, i).startswith(LINE)
        return (
            F.when(_digit(code), NUMBER)
            .when(F.get(low, i).isin(*UNITS) & _digit(F.ascii(F.ltrim(before, F.lit(LINE)))), UNIT)
            .when(capital & inside & (bare != F.upper(bare)), NAME)
            .otherwise(F.get(hashes, i))
        )

    return F.transform(bare, canon)


def _pairs(a: Column, b: Column, by: int, *seed: Column) -> Column:
    """Hashes of each element of a with the one by places further in b, for all of b's."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), lambda x, y: F.xxhash64(*seed, x, y))


def _windows(powers: dict[int, Column], width: int, literal: bool) -> Column:
    """The hash of each window of width tokens, from those of 1, 2 and 4; those of template windows are apart."""
    parts = [k for k in (4, 2, 1) if width & k] if width < WIDTH else [WIDTH // 2, WIDTH // 2]
    out, by = powers[parts[0]], parts[0]
    for i, k in enumerate(parts[1:], 2):
        out, by = _pairs(out, powers[k], by, *([F.lit(1)] if i == len(parts) and not literal else [])), by + k
    return out


def _values(low: Column, tokens: Column, at: Column, width: int) -> Column:
    """The slots' values in a window: null where the token is literal."""
    return F.transform(F.sequence(at, at + width - 1), lambda j: F.when(F.get(tokens, j).isin(NUMBER, NAME, UNIT), F.get(low, j)))


def _hits(text: Column, widths: list[int], seen) -> Column:
    """Structs of (h, pos, slots, literal) of the windows for which seen(hash) holds. Slots of literal windows are given only without seen."""

    def of(x: Column) -> Column:
        def pick(powers: dict[int, Column], width: int, literal: bool) -> Column:
            def found(wh: Column) -> Column:
                at = F.transform(wh, lambda h, i: F.struct(h.alias("h"), i.alias("pos")))
                slots = lambda y: F.array().cast("array<string>") if literal and seen else _values(x.low, x.tokens, y.pos, width)
                whole = F.transform(F.filter(at, lambda y: seen(y.h)) if seen else at, lambda y: F.struct(y.h.alias("h"), y.pos.alias("pos"), slots(y).alias("slots"), F.lit(literal).alias("literal")))
                none = F.array().cast("array<struct<h:bigint,pos:int,slots:array<string>,literal:boolean>>")
                return F.when(F.exists(wh, seen), whole).otherwise(none) if seen else whole  # most texts have no hit and need no more than their hashes

            return let(_windows(powers, width, literal), found)

        def each(one: Column, literal: bool) -> Column:
            def of_four(two: Column, four: Column) -> Column:
                return F.flatten(F.array(*[pick({1: one, 2: two, 4: four}, w, literal) for w in widths if literal or w >= LEAST]))

            return let(_pairs(one, one, 1), lambda two: let(_pairs(two, two, 2), lambda four: of_four(two, four)))

        return F.concat(each(x.hashes, True), each(x.tokens, False)) if max(widths) >= LEAST else each(x.hashes, True)

    def with_tokens(raw: Column, bare: Column, low: Column) -> Column:
        return let(F.transform(low, lambda t: F.xxhash64(t)), lambda h: let(F.struct(low.alias("low"), h.alias("hashes"), _tokens(raw, bare, low, h).alias("tokens")), of))

    def split(raw: Column) -> Column:
        return let(F.transform(raw, lambda w: F.btrim(w, F.lit(PUNCTUATION + LINE))), lambda bare: let(F.transform(bare, lambda w: F.lower(w)), lambda low: with_tokens(raw, bare, low)))

    return let(_raw(text), split)


def items(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, h, item_pos, slots, literal and own (the window has a template) of each window, and the widths in use (WIDTH at most of them)."""
    rows = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = F.size(words(F.col("text")))
    small = [w for (w,) in rows.select(size.alias("w")).filter((F.col("w") < WIDTH) & (F.col("w") > 0)).distinct().collect()]
    parts = []
    for w in sorted({*small, WIDTH}):
        own = rows.filter(size == w) if w < WIDTH else rows.filter(size >= WIDTH)
        hit = own.select("item_id", F.explode(_hits(F.col("text"), [w], None)).alias("x")).select("item_id", "x.h", F.col("x.pos").alias("item_pos"), F.col("x.slots").alias("item_slots"), "x.literal")
        hit = hit.withColumn("own", (2 * F.size(F.filter("item_slots", lambda v: v.isNull())) >= w) & F.lit(w >= LEAST))
        parts.append(hit.filter("literal OR own").withColumn("item_slots", F.when(F.col("literal"), F.array().cast("array<string>")).otherwise(F.col("item_slots"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["item_id", "item_pos", "h"]), sorted({*small, WIDTH})


def _found(docs: DataFrame, benchmark: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """What the bitmap lets pass: doc_id, text_id, h, pos and slots; and the benchmark's windows."""
    windows, widths = items(benchmark)
    windows = work.put(windows)
    hits = bitmap(windows, 64, MOST_BITS)(lambda seen: _hits(F.col("text"), widths, seen))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.explode(hits).alias("x"))
    return work.put(found.select("doc_id", "text_id", "x.h", "x.pos", "x.slots")), windows  # literal and template windows never share a hash


def matches(found: DataFrame, windows: DataFrame, work: Work) -> DataFrame:
    """A row for each window of a text that is one of an item."""
    each = work.put(found.select("text_id", "h", "pos", "slots").dropDuplicates(["text_id", "h", "pos"]).join(windows.select("h").distinct(), "h", "left_semi"))
    total = each.count()
    often = work.put(each.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") * HOT > total).select("h", F.least("n", F.ceil(F.col("n") * HOT / F.lit(max(total, 1)))).cast("int").alias("salts")))  # under HOT rows
    salted = each.join(F.broadcast(often), "h", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("text_id", "pos"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    dealt = windows.join(F.broadcast(often), "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return salted.join(dealt, ["h", "salt"]).drop("salt")


def _held(docs: DataFrame, benchmark: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """Each item that a text holds, by text_id; and what _found() gives."""
    candidates, windows = _found(docs, benchmark, work)
    found = work.put(matches(candidates, windows, work).withColumn("shift", F.col("pos") - F.col("item_pos")))
    slot = found.select("text_id", "item_id", "shift", F.explode(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("s")).filter("s.i IS NOT NULL")
    values = slot.groupBy("text_id", "item_id", "shift", "s.i").agg(F.min("s.d").alias("a"), F.max("s.d").alias("b"))
    fit = values.groupBy("text_id", "item_id", "shift").agg(F.count("*").alias("n_slots"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("bad"), F.sum(((F.col("a") == F.col("b")) & (F.col("a") != F.col("i"))).cast("long")).alias("changed"))
    aligned = found.join(fit, ["text_id", "item_id", "shift"], "left").filter(F.col("literal") | (F.coalesce("bad", F.lit(0)) == 0))
    held = aligned.groupBy("text_id", "item_id").agg(
        F.size(F.collect_set("item_pos")).alias("n_windows"), F.size(F.collect_set(F.when(F.col("own"), F.col("item_pos")))).alias("n_own"), F.coalesce(F.max("n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.max("changed"), F.lit(0)).alias("n_changed"), F.coalesce(F.max("bad"), F.lit(0)).alias("n_inconsistent"),
    )
    sizes = windows.filter("literal").groupBy("item_id").agg(F.count("*").alias("item_windows"), F.sum(F.col("own").cast("long")).alias("item_own"))
    enough = lambda n, of: (F.col(of) > 0) & (F.col(n) >= F.least(F.lit(ENOUGH), F.ceil(F.col(of) / 2)))
    held = held.join(sizes, "item_id").filter(enough("n_windows", "item_windows") | enough("n_own", "item_own"))
    return work.put(held.select("text_id", "item_id", "n_windows", "item_windows", "n_slots", "n_changed", "n_inconsistent")), candidates


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows found and had, slots, changed and inconsistent slots, of each item that a document holds."""
    work = Work(docs.sparkSession, "decontam")
    held, found = _held(docs, benchmark, work)
    owners = work.put(found.select("doc_id", "text_id").distinct())
    n = owners.groupBy("text_id").agg(F.count("*").alias("_n"))
    return spread(owners, work.put(held.join(n, "text_id")), ["text_id"], owners.count()).drop("text_id")


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns kept."""
    held, _ = _held(docs, benchmark, Work(docs.sparkSession, "decontam"))
    return docs.join(held.select(F.col("text_id").alias("_leak")).distinct(), F.xxhash64(docs["text"]) == F.col("_leak"), "left_anti")
