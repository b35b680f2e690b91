"""Operators over the whole corpus: packing, substring dedup, sharding, decontamination, near-dedup, and the pipeline."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quadlake.llm import common, decontam, neardup, packing, sharding, substring, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(9)
WORDS = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 3))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_token_ids_equal_the_library():
    exact, own = tokenizers.Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    rng, texts = random.Random(2), ["", " ", "It's <|endoftext|> x", "I'LL they've ²½ ª 12,345 İstanbul ΣΑΣ é", "'s's 'S \xa0 a\x85b \x1c c", "a\x01b", "é", "ÅÅ", "日本語", "“q” — … €5", "don't.'", "x_y __ 3rd"]
    for _ in range(3000):
        texts.append("".join(rng.choice(["the", "Ing", "é", "ß", "Ñ", "1", "23", " ", "\n", "'s", "'", "!", "...", "-", "_", "ſ", "ŉ", "$", "Œ", "ab", "\t", "İ", "​"]) for _ in range(rng.randint(1, 12))))
    for got, want in zip(own.encode(texts), exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == want.ids


def test_plan_uses_each_piece_once_and_is_tight():
    rng = random.Random(4)
    for _ in range(20):
        counts = [0] * (packing.SIZE + 1)
        for _ in range(rng.choice([0, 1, 5, 200, 3000])):
            counts[rng.choice([rng.randint(1, 2048), rng.randint(1, 60), 2048, 1024, 700])] += rng.randint(1, 50)
        kinds, used = packing.plan(counts), Counter()
        for kind, times in kinds:
            assert times > 0 and sum(kind) <= packing.SIZE
            for n in kind:
                used[n] += times
        assert [used[n] for n in range(packing.SIZE + 1)] == counts
        best = sorted((n for n, c in enumerate(counts) for _ in range(c)), reverse=True)
        gaps: list[int] = []  # best-fit decreasing, piece by piece
        for n in best[:4000]:
            k = min((g for g in gaps if g >= n), default=None)
            if k is None:
                gaps.append(packing.SIZE - n)
            else:
                gaps[gaps.index(k)] -= n
        if len(best) <= 4000:
            assert sum(t for _, t in kinds) <= len(gaps) + 1


def test_complements_are_found():
    for lengths, gap in (({5}, 5), ({2, 3}, 5), ({1, 2, 4}, 7)):
        counts = [int(n in lengths) for n in range(packing.SIZE + 1)]
        assert sum(packing.Sums(counts).complement(gap)) == gap
    counts = [0] * (packing.SIZE + 1)
    counts[3] = 1
    assert packing.Sums(counts).complement(6) is None  # one piece of 3 isn't two
    counts[3] = 2
    assert packing.Sums(counts).complement(6) == (3, 3)


def test_complements_against_all_combinations():
    rng = random.Random(14)
    for _ in range(150):
        counts = [0] * (packing.SIZE + 1)
        for _ in range(rng.randint(1, 9)):
            counts[rng.randint(1, 40)] += rng.randint(1, 2)
        sums = packing.Sums(list(counts))
        for _ in range(30):
            pool = [n for n, c in enumerate(sums.counts) for _ in range(c)]
            gap, held = rng.randint(1, 110), tuple(rng.sample(pool, min(len(pool), rng.randint(0, 1))))
            for n in held:
                pool.remove(n)
            fits = [any(sum(c) == gap for c in itertools.combinations(pool, k)) for k in (1, 2, 3)]
            found = sums.complement(gap, held)
            assert (found is None) == (not any(fits))
            if found:
                assert sum(found) == gap and len(found) == 1 + fits.index(True) and not Counter(found) - Counter(pool)
                for n in found:  # pieces are used up
                    sums.take(n, 1)


def test_packing(docs, edges):
    texts = [*edges, *(prose(RNG.randint(1, 400)) for _ in range(60)), prose(9000)]
    exact = tokenizers.Tokenizer.from_file(PATH)
    rows = packing.pack(docs(texts)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(by[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // 2048))) and sum(r["length"] for r in got) == len(ids)
        for r in got:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in seqs.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert packing.pack(docs([]).limit(0)).count() == 0


def test_substring_repeats(docs, edges):
    shared = prose(130)
    texts = [*edges, *(prose(120) for _ in range(20)), f"{prose(50)} {shared} {prose(40)}", f"{prose(33)} {shared} {prose(70)}", shared]
    n = len(texts)
    found = defaultdict(list)
    for r in substring.repeats(docs(texts)).collect():
        found[r["doc_id"]].append((r["start"], r["end"], r["kept"]))
    assert set(found) == {n - 3, n - 2, n - 1}
    for k in (n - 3, n - 2):
        data = texts[k].encode()
        assert all(data[s:e].decode() in shared for s, e, _ in found[k]) and sum(e - s for s, e, _ in found[k]) > 0.5 * len(shared)
    assert all(k for _, _, k in found[n - 3]) and not any(k for _, _, k in found[n - 2])
    assert substring.repeats(docs([]).limit(0)).count() == 0


def test_substring_repeats_are_extended_to_the_match(docs):
    rng, texts, shared = random.Random(31), [], []
    for _ in range(60):  # passages of 51 short words, each in two contexts
        p = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(51))
        shared.append(p.encode())
        texts += [f"{prose(30, rng)} {p} {prose(30, rng)}" for _ in range(2)]
    found = defaultdict(list)
    for r in substring.repeats(docs(texts)).collect():
        found[r["doc_id"]].append(texts[r["doc_id"]].encode()[r["start"] : r["end"]])
    whole = sum(any(shared[k // 2] in x for x in found[k]) for k in range(120))
    pieces = lambda t: {t[a:b] for a, b in zip([0, *substring.cuts(t)], substring.cuts(t), strict=False)}
    seeded = [pieces(t.encode()) for t in texts]
    assert whole == sum(bool(seeded[k] & seeded[k ^ 1]) for k in range(120)) and whole >= 112


def test_substring_counts_documents_exactly(docs):
    text = prose(40)
    assert {r["n_docs"] for r in substring.repeats(docs([text] * 777)).collect()} == {777}


def test_deduplication_loses_no_text(docs):
    rng = random.Random(77)
    unique = [f"{''.join(rng.choice('bcdfghklmnprst') + rng.choice('aeiou') for _ in range(3))}{k}" for k in range(3000)]
    t = unique[:400]
    texts = [" ".join(x) for x in (t[:250], t, t[150:400], t[100:300], unique[500:620] + t[20:200] + unique[620:700], t)]
    for _ in range(40):  # overlapping passages of one long text
        a = rng.randrange(700, 2600)
        texts.append(" ".join(unique[a : a + rng.randint(60, 400)]))
    texts += [texts[9], None, ""]
    ids = [*range(len(texts) - 4), 5, 5, None, 3]  # repeated ids with other texts, and a null one
    order = sorted(range(len(texts)), key=lambda k: -1 if ids[k] is None else ids[k])
    clean = substring.deduplicate(docs(texts, ids=ids))
    assert clean.columns == docs(texts).columns and clean.count() == len(texts)
    left, before = Counter(), Counter()
    for r in clean.collect():
        left.update((r["text"] or "").split())
    for k in order:
        before.update(set((texts[k] or "").split()))
    assert all(left[w] >= 1 for w in before)
    assert sum(left.values()) < 1.15 * len(before) < 0.5 * sum(before.values())
    runs = substring.repeats(docs(texts, ids=ids)).collect()
    by = defaultdict(list)
    for r in runs:
        by[r["doc_id"], r["text_id"]].append((r["start"], r["end"]))
    assert all(a[1] <= b[0] for x in by.values() for a, b in zip(sorted(x), sorted(x)[1:]))


def test_split_of_runs_against_each_byte():
    rng = random.Random(5)
    for _ in range(300):
        m = []
        for _ in range(rng.randint(0, 9)):
            s = rng.randint(0, 60)
            m.append((s, s + rng.randint(1, 25), rng.randint(2, 9), rng.randint(0, 9), rng.random() < 0.5))
        runs = substring.split(m)
        state = {x: all(k for s, e, _, _, k in m if s <= x < e) for x in range(90) if any(s <= x < e for s, e, *_ in m)}
        assert {x: k for s, e, _, _, k in runs for x in range(s, e)} == state and sum(e - s for s, e, *_ in runs) == len(state)


def test_substring_edges(docs, edges, monkeypatch):
    shared = prose(60)
    texts = [*edges, f"{prose(30)} {shared}", f"{shared} {prose(20)}", shared, shared]
    n = len(edges)
    ids = [*range(n), 70, 71, None, None]
    want = substring.repeats(docs(texts, ids=ids)).orderBy("doc_id", "start").collect()
    assert {r["doc_id"] for r in want} == {None, 70, 71} and all(r["kept"] == (r["doc_id"] is None) for r in want)
    monkeypatch.setattr(substring, "HOT", 10**9)  # every digest and place by the ways for hot ones
    assert want == substring.repeats(docs(texts, ids=ids)).orderBy("doc_id", "start").collect()


def test_chunks_resist_shifts():
    body = prose(3000).encode()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *substring.cuts(d)], substring.cuts(d), strict=False)}
    a, b = pieces(body), pieces(body[:7000] + b"inserted words" + body[7000:])
    assert len(a - b) <= 6 and b"".join(body[x:y] for x, y in zip([0, *substring.cuts(body)], substring.cuts(body), strict=False)) == body
    for d in (b"", b"a", b"ab " * 5000, bytes(70_000)):
        ends = substring.cuts(d)
        assert (ends[-1] if ends else 0) == len(d) and all(y - x <= substring.MAX for x, y in zip([0, *ends], ends, strict=False))
    h = 0
    for k, x in enumerate(body[:500]):  # the rolling hash, byte by byte
        h = ((h << 1) + int(substring.GEAR[x])) & 0xFFFFFFFF
        assert h == int(substring.rolling(body[:500])[k])
    assert substring.clean("héllo wörld", [(1, 4), (9, 11)]) == "hlo wöld" and substring.clean(None, [(0, 1)]) is None


def test_sharding(docs, edges):
    texts = [*edges, *(prose(RNG.randint(20, 200)) for _ in range(1500)), *["copy of one text " * 10] * 40]
    langs = [RNG.choice(["en", "de", None]) for _ in texts]
    rows = sharding.shard(docs(texts, langs)).collect()
    assert len(rows) == len(texts)
    by, total = defaultdict(list), Counter()
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert set(by) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    big = max(len((t or "").encode()) for t in texts)
    mean = sum(total.values()) / 16
    assert max(total.values()) <= 1.05 * mean + big and len({r["shard"] for r in rows if r["doc_id"] >= len(texts) - 40}) == 1
    assert sharding.shard(docs([]).limit(0)).count() == 0 and sharding.shard(docs([None])).count() == 1


def test_sharding_balance_of_even_texts(docs):
    rows = sharding.shard(docs([prose(50) for _ in range(3000)])).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in rows]
    assert len(sizes) == 16 and max(sizes) <= 1.03 * min(sizes)


def test_groups_of_equal_texts_share_a_shard_if_they_fit_one(docs):
    sizes = {0: 900, 1: 300, 2: 60, 3: 30}  # copies; the first outweighs a shard, the others fit in one
    copies = [prose(60) for _ in sizes]
    texts = [copies[k] for k, n in sizes.items() for _ in range(n)] + [prose(60) for _ in range(4500)] + [""] * 2000
    rows = sharding.shard(docs(texts, ids=[None if k % 50 == 0 else k for k in range(len(texts))])).collect()
    total, where = Counter(), defaultdict(set)
    for r in rows:
        total[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert len(rows) == len(texts) and max(total.values()) <= 1.15 * min(total.values())  # rows of the dealt group fall by hash
    assert [len(where[zlib.crc32(c.encode())]) for c in copies[1:]] == [1, 1, 1] and len(where[zlib.crc32(copies[0].encode())]) > 1
    assert all(len(x) == 1 for c, x in where.items() if c != zlib.crc32(copies[0].encode()))


def test_shards_are_the_boxes_of_their_tree(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(1, 40), rng.randrange(1 << 40), rng.randrange(1 << 38), rng.randrange(1 << 40)) for k in range(900)]
    at = spark.createDataFrame(rows, "digest long, w long, d_size long, d_lang long, d_source long")
    splits = sharding.tree(at)
    nodes = {1: rows}
    for level in splits:  # each split, on sorted points
        for n, (dim, cut) in level.items():
            k = 2 + sharding.DIMS.index(dim)
            own, half = sorted(nodes[n], key=lambda r: r[k]), sum(r[1] for r in nodes[n]) / 2
            nodes[2 * n], nodes[2 * n + 1] = [r for r in own if r[k] < cut], [r for r in own if r[k] >= cut]
            at_best = min(abs(sum(r[1] for r in own[:j]) - half) for j in range(len(own) + 1))
            assert abs(sum(r[1] for r in nodes[2 * n]) - half) <= at_best + 40
    got = {r["digest"]: r["node"] for r in at.select("digest", sharding._node(splits).alias("node")).collect()}
    assert all(got[r[0]] == n for n in range(16, 32) for r in nodes[n])


def benchmark(spark, *texts):
    return spark.createDataFrame([*enumerate(texts), (99, None), (98, ""), (None, "x " * 20)], "item_id long, text string")


def test_decontamination(spark, docs, edges):
    item = "Tom Smith has 12 apples and gives 5 apples to Anna. If he runs 3 km per day, how many apples does he have after 12 days?"
    item = "Yesterday " + item
    same = item.replace("Smith", "Jones").replace("12", "45").replace("5 apples to", "7 apples to").replace("3 km", "8 miles")
    mixed = item.replace("12 apples", "45 apples").replace("12 days", "46 days").replace("5 apples", "7 apples")  # 12 becomes two values
    other = prose(30) + "."
    texts = [*edges, f"{prose(40)}. {item} {prose(20)}", f"{prose(15)}. {same} {prose(40)}", f"{prose(40)}. {other} {prose(30)}", prose(300), item.upper(), prose(10) + " " + " ".join(item.split()[:9])]
    n = len(edges)
    bench = benchmark(spark, item, other, "tiny", "one two three four five six")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs(texts), bench).collect()}
    assert set(got) >= {(n, 0), (n + 1, 0), (n + 2, 1)} and {d for d, _ in got} <= {n, n + 1, n + 2, n + 4}
    assert got[n, 0]["n_changed"] == 0 and got[n + 1, 0]["n_changed"] >= 3 and got[n + 1, 0]["n_inconsistent"] == 0
    row = {(r["doc_id"]): r for r in decontam.leaks(docs([f"{prose(5)}. {mixed}"]), bench).collect()}
    assert not row or row[0]["n_inconsistent"] == 1
    kept = decontam.drop(docs(texts), bench)
    assert kept.columns == docs(texts).columns and kept.count() == len(texts) - len({d for d, _ in got})
    assert decontam.leaks(docs([]).limit(0), bench).count() == 0 and decontam.leaks(docs(texts), bench.limit(0)).count() == 0


def test_decontamination_finds_verbatim_copies_of_any_item(spark, docs):
    names, numbers = "Who Wrote The Famous Novel Pride And Prejudice In England Around 1813", "Sort 5 3 9 1 4 8 2 7 6 0 11 15"
    bench = benchmark(spark, names, numbers, "Define zymurgy briefly")
    texts = [f"{prose(9)} {x} {prose(9)}" for x in (names, numbers, "Define zymurgy briefly")] + [prose(60)]
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(texts), bench).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_decontamination_in_other_case_and_context(spark, docs):
    short, german = "What is the capital of France today", "Welche Stadt liegt an der Elbe und hat den größten Hafen in Deutschland"
    twice = "if Anna has 12 apples and then finds 12 more how many does she own"
    bench = benchmark(spark, short, german, twice)
    texts = [f"see below\n{short}", f"a heading {short}, then", german.lower(), german.upper(), f"{prose(5)} {twice.replace('12 more', '14 more').replace('Anna', 'anna')} {prose(5)}", f"{prose(9)} {twice.replace('12', '15')}", prose(60)]
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(texts), bench).collect()} >= {(0, 0), (1, 0), (2, 1), (3, 1), (5, 2)}


def test_decontamination_with_a_full_bitmap_and_hot_windows(spark, docs, monkeypatch):
    item = prose(40)
    texts, bench = [f"{prose(30)} {item} {prose(9)}"] * 9 + [prose(80)], benchmark(spark, item, *(prose(30) for _ in range(40)))
    a = sorted(map(tuple, decontam.leaks(docs(texts), bench).collect()))
    monkeypatch.setattr(decontam, "MOST_BITS", 6)  # every bit is set: all windows pass to the join
    monkeypatch.setattr(decontam, "HOT", 10**9)
    assert a == sorted(map(tuple, decontam.leaks(docs(texts), bench).collect())) and [r[0] for r in a] == [*range(9)]


def test_a_plan_holds_a_bloom_filter_once(spark, docs):
    rng = random.Random(5)
    rows = docs([prose(9, rng) for _ in range(40)])
    near = rows.limit(9).select("doc_id", F.xxhash64("text").alias("text_id"))
    plan = neardup._likely(rows, near)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("(?:-?[0-9]+,){200,}", plan)) == 1


def test_the_drivers_garbage_is_collected_where_its_heap_has_grown(spark, monkeypatch):
    beans, asked = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans(), []
    work, old = common.Work(spark, "tidy"), next(b for b in beans if "Young" not in b.getName())
    before = old.getCollectionCount()
    work.tidy(share=1.0)
    assert old.getCollectionCount() == before
    work.tidy(share=0.0)
    assert old.getCollectionCount() == before + 1
    monkeypatch.setattr(common.Work, "tidy", lambda self: asked.append(1))
    assert work.put(spark.range(3)).count() == 3 and asked == [1]


def test_decontamination_without_ids(spark, docs):
    item = prose(40)
    texts = [f"{prose(30)} {item}", prose(50), f"{item} {prose(9)}", prose(60), f"{prose(30)} {item}"]
    frame, bench = docs(texts, ids=[None, None, 4, 4, 6]), benchmark(spark, item)
    kept = decontam.drop(frame, bench)
    assert kept.columns == frame.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(None, texts[1]), (4, texts[3])}
    assert sorted((r["doc_id"] or -1) for r in decontam.leaks(frame, bench).collect()) == [-1, 4, 6]


def template_truth(text, item):
    """Whether an item of plain sentences is found, token by token: numbers are slots, all else is literal."""
    low = lambda t: [w.strip(".,?").lower() for w in t.split()]
    canon = lambda ws: ["#" if w[:1].isdigit() else w for w in ws]
    d, i, literal, own, templates = low(text), low(item), set(), set(), defaultdict(list)
    for p in range(len(i) - 7):
        good = 2 * sum(w != "#" for w in canon(i[p : p + 8])) >= 8
        if good:
            own.add(p)
        for q in range(len(d) - 7):
            if d[q : q + 8] == i[p : p + 8]:
                literal.add(p)
            if good and canon(d[q : q + 8]) == canon(i[p : p + 8]):
                templates[q - p].append((p, q))
    for pairs in templates.values():
        to = defaultdict(set)
        for p, q in pairs:
            for a, b, c in zip(i[p : p + 8], d[q : q + 8], canon(i[p : p + 8]), strict=True):
                if c == "#":
                    to[a].add(b)
        if all(len(x) == 1 for x in to.values()):
            literal |= {p for p, _ in pairs}
    n, have, mine = max(0, len(i) - 7), len(literal), len(literal & own)
    return have >= min(6, -(-n // 2)) or bool(own) and mine >= min(6, -(-len(own) // 2))


def test_decontamination_against_brute_force(spark, docs):
    rng, items, texts = random.Random(21), [], []
    word = lambda: rng.choice(WORDS) if rng.random() < 0.8 else str(rng.randint(2, 9))
    for _ in range(12):
        items.append(" ".join(word() for _ in range(rng.randint(8, 30))))
    for _ in range(60):
        w = rng.choice(items).split()
        a = rng.randrange(len(w))
        part = [str(rng.randint(2, 9)) if x.isdigit() and rng.random() < 0.3 else x for x in w[a : a + rng.randint(6, 30)]]
        texts.append(f"{prose(8, rng)} {' '.join(part)} {prose(8, rng)}")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(texts), benchmark(spark, *items)).collect()}
    want = {(k, j) for k, t in enumerate(texts) for j, x in enumerate(items) if template_truth(t, x)}
    assert got == want and 10 < len({k for k, _ in want}) < 60


def near_truth(texts, k=3, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(n, edits, words=120):
    base, out = prose(words).split(), []
    for _ in range(n):
        w = list(base)
        for _ in range(RNG.randint(0, edits)):
            w[RNG.randrange(len(w))] = RNG.choice(WORDS)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_dedup_against_all_pairs(docs, edges, monkeypatch, small):
    texts = [*edges, *(prose(80) for _ in range(40)), *family(60, 6), *family(25, 3), *family(12, 2), "Two words", "two WORDS", "Solo"]
    if small:  # the ways for large nodes and clusters
        for k, v in {"LIMIT": 12, "CLUSTER_WORK": 50, "LEVELS": 2}.items():
            monkeypatch.setattr(neardup, k, v)
    got = {r["doc_id"]: r for r in neardup.groups(docs(texts)).collect()}
    truth = near_truth(texts)
    assert [(got[k]["n_shingles"], got[k]["component_id"]) for k in range(len(texts))] == truth
    assert all(got[k]["kept"] == (truth[k][1] == k) for k in got)


@pytest.mark.parametrize("percent", [85, 80])
def test_deep_trees_keep_pairs_at_the_threshold(percent):
    rng, lost, n = np.random.default_rng(percent), 0, 250
    assert neardup.missed(percent, neardup.LEVELS, neardup.DEEP_TREES) < 1e-6
    for _ in range(n):
        sig = rng.integers(0, 1 << 32, (2, neardup.COORDINATES), dtype=np.uint32)
        sig[1] = np.where(rng.random(neardup.COORDINATES) < percent / 100, sig[0], sig[1])
        keys = [neardup.mix(np.arange(1, neardup.DEEP_TREES + 1, dtype=np.uint64))] * 2
        for level in range(2 + neardup.LEVELS):  # of the nodes of both, those they share
            rate = 2 if level < 2 else neardup.picks(percent)
            nodes = [neardup.below(k, np.repeat(s[None], len(k), axis=0), rate)[0] for k, s in zip(keys, sig, strict=True)]
            keys = [np.intersect1d(*nodes)[:2000]] * 2
        lost += not len(keys[0])
    assert lost == 0


def test_near_dedup_of_a_large_family_at_the_threshold(docs, monkeypatch):
    base, texts = prose(220).split(), []
    for _ in range(400):  # about 0.85 between any two
        w = list(base)
        for k in RNG.sample(range(220), 6):
            w[k] = RNG.choice(WORDS)
        texts.append(" ".join(w))
    for k, v in {"LIMIT": 40, "CLUSTER_WORK": 50}.items():
        monkeypatch.setattr(neardup, k, v)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [c for _, c in near_truth(texts)]


def test_near_dedup_edges(docs):
    rows = {(r["doc_id"], r["n_shingles"]): r["kept"] for r in neardup.groups(docs(["a b c d", "a b c d", "x y z"], ids=[5, None, 5])).collect()}
    assert rows == {(5, 2): True, (None, 2): True, (5, 1): True}
    assert neardup.groups(docs([]).limit(0)).count() == 0


def test_near_dedup_with_repeated_ids(docs):
    a, b, c = prose(80), prose(80), prose(80)
    kept = neardup.keep(docs([a, a, b, c], ids=[3, 5, 5, 7])).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(3, a), (5, b), (7, c)}
    texts = [*family(12, 3), *family(12, 3), *(prose(70) for _ in range(6)), "one two", "", None]
    ids = [RNG.randint(0, 9) for _ in texts]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.groups(docs(texts, ids=ids)).collect())
    truth, smallest = near_truth(texts), {}
    for k, (_, root) in enumerate(truth):
        smallest[root] = min(smallest.get(root, ids[k]), ids[k])
    assert got == Counter((ids[k], n, smallest[root], smallest[root] == ids[k]) for k, (n, root) in enumerate(truth))
    left = {r["text"] for r in neardup.keep(docs(texts, ids=ids), 3, 85).collect()}
    assert all(any(truth[k][1] == root and t in left for k, t in enumerate(texts)) for root in smallest)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(neardup.components(spark.createDataFrame(edges, "u long, v long"), common.Work(spark, "t")).collect())
    assert all(got.get(x, x) == r for x, r in up.items())


def test_pipeline(spark, tmp_path):
    item = prose(30) + "."
    good = [prose(60) for _ in range(30)]
    near = good[0].split()
    near[3] = "changed"
    texts = [*good, " ".join(near), f"{prose(40)} {item} {prose(5)}", prose(50) + " a.b@example.org " + prose(5), None, "", "short text"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, work, ids = common.table(spark, str(tmp_path), "documents"), common.Work(spark, "t"), []
    columns = d.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = work.put(stage(spark, d, str(tmp_path)))
        if k < 4:
            assert d.columns == columns
            ids.append({r["doc_id"] for r in d.collect()})
            texts_left = {r["doc_id"]: r["text"] for r in d.collect()}
    assert ids[0] == set(range(33)) and ids[1] == ids[0] - {30} and ids[2] == ids[1] - {31} and ids[3] == ids[2]
    assert "[EMAIL]" in texts_left[32] and texts_left[5] == good[5]
    assert {r["doc_id"] for r in d.collect()} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == d.count()


def test_decontamination_windows_of_every_width(spark):
    rows = [(k, [f"w{i % 5}" for i in range(k)]) for k in range(14)]
    hashes = F.transform("w", lambda t: F.xxhash64(t))

    def windows(width, literal):
        return common.let(hashes, lambda one: common.let(decontam._pairs(one, one, 1), lambda two: common.let(decontam._pairs(two, two, 2), lambda four: decontam._windows({1: one, 2: two, 4: four}, width, literal))))

    frame = spark.createDataFrame(rows, "k int, w array<string>")
    seen = {}
    for width in range(1, decontam.WIDTH + 1):
        for literal in [True, False] if width >= decontam.LEAST else [True]:
            for k, found in frame.select("k", windows(width, literal)).collect():
                own = [tuple(f"w{j % 5}" for j in range(i, i + width)) for i in range(k - width + 1)]
                assert len(found) == len(own)
                for h, w in zip(found, own, strict=True):
                    assert seen.setdefault(h, (w, literal)) == (w, literal)
    assert len(seen) == len(set(seen.values())) == 5 * (decontam.WIDTH + decontam.WIDTH - decontam.LEAST + 1)


def test_neardup_shuffles_texts_of_candidates_only(docs):
    rows = docs([f"text {k}" for k in range(5000)], ids=[k % 4000 for k in range(5000)])
    near = rows.filter("doc_id % 50 = 0").selectExpr("doc_id", "xxhash64(text) AS text_id")
    got = neardup._likely(rows, near).select("doc_id", "text_id").collect()
    assert {tuple(r) for r in near.collect()} <= {tuple(r) for r in got} and len(got) < 200
    assert neardup._likely(rows, near.limit(0)).count() == 0
