"""Operators that judge one text at a time: quality rules, personal data, language, HTML, chat."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.llm import chat, html, langid, pii, quality

RNG = random.Random(5)
SYLLABLES = {"en": "the ing and er on th ou st".split(), "de": "sch ein ung der ich zu ge be".split(), "fr": "eau que ent les ais oi ré un".split()}


def prose(lang, n, rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def rule_truth(text):
    """The base rules, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_quality_rules(spark, docs, edges):
    texts = [*edges, *(prose("en", 60) for _ in range(20)), "a b c d e f\na b c d e f\nx y z u v w #1 <b>", *(" ".join("zz%%% qq&&&".split() * 10) for _ in range(5))]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(edges), len(edges) + 20)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs(texts), labels).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in quality.RULES) == rule_truth(t), t and t[:40]
    assert all(got[k]["kept"] for k in range(len(edges), len(edges) + 20)) and not any(got[k]["kept"] for k in range(len(texts) - 5, len(texts)))
    assert all(not got[k]["kept"] for k in got if got[k]["base_failed"])
    kept = quality.keep(docs(texts), labels)
    assert kept.columns == docs(texts).columns and {r["doc_id"] for r in kept.collect()} == {k for k in got if got[k]["kept"]}
    none = quality.judge(docs(texts), labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in none.collect())  # without a target the base rules decide
    assert quality.judge(docs(texts).limit(0), labels).count() == 0


def test_repeated_windows_from_pairs_and_halves_of_hashes(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd"[: rng.randint(2, 4)]) for _ in range(rng.choice([0, 1, 4, 5, 6, 7, 9, 30, 200]))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality._hashes(F.col("text")).alias("h"))
    got = df.select("text", quality._repeated(quality._with_later(F.col("h"), 1)).alias("n")).collect()
    assert all(r["n"] == rule_truth(r["text"])[4] for r in got) and len({r["n"] for r in got}) > 9
    windows = [[rng.choice([-2, -1, 0, 5]) * (1 << 32) + rng.choice([0, 1, 7, 2**31, 2**32 - 1]) for _ in range(rng.randint(1, 25))] for _ in range(150)]  # many share a half only
    got = spark.createDataFrame([(w,) for w in windows], "w array<bigint>").select("w", quality._covered(F.col("w")).alias("n")).collect()
    assert all(r["n"] == len({k + j for k, h in enumerate(r["w"]) if r["w"].count(h) > 1 for j in range(5)}) for r in got)


def quality_truth(grams, trusted):
    """Scores and verdicts, text by text; grams: the buckets of each text's n-grams, as tuples."""
    raw, target = Counter(b for g in {*grams} for b in g), Counter(b for g in {grams[k] for k in trusted} for b in g)
    nr, nt, c = sum(raw.values()), sum(target.values()), quality.PRIOR
    score = lambda g, own, n: sum(math.log((((target[b] - own[b]) / n) / (raw[b] / nr) + c) / (1 + c)) for b in g) / len(g)
    loo = sorted(score(g, Counter(g), nt - len(g)) for g in {grams[k] for k in trusted})
    low, mid = np.quantile(loo, [0.05, 0.5])
    return [(s, s >= mid - quality.SPREADS * (mid - low) - 1e-9) for s in (score(g, Counter(), nt) for g in grams)]


def test_quality_scores_and_floor_against_brute_force(spark, docs):
    rng = random.Random(12)
    texts = [prose("en", rng.randint(12, 60), rng) for _ in range(60)] + [prose("de", 30, rng) for _ in range(10)]
    texts += texts[3:8] * 4
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs(texts), labels).orderBy("doc_id").collect()
    buckets = docs(texts).orderBy("doc_id").select(quality._ngrams(quality._hashes(F.col("text"))).alias("g")).collect()
    want = quality_truth([tuple(r["g"]) for r in buckets], range(40))
    assert [r["score"] for r in got] == pytest.approx([s for s, _ in want], abs=1e-5)
    assert sum(r["kept"] != k for r, (_, k) in zip(got, want, strict=True)) == 0 and not all(k for _, k in want)


def test_copies_change_no_quality_verdict(spark, docs):
    texts = [prose("en", 60) for _ in range(40)] + [prose("de", 60) for _ in range(8)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    alone = quality.judge(docs(texts), labels).orderBy("doc_id").collect()
    copied = quality.judge(docs(texts + [texts[0]] * 50 + [texts[35]] * 20 + [texts[45]] * 9), labels).orderBy("doc_id").collect()
    assert alone == copied[: len(texts)] and all(r["kept"] for r in alone[:40])


def test_quality_floor_is_by_language(spark, docs):
    texts = [prose("en", 60) for _ in range(200)] + [prose("de", 60) for _ in range(120)]
    langs = ["en"] * 200 + ["de"] * 120
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(150), *range(200, 260)]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(texts, langs), labels).collect()}
    assert sum(got[k] for k in range(200)) >= 198 and sum(got[k] for k in range(200, 320)) >= 118
    bare = quality.judge(docs(texts).drop("lang"), labels)
    assert bare.count() == len(texts)


def test_quality_target_is_every_trusted_document(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 25 = 0 AS int) AS toxic")
    assert quality.trusted(None, labels).count() == 24_000


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def pii_truth(text):
    out = []
    for kind, p in BASE.items():
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_pii_base_spans_against_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.", "@", "x@y.z", ".", "1", "22", "4111111111111111", " ", "-", "+", "+1 (555) 555-1234", "10.0.0.1", "300.1.1.1", "é", "(", ")", "00255", "5500 0000 0000 0004"]) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == pii_truth(text), text


def test_pii_query(docs, edges):
    texts = [*edges, "mail a.b@c.org now 🙂 call +1 (555) 555-1234 at 10.0.0.1", "card 4111 1111 1111 1111", "cards 4465758382889437 4465758382889437 end", "ssn 123-45-6789 token = \"0123456789abcdef0123456789abcdef01234567\"", "order 123456789012 on 2024-01-02, version 1.2.3"]
    got = {r["doc_id"]: r for r in pii.spans(docs(texts)).collect()}
    for k, t in enumerate(texts):
        base = pii_truth(t)
        assert [got[k][f"n_{x}"] for x in BASE] == [sum(s[0] == x for s in base) for x in BASE]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert {f"{a}:{b}:{c}" for a, b, c in base} <= set(got[k]["spans"].split(",")) | {""}
    n = len(edges)
    assert got[n + 2]["spans"].count("card") == 2 and got[n + 2]["n_card"] == 0  # the method finds both cards in the chain
    assert "ssn:4:15" in got[n + 3]["spans"] and "secret" in got[n + 3]["spans"] and got[n + 4]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.scrub(docs(texts)).collect()}
    assert clean[n] == "mail [EMAIL] now 🙂 call [PHONE] at [IP]" and clean[0] is None and clean[8] == texts[8]
    assert pii.scrub(docs(texts)).columns == docs(texts).columns and pii.spans(docs([]).limit(0)).count() == 0


def test_pii_proposes_the_whole_of_long_candidates():
    chain = "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2025 end"
    assert ("card", 5, 36) in pii.propose(chain, [])
    for n in (129, 200, 400):
        key = ("aB3dE5gH7jK9" * 40)[:n]
        for k in (key, "abcdefghijklmnopqrstuvwxyzabcd" + key):
            assert ("secret", 8, 8 + len(k)) in pii.propose(f"token = {k} end", [])
    assert ("mac", 4, 21) in pii.propose("mac aa:bb:cc:dd:ee:ff on", []) and pii.propose("no such thing here", []) == []


def test_pii_is_linear_on_hostile_texts():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@" * 300_000, "1 " * 150_000, "a@" * 100_000):
        pii.find([t], pii.model())


def test_language_held_out(docs, edges):
    langs = ["en", "de", "fr"] * 60
    texts = [prose(x, 30) for x in langs] + edges
    got = langid.identify(docs(texts, langs + [None] * len(edges))).collect()
    by = {r["doc_id"]: r for r in got}
    held = [k for k in range(180) if by[k]["held_out"]]
    import zlib

    assert all(by[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in by)
    assert len(held) > 20 and all(by[k]["lang_pred"] == langs[k] for k in held)
    assert [by[180 + k]["lang_pred"] for k in (0, 1, 2, 3)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs(["abc"], [None])).collect()} == {"und"}
    assert langid.identify(docs(texts).limit(0)).count() == 0


def test_language_ignores_the_label_of_what_it_predicts(docs):
    langs = ["en", "de"] * 40
    texts = [prose(x, 20) for x in langs]
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(texts, langs)).collect()}
    wrong = ["de" if langid_held(k) else x for k, x in enumerate(langs)]
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(texts, wrong)).collect()}


def langid_held(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 4 == 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, None), ("", ""), ("a < b", "a < b"), ("<p>one<p>two &amp; x", "one\n\ntwo & x"), ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), ("<table><tr><th>Name<th>N<tr><td>Al<td>10</table>", "Name | N\nAl   | 10"),
        ("<table><td>1<td>2</table>", "1 | 2"), ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a x | y | b"), ("x<script>var a='</p>'</script>y<style>p{}</style>", "xy"), ("<div hidden>no</div><div style='display:none'>no</div>yes", "yes"),
        ("<pre>a\n  b</pre>", "a\n  b"), ("a<br>b", "a\nb"), ("<b>x</b> <i>y</i>", "x y"), ("<!-- open", ""), ("<p", ""), ("<head><title>t</title></head>b", "b"), ("<a href='1>2'>l</a>", "l"), ("&lt;p&gt;", "<p>"),
    ],
)
def test_html(page, want):
    assert html.extract(page) == want


def test_html_is_bounded():
    for bad in ("<div>" * 50_000 + "deep", "<table><tr>" * 20_000 + "x", "<b>" * 3000 + "x" + "</i>" * 3000, "<p><ul><li>" * 5000, "<script>" * 5000, "<a " * 20_000):
        html.extract(bad)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    assert sorted((tuple(r) for r in html.texts(pages).collect()), key=str) == sorted([(1, "u", "a"), (2, None, None), (None, "v", "")], key=str)


def conversations(spark, n=40, turns=6):
    rng, rows = random.Random(1), []
    for c in range(n):
        if c % 4 == 0:
            rows.append((c, 0, "system", "You are a helper."))
        for k in range(turns):
            rows.append((c, k + 1, "assistant" if k % 2 else "user", prose("en", 60, rng) + "\n" + prose("en", 40, rng) if k % 2 else prose("en", 6, rng) + "?"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_roles(spark):
    df = conversations(spark)
    got = chat.roles(df).collect()
    assert len(got) == df.count() and sum(r["role"] == r["role_pred"] for r in got) >= 0.97 * len(got)
    r = next(r for r in got if r["conv_id"] == 1 and r["position"] == 0)
    assert r["rendered"].startswith("<|user|>\n") and r["rendered"].endswith("\n<|end|>\n")
    odd = spark.createDataFrame([(None, None, None, None), (7, 1, None, ""), (7, 1, None, ""), (7, None, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert chat.roles(odd, chat.fit(df)).count() == 4 and chat.roles(odd.limit(0)).count() == 0


def test_chat_segments_give_the_same_path(spark, monkeypatch):
    df = conversations(spark, 3, 60)
    model = chat.fit(df)
    whole = sorted((r["conv_id"], r["position"], r["role_pred"]) for r in chat.roles(df, model).collect())
    monkeypatch.setattr(chat, "SEGMENT", 7)
    assert whole == sorted((r["conv_id"], r["position"], r["role_pred"]) for r in chat.roles(df, model).collect())


def test_chat_transcripts(spark):
    model = chat.fit(conversations(spark))
    assert chat.parse("User: what is it?\nAssistant: It is this.\nAnd more.\n### Human: ok?\nAI: yes", model) == [("user", "what is it?"), ("assistant", "It is this.\nAnd more."), ("user", "ok?"), ("assistant", "yes")]
    assert chat.parse(None, model) == [] and chat.parse("  ", model) == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(1, 6))
        scores, start, step = rng.normal(size=(n, 6)), rng.normal(size=6), rng.normal(size=(6, 6))
        enter, leave = (int(x) if x < 6 else None for x in rng.integers(0, 8, 2))

        def total(path, scores=scores, start=start, step=step, enter=enter):
            first = start[path[0]] if enter is None else step[enter, path[0]]
            return first + sum(scores[k, s] for k, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))

        best = max((p for p in itertools.product(range(6), repeat=n) if leave is None or p[-1] == leave), key=total)
        assert total(chat.viterbi(scores, start, step, enter, leave)) == pytest.approx(total(best))


def test_roles_do_not_see_labels(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "a"), (1, 1, "user", "a"), (1, 2, "user", None), (None, 0, None, "x\n" * 9000)]
    frame = lambda swap: spark.createDataFrame([(c, t, {"user": "assistant", "assistant": "user"}.get(r, r) if swap else r, x, "k", 3) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, seg string, position int")
    model = chat.fit(conversations(spark))
    a, b = ([(r["conv_id"], r["position"], r["role_pred"]) for r in chat.roles(frame(s), model).collect()] for s in (False, True))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == len(rows)


def test_markers_are_learnt(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{'Bot' if t % 2 == 0 else 'Client'}: words {c} {t}") for c in range(400) for t in range(4)]  # here a marker names the other
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r for r, _ in chat.parse("Bot: how are you\nClient: fine\nBot: good", model)] == ["user", "assistant", "user"]


def test_transcripts_are_parsed_back(spark):
    model, right, n = chat.fit(conversations(spark)), 0, 0
    rng = random.Random(11)
    for _ in range(30):
        turns = [(["user", "assistant"][t % 2], f"{prose('en', rng.randint(3, 12), rng)}{'?' if t % 2 == 0 else ''}") for t in range(6)]
        name = rng.choice([("Human: ", "AI: "), ("### User\n".strip() + ": ", "### Assistant: "), ("[Q] ", "[A] ")])
        got = chat.parse("\n".join(name[r == "assistant"] + x for r, x in turns), model)
        right, n = right + sum(a == b for a, b in zip(got, turns)), n + len(turns)
    assert right >= 0.95 * n


def test_pii_finds_keys_after_joined_words():
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    assert any(k == "secret" for k, _, _ in pii.find([f"some words aws_secret_access_key = {key} and more"], pii.model())[0][1])


def test_text_queries_with_clashing_columns_and_null_ids(spark, docs, edges):
    frame = docs([*edges, "plain words here", "plain words here"], ids=[None] * len(edges) + [4, 4]).withColumn("spans", F.lit(1)).withColumn("lang_pred", F.lit(2)).withColumn("held_out", F.lit("x"))
    assert pii.spans(frame).count() == langid.identify(frame).count() == frame.count() == len(edges) + 2
    pages = spark.createDataFrame([(1, "u", "<p>" + "word " * 50_000, 3, "z")] * 2, "page_id long, url string, html string, text long, n string")
    assert [len(r["text"]) > 200_000 for r in html.texts(pages).collect()] == [True, True] and html.texts(pages.limit(0)).count() == 0
