"""Personal data: base patterns, and candidate gradient boosting for what they miss.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. High-recall generators then propose overlapping
candidate spans: card numbers inside longer digit chains, phone numbers without a plus sign, spelt-out addresses, and further
kinds (national ids, bank accounts, IPv6, hardware addresses, secrets). Boosted trees score format and context features, Platt
scaling turns margins into probabilities, and a threshold for each kind, chosen on held-out examples for PRECISION, selects
redactions; among overlapping ones the most probable stays, and none may overlap a base span. The model is trained here on
EXAMPLES synthetic lines with a fixed seed, so it's the same in every run.

Every pattern is linear in the text: runs are bounded or possessive, and e-mail addresses are found from their @.
Null texts count as empty: no spans. Rows are independent (repeated rows and null ids too); offsets are code points. Other columns, whatever
their names, are ignored by spans() and kept by scrub().
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boost import Boosted, platt
from .common import ready

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "ipv6", "mac", "secret")
EXAMPLES, SEED, PRECISION, CONTEXT, CARD_DIGITS = 6000, 20, 0.99, 40, 19
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @: the local part is the whole run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CHAIN.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


PROPOSE = {
    "phone": [re.compile(r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"), re.compile(r"(?<![0-9])00[1-9][0-9]{8,12}(?![0-9])")],
    "email": [re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{2,63}){1,4}")],
    "ssn": [re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])")],
    "iban": [re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")],
    "ipv6": [re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")],
    "mac": [re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-])")],
    "secret": [re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9+/_-])[A-Za-z0-9+/_-]{20,}+")],
}
POSITIVE = {
    "card": "card visa mastercard amex credit debit karte tarjeta carte",
    "phone": "phone tel call mobile fax contact cell telefon teléfono téléphone",
    "email": "mail email contact write e-mail reach",
    "ssn": "ssn social security",
    "iban": "iban account bank konto cuenta compte",
    "ipv6": "ip ipv6 host server address",
    "mac": "mac hardware device address ethernet",
    "secret": "token secret password passwd key api_key apikey api auth bearer",
}
NEGATIVE = "order version invoice isbn page part serial sku date ref figure section build commit sha1 md5 checksum digest hash time model lot".split()
WORD = re.compile(r"[^\W\d]{2,}(?:[_-][^\W\d]+)*")


def propose(text: str, base: list[Span]) -> list[Span]:
    """Candidate spans; they may overlap each other, but not a base span."""
    out: list[Span] = []
    if DIGIT.search(text):
        for m in CHAIN.finditer(text):
            if m.end() - m.start() >= 12:
                groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m[0])]
                for i, (start, _) in enumerate(groups):
                    n = 0
                    for a, b in groups[i : i + CARD_DIGITS]:
                        n += b - a
                        if n > CARD_DIGITS:
                            break
                        if n >= 12 and luhn(text[start:b].replace(" ", "").replace("-", "")):
                            out.append(("card", start, b))
        for kind in ("phone", "ssn", "iban"):
            for p in PROPOSE[kind]:
                out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    for kind, need in (("ipv6", ":"), ("mac", ":-"), ("secret", "0123456789+/_-")):
        if any(c in text for c in need):
            for p in PROPOSE[kind]:
                out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    if re.search(r"[\[(](?:at|AT)[\])]", text):
        out += [("email", m.start(), m.end()) for m in PROPOSE["email"][0].finditer(text)]
    starts, reach = [s for _, s, _ in base], list(_running_max(e for _, _, e in base))
    clear = lambda s, e: not (k := bisect.bisect_left(starts, e)) or reach[k - 1] <= s
    return [(k, s, e) for k, s, e in out if clear(s, e)]


def _running_max(values):
    most = 0
    for v in values:
        most = max(most, v)
        yield most


def _mod97(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, from the span and CONTEXT code points on either side."""
    kind, start, end = span
    s, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = "".join(c for c in s if "0" <= c <= "9")
    before, n = [x for w in WORD.findall(left.lower()) for x in (*re.split("[_-]", w), w)], max(len(s), 1)
    near = set(POSITIVE[kind].split())
    runs = max((len(m[0]) for m in re.finditer(r"(.)\1*", digits)), default=0)
    counts = np.array([s.count(c) for c in set(s)], dtype=float) / n
    area = digits[:3]
    return [
        *(float(kind == k) for k in KINDS), float(len(s)), float(len(digits)), len(digits) / n, sum(c.isupper() for c in s) / n, sum(not c.isalnum() for c in s) / n,
        float(-(counts * np.log2(counts)).sum()), float(12 <= len(digits) <= 19 and luhn(digits)), float(kind == "iban" and _mod97(s)),
        float(kind == "ssn" and area not in ("000", "666") and area < "900" and digits[3:5] != "00" and digits[5:] != "0000"), float(runs), float(digits[:1] in ("3", "4", "5", "6")), float(s.startswith("(")),
        float(s.count(":")), float(any(c in "ghijklmnopqrstuvwxyz" for c in s.lower())), float(left[-1:].isalnum() or left[-1:] in ("$", "€", "#")), float(right[:1].isalnum()),
        float(any(w in near for w in before[-4:])), float(any(w in NEGATIVE for w in before[-3:])), float(left.rstrip(" \t\"'")[-1:] in ("=", ":")), float(bool(re.search(r"[0-9][ .,-]?$", left))), float(bool(re.match(r"[ .,-]?[0-9]", right))),
        float(any(c.islower() for c in s) and any(c.isupper() for c in s)),
    ]


def _examples(rng: random.Random) -> list[tuple[str, list[Span]]]:
    """Synthetic lines with the spans that are personal data; lines without are hard negatives."""
    filler = ["".join(rng.choice(["an", "the", "er", "ti", "on", "re", "sch", "que", "lo", "mi", "da", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    some = lambda: " ".join(rng.choice(filler) for _ in range(rng.randint(2, 7)))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def iban() -> str:
        code, body = rng.choice(["DE", "FR", "ES", "GB"]), num(rng.choice([18, 20]))
        return next(x for k in range(100) if _mod97(x := f"{code}{k:02d}{body}"))

    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = {
        "card": lambda: card(),
        "phone": lambda: rng.choice([f"({rng.randint(200, 999)}) {num(3)}-{num(4)}", f"{rng.randint(200, 999)}-{num(3)}-{num(4)}", f"{rng.randint(200, 999)}.{num(3)}.{num(4)}", f"00{rng.randint(1, 9)}{num(10)}"]),
        "email": lambda: rng.choice(["{} [at] {} [dot] com", "{}(at){}.org", "{} (at) {} (dot) net"]).format(rng.choice(filler), rng.choice(filler)),
        "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": lambda: (lambda x: x if rng.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4)))(iban()),
        "ipv6": lambda: ":".join(pick(4) for _ in range(8)) if rng.random() < 0.6 else f"{pick(4)}:{pick(4)}:{pick(4)}::{pick(3)}",
        "mac": lambda: rng.choice(":-").join(pick(2) for _ in range(6)),
        "secret": lambda: rng.choice([pick(40), pick(32), "sk_" + pick(32, alnum), pick(36, alnum)]),
    }
    bad = [
        lambda: ("order", num(rng.randint(12, 19))), lambda: ("invoice", f"{num(3)}-{num(3)}-{num(4)}"), lambda: ("isbn", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"), lambda: ("part", f"9{num(2)}-00-{num(4)}"),
        lambda: ("commit", pick(40)), lambda: ("checksum", pick(32)), lambda: ("sku", pick(22, alnum)), lambda: ("version", ".".join(num(2) for _ in range(6))), lambda: ("serial", f"{pick(2, 'ABCDEF')}{num(14)}"),
        lambda: ("time", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}"), lambda: ("", f"{num(4)} {num(4)} {num(4)} {num(4)}"), lambda: ("", "".join(rng.choice(filler) for _ in range(6)) + "-" + rng.choice(filler)), lambda: ("ref", f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: ("", f"{rng.choice(filler)}_{rng.choice(filler)}_{rng.choice(filler)}_{rng.choice(filler)}_{num(1)}"), lambda: ("date", f"{num(4)}{num(4)}{num(4)}"),
    ]
    out = []
    for _ in range(EXAMPLES):
        if rng.random() < 0.5:
            kind = rng.choice(list(good))
            key = rng.choice(POSITIVE[kind].split()) + rng.choice([" ", ": ", " = ", ' = "']) if rng.random() < (0.97 if kind in ("secret", "ssn", "phone") else 0.6) else ""
            head, body = f"{some()} {key}", good[kind]()
            twice = kind == "card" and rng.random() < 0.3
            text = f"{head}{body}{' ' + body if twice else ''} {some()}"
            out.append((text, [(kind, len(head), len(head) + len(body))] + [(kind, len(head) + len(body) + 1, len(head) + 2 * len(body) + 1)] * twice))
        else:
            key, body = rng.choice(bad)()
            out.append((f"{some()} {key + ' ' if key else ''}{body} {some()}", []))
    return out


@functools.lru_cache(maxsize=1)
def model() -> tuple[Boosted, tuple[float, float], dict[str, float]]:
    """The trees, the calibration, and the threshold of each kind."""
    x, y, kinds, part = [], [], [], []
    for i, (text, truth) in enumerate(_examples(random.Random(SEED))):
        for span in propose(text, [s for s in base_spans(text) if s not in truth]) if truth else propose(text, base_spans(text)):
            x.append(features(text, span))
            y.append(float(span in truth))
            kinds.append(span[0])
            part.append(i % 3)
    x, y, kinds, part = np.array(x), np.array(y), np.array(kinds), np.array(part)
    trees = Boosted().fit(x[part > 0], y[part > 0])
    margin = trees.margin(x[part == 0])
    scale = platt(margin, y[part == 0])
    p, thresholds = 1 / (1 + np.exp(-(scale[0] * margin + scale[1]))), {}
    for k in KINDS:
        of = kinds[part == 0] == k
        order = np.argsort(-p[of], kind="stable")
        exact = np.cumsum(y[part == 0][of][order]) / (np.arange(of.sum()) + 1)
        fine = np.flatnonzero(exact >= PRECISION)
        ranked = np.append(p[of][order], 0.0)  # the threshold lies halfway to the first candidate that would break the precision
        thresholds[k] = max(0.5, float(ranked[fine[-1] : fine[-1] + 2].mean())) if len(fine) else 1.1
    return trees, scale, thresholds


def find(texts: list[str | None], fitted) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, sorted by start, then kind."""
    trees, (a, b), thresholds = fitted
    base = [base_spans(t) if t else [] for t in texts]
    candidates = [(i, s) for i, t in enumerate(texts) if t for s in propose(t, base[i])]
    out = [(s, list(s)) for s in base]
    if candidates:
        p = 1 / (1 + np.exp(-(a * trees.margin(np.array([features(texts[i], s) for i, s in candidates])) + b)))
        taken: dict[int, list[tuple[int, int]]] = {}
        for k in sorted(range(len(candidates)), key=lambda k: (-p[k], candidates[k][1][1], -candidates[k][1][2], KINDS.index(candidates[k][1][0]))):
            i, (kind, start, end) = candidates[k]
            if p[k] < thresholds[kind]:
                continue
            mine = taken.setdefault(i, [])
            at = bisect.bisect_left(mine, (start, end))
            if (at and mine[at - 1][1] > start) or (at < len(mine) and mine[at][0] < end):
                continue
            mine.insert(at, (start, end))
            out[i][1].append((kind, start, end))
        for i in taken:
            out[i][1].sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or run of overlapping ones, replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans(docs: DataFrame) -> DataFrame:
    """Of every document: doc_id, counts of base spans, the digest of base spans, and all spans."""
    ready(docs.sparkSession)
    fitted = model()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    def of(batches):
        for batch in batches:
            found = find(batch.column("text").to_pylist(), fitted)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in BASE]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], schema=schema)

    kinds = ", ".join(f"n_{k} long" for k in BASE)
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(of, f"doc_id long, {kinds}, base_sha256 string, spans string")


def scrub(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with every span replaced in text; n_chars, where there is one, follows the text."""
    ready(docs.sparkSession)
    fitted, text, size = model(), docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.LongType) else None

    def of(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            new = [redact(t, s) for t, (_, s) in zip(texts, find(texts, fitted), strict=True)]
            columns = list(batch.columns)
            columns[text] = pa.array(new, batch.schema.field(text).type)
            if size is not None:
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(batch.column(size).to_pylist(), texts, new, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(of, docs.schema)
