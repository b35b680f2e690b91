"""Token ids of a public word-level BPE file, as the `tokenizers` library gives them, at a fraction of its cost.

The file's text rules (NFC, lower case, white space dropped, split by a pattern, merges within a split part) make ids a function of
the white-space word, so each worker keeps the ids of words it has seen. New words are merged by a byte-pair encoder whose
ranks are the file's ids: the end-of-word mark becomes one trailing byte, which the lowest ranks join to the last letter.
Texts with characters for which case or composition depend on their neighbours, with the special tokens' strings, or with the mark
itself are given to the library as they are. tests/llm/ compares both on random texts.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken
import tokenizers

MARK = "\x01"
SAFE = re.compile("[\t-\r -~\xa1-įı-ž–—‘-„…€]*")
KEPT_WORDS = 600_000
STOPS = frozenset(".,;:!?)")


def _alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest is moved up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Encoder:
    def __init__(self, path: str):
        self.exact = tokenizers.Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        of, end, ranks = _alphabet(), spec["model"]["end_of_word_suffix"], {}
        self.specials = [x["content"] for x in spec["added_tokens"]]
        for token, k in spec["model"]["vocab"].items():
            body, tail = (token[: -len(end)], MARK.encode()) if token.endswith(end) else (token, b"")
            if token not in self.specials:
                ranks[bytes(of[c] for c in body) + tail] = k
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.final = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.final[[k for token, k in ranks.items() if token.endswith(MARK.encode()) and len(token) > 1]] = True
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.parts = regex.compile(split)
        self.seen: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Puts the ids of new words into seen."""
        parts, sizes = [], []
        for w in new:
            if w.isalpha():
                parts.append(w)
                sizes.append(1)
            elif w[-1] in STOPS and w[:-1].isalpha():
                parts += (w[:-1], w[-1])
                sizes.append(2)
            else:
                parts += (x := self.parts.findall(w))
                sizes.append(len(x))
        flat = np.array(self.merges.encode_ordinary(MARK.join([*parts, ""])), dtype="<u4")
        ends = np.concatenate(([0], 4 * (np.flatnonzero(self.final[flat]) + 1)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        data = flat.tobytes()
        for k, w in enumerate(new):
            self.seen[w] = data[ends[k] : ends[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        for k, t in enumerate(texts):
            if not SAFE.fullmatch(t) or any(s in t for s in self.specials):
                out[k] = np.array(self.exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            words = t.lower().split()
            ids = list(map(self.seen.get, words))
            if None in ids:
                lost = [j for j, x in enumerate(ids) if x is None]
                if len(self.seen) > KEPT_WORDS:
                    self.seen.clear()
                self.learn(list({words[j] for j in lost}))
                for j in lost:
                    ids[j] = self.seen[words[j]]
            out[k] = b"".join(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
