"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines; turns are then rendered in one form.

States are role x (begins a turn, goes on). Observations are lines: a speaker marker, whether the line begins a turn where the
source tells so (a table row), the turn's and the line's length, a question mark, a list or code look. The tables of the model are
counted from labelled conversations that aren't held out, at most about TRAIN_TURNS turns; the role column is never an input of the
recovery. parse() takes a raw transcript; roles() takes conversations as rows.

Scale: a conversation is cut into segments of SEGMENT turns, and a task gets one segment at a time. Where a conversation has more
than one, each segment first gives its max-plus matrix (best score from each entering to each leaving state), these are
combined in order, and the segments are then decoded between their entering and leaving states: the same path as one long Viterbi.

Defined results: null text is an empty line and is rendered as empty; turns are ordered by turn (null last), then text, and rows of one turn with
one text keep a place each and get one role, that of the first (within a segment); null conv_id is one conversation of its own; ties go to
the role that sorts first; without labels the roles alternate from user by the prior counts; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready

ROLES = ("assistant", "system", "user")
SEGMENT, TRAIN_TURNS, SMOOTH, MARKER, UNKNOWN = 256, 20_000, 0.5, 100, -1
STATES = [(r, begins) for r in range(3) for begins in (True, False)]
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
# Speaker markers by role.
MARKERS = {
    "assistant": "assistant ai bot chatbot model gpt response answer a",
    "system": "system instructions instruction context sys",
    "user": "user human question prompt customer q client person",
}
MARKERS_AT = re.compile(r"[ \t]*(?:#{1,6}[ \t]*|\*\*|\[|<\|?|>[ \t]?)?(" + "|".join(sorted(set(" ".join(MARKERS.values()).split()), key=lambda w: (-len(w), w))) + r")(?:\*\*)?[ \t]*(?:\*\*:|:\*\*|:|\]:?|\|?>:?)[ \t]*", re.I)
SIZES = (4, 8, 3, 12, 9, 2, 3)  # values of each feature


def marker(line: str) -> tuple[int, int]:
    """1 + the role that a line's marker names, and where the text after it begins; 0, 0 without one."""
    m = MARKERS_AT.match(line)
    if not m:
        return 0, 0
    return next(1 + k for k, r in enumerate(ROLES) if m[1].lower() in MARKERS[r].split()), m.end()


def line_features(line: str, blank_before: int, begins: int = UNKNOWN, turn_chars: int = UNKNOWN) -> list[int]:
    role, _ = marker(line)
    n = len(line)
    look = 1 if re.match(r"\s*(?:[-*•]|[0-9]{1,3}[.)])\s", line) else 2 if line.startswith(("    ", "\t", "```")) else 0
    return [role or UNKNOWN, min(7, n.bit_length() // 2) if n else 0, blank_before + 1 if blank_before >= 0 else UNKNOWN, min(11, turn_chars.bit_length()) if turn_chars >= 0 else UNKNOWN, min(8, line.count(" ").bit_length()), int(line.rstrip().endswith("?")), look] + [begins]


class Hmm:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Log-likelihood of each line in each state; unknown features say nothing, a known beginning rules states out."""
        x = np.array(rows, dtype=np.int64).reshape(-1, len(SIZES) + 1)
        out = np.zeros((len(x), len(STATES)))
        for f, table in enumerate(self.emit):
            out += np.where(x[:, f, None] >= 0, table[:, np.maximum(x[:, f], 0)].T, 0.0)
        begins = np.array([b for _, b in STATES])
        for value in (0, 1):
            out[np.ix_(x[:, -1] == value, begins != bool(value))] += -1e6
        return out


def untrained() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Prior counts: conversations begin with system or user, and speakers take turns."""
    start, step = np.full(6, 1e-3), np.full((6, 6), 1e-3)
    emit = [np.full((6, n), SMOOTH) for n in SIZES]
    for s, (r, begins) in enumerate(STATES):
        start[s] += begins * (1.0 if ROLES[r] != "assistant" else 0.1)
        for t, (q, again) in enumerate(STATES):
            step[s, t] += 1.0 if (r == q and not again) else 0.5 if again and r != q and ROLES[q] != "system" else 0.0
        emit[0][s] = [1e-3, *(MARKER * (0.97 if begins and q == r else 0.01) for q in range(3))]  # as MARKER lines: a marker mostly tells the truth, and begins a turn; data may say otherwise
    return start, step, emit


def turn_lines(text: str | None, begins: int = 1) -> list[list[int]]:
    lines = (text or "").split("\n")
    return [line_features(x, -1 if not k else int(not lines[k - 1].strip()), begins if not k else 0, len(text or "") if not k else UNKNOWN) for k, x in enumerate(lines)]


def fit(conversations: DataFrame) -> Hmm:
    ready(conversations.sparkSession)
    able = conversations.select("conv_id", "turn", "role", "text").filter(F.lower("role").isin(*ROLES) & F.col("conv_id").isNotNull() & (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2))
    n = able.count()
    if n > TRAIN_TURNS:
        able = able.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int((1 << 30) * TRAIN_TURNS / n))

    def count(batches):
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for role, last, text in zip(batch.column("role").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist(), strict=True):
                r = ROLES.index(role.lower())
                before = None if last is None else 2 * ROLES.index(last.lower()) + 1
                for k, x in enumerate(turn_lines(text)):
                    s = 2 * r + (k > 0)
                    for f, v in enumerate(x[:-1]):
                        if v >= 0:
                            totals[f, s, v] = totals.get((f, s, v), 0) + 1
                    key = (100, s, 0) if not k and before is None else (101, before if not k else 2 * r + (k > 1), s)
                    totals[key] = totals.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in totals], pa.int32()) for j in range(3)] + [pa.array(list(totals.values()), pa.int64())], names=["f", "s", "v", "n"])

    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "text", "role")
    rows = able.withColumn("last", F.lag("role").over(order)).select("role", "last", "text").mapInArrow(count, "f int, s int, v int, n long").groupBy("f", "s", "v").agg(F.sum("n").alias("n")).collect()
    start, step, emit = untrained()
    for f, s, v, n in rows:
        if f == 100:
            start[s] += n
        elif f == 101:
            step[s, v] += n
            if s % 2:  # a turn of one line ends as any other
                step[s - 1, v] += 0 if v == s else n
        else:
            emit[f][s, v] += n
    log = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Hmm(log(start), log(step), [log(e) for e in emit])


def viterbi(scores: np.ndarray, start: np.ndarray, step: np.ndarray, enter: int | None = None, leave: int | None = None) -> list[int]:
    """The best path; enter: the state before the first line, leave: the state of the last one, where they're known."""
    if not len(scores):
        return []
    best = (start if enter is None else step[enter]) + scores[0]
    back = np.zeros(scores.shape, dtype=np.int64)
    for k in range(1, len(scores)):
        through = best[:, None] + step
        back[k] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[k]
    path = [int(best.argmax()) if leave is None else leave]
    for k in range(len(scores) - 1, 0, -1):
        path.append(int(back[k, path[-1]]))
    return path[::-1]


def render(role: str, text: str) -> str:
    return OPEN.format(role) + text + CLOSE


def parse(transcript: str | None, model: Hmm) -> list[tuple[str, str]]:
    """(role, text) of the turns of a raw transcript; speaker markers are taken off, lines stay as they are."""
    if not transcript or not transcript.strip():
        return []
    lines = transcript.split("\n")
    rows = [line_features(x, -1 if not k else int(not lines[k - 1].strip())) for k, x in enumerate(lines)]
    for k, x in enumerate(rows):
        x[-1] = 1 if not k or x[0] > 0 else UNKNOWN
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, viterbi(model.scores(rows), model.start, model.step), strict=True):
        r, begins = STATES[s]
        if begins or not out:
            out.append((ROLES[r], [line[marker(line)[1] :]]))
        else:
            out[-1][1].append(line)
    return [(r, "\n".join(x).strip("\n")) for r, x in out]


def roles(conversations: DataFrame, model: Hmm | None = None) -> DataFrame:
    """Of each row: conv_id, turn, its position (from 0) in its conversation, the given and the recovered role, and the rendered turn."""
    ready(conversations.sparkSession)
    model = model or fit(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "text", "role")
    rows = conversations.selectExpr("CAST(conv_id AS long) AS conv_id", "CAST(turn AS long) AS turn", "role", "text").withColumn("position", F.row_number().over(order).cast("long") - 1)
    rows = rows.withColumn("seg", F.expr(f"position DIV {SEGMENT}"))
    long = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > SEGMENT)
    if not long.isEmpty():
        ends = _ends(rows.join(long.select(F.col("conv_id").alias("_long")), F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi"), model)
        ends = ends.withColumnsRenamed({"conv_id": "_c", "seg": "_s"})
        rows = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_s")), "left").drop("_c", "_s")
    else:
        rows = rows.withColumn("enter", F.lit(None).cast("int")).withColumn("leave", F.lit(None).cast("int"))
    columns = ["conv_id", "turn", "position", "role", "text", "seg", "enter", "leave"]
    out = "conv_id long, turn long, position long, role string, role_pred string, rendered string"

    def decode(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        texts = group.column("text").to_pylist()
        lines = [turn_lines(t) for t in texts]
        path = viterbi(model.scores([x for t in lines for x in t]), model.start, model.step, group.column("enter")[0].as_py(), group.column("leave")[0].as_py())
        first = np.cumsum([0, *map(len, lines)])[:-1]
        found = [ROLES[STATES[path[k]][0]] for k in first]
        turns = group.column("turn").to_pylist()
        for k in range(1, len(found)):  # rows that only their label tells apart
            if (turns[k], texts[k]) == (turns[k - 1], texts[k - 1]):
                found[k] = found[k - 1]
        clean = [(t or "")[marker((t or "").split("\n")[0])[1] :] for t in texts]
        return pa.table({"conv_id": group.column("conv_id"), "turn": group.column("turn"), "position": group.column("position"), "role": group.column("role"), "role_pred": pa.array(found, pa.string()), "rendered": pa.array([render(r, t) for r, t in zip(found, clean, strict=True)], pa.string())})

    return rows.select(*columns).groupBy("conv_id", "seg").applyInArrow(decode, out)


def _ends(rows: DataFrame, model: Hmm) -> DataFrame:
    """The entering and leaving states of each segment of the conversations that have more than one."""

    def matrix(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        scores = model.scores([x for t in group.column("text").to_pylist() for x in turn_lines(t)])
        best = model.step + scores[0]
        from_start = model.start + scores[0]
        for s in scores[1:]:
            best = (best[:, :, None] + model.step[None]).max(axis=1) + s
            from_start = (from_start[:, None] + model.step).max(axis=0) + s
        return pa.table({"conv_id": group.column("conv_id")[:1], "seg": group.column("seg")[:1], "m": pa.array([best.ravel().tolist()], pa.list_(pa.float64())), "v": pa.array([from_start.tolist()], pa.list_(pa.float64()))})

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("seg")
        m = [np.array(x).reshape(6, 6) for x in group.column("m").to_pylist()]
        best = [np.array(group.column("v")[0].as_py())]
        for x in m[1:]:
            best.append((best[-1][:, None] + x).max(axis=0))
        leave, enter = [int(best[-1].argmax())], []
        for k in range(len(m) - 1, 0, -1):
            enter.append(int((best[k - 1] + m[k][:, leave[-1]]).argmax()))
            leave.append(enter[-1])
        return pa.table({"conv_id": group.column("conv_id"), "seg": group.column("seg"), "enter": pa.array([None, *enter[::-1]], pa.int32()), "leave": pa.array(leave[::-1], pa.int32())})

    parts = rows.select("conv_id", "position", "text", "seg").groupBy("conv_id", "seg").applyInArrow(matrix, "conv_id long, seg long, m array<double>, v array<double>")
    return parts.groupBy("conv_id").applyInArrow(chain, "conv_id long, seg long, enter int, leave int")
