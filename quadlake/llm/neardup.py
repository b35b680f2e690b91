"""MinHash near-dedup: a chosen-path set similarity join, confirmed on full sets, and connected components.

Sets: the distinct SHINGLE-word shingles of a document (ASCII lower case), as 64-bit hashes; texts with fewer words are one shingle.
Documents with equal sets are one class, known by its cid: its smallest doc_id, or a hash of its set where another class has that one too; only
classes are joined. A class has a signature of COORDINATES minwise values.

Trees: a node picks coordinates by its own hash; a document goes to a child for each, named by the node, the coordinate and its minwise
value there. The first levels (by the number of classes) of TREES trees pick BRANCHES each and are taken at once. Nodes of at most LIMIT
classes are compared exhaustively by signature (a pair at the threshold stays under close() with a chance of some millionths); equal
nodes are compared once. The chance to miss a pair at the threshold, for 2 first levels and over the draw of the coordinates (missed()),
is 6e-6 at 85 % and 4e-5 at 80 %.

Confirmation: classes that look alike in a small node, and all of a large first node, are joined to clusters. A cluster whose sets fit
one task (CLUSTER_SHINGLES in all; classes times shingles at most CLUSTER_WORK) is confirmed there: all its pairs are counted
exactly. For larger clusters DEEP_TREES trees are grown, and nodes of over LIMIT classes go on, level by level, with picks() picks on
average: twice 85 % over the threshold, so a pair at the threshold goes on in 1.7 times as many nodes (missed after LEVELS more levels: 2e-8 at
85 %, 6e-7 at 80 %). Texts less alike leave the large nodes; where the rows of a cluster become more than all pairs of its blocks have
(a large group of very similar texts), those pairs are taken instead, which misses nothing. Nodes that LEVELS levels can't split are compared
in pairs of blocks too, so none is dropped. Each list's alike classes are confirmed in a task, and the confirmed links are joined
again. Links, labels and sets stay distributed; lineage is cut by tables in the shared folder. Rows are joined with their class, large first
nodes with their centre, and a component's hub with its links by spread(), so no task gets all rows of a key that many have. Texts are
shuffled for the classes to confirm and the few others that a Bloom filter of them (16 bits each, 1 << MOST_BITS in all at most) lets pass.
CLUSTER_WORK, CLUSTER_SHINGLES, LIMIT and LEVELS only choose the way; all ways confirm on full sets.

Defined results: null, empty and white-space-only texts have no shingles and are linked with nothing (component: themselves); a null
doc_id is linked with nothing and kept, its component null; each row is a document, so two texts of one doc_id are two, and the one may be kept
and the other not; equal rows are kept or dropped together; other columns, whatever their names, are ignored by groups() and kept by keep().
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, Work, bitmap, let, ready, spread

SHINGLE, PERCENT = 3, 85
COORDINATES, BRANCHES, TREES, DEEP_TREES, LIMIT, LEVELS, CLUSTER_WORK, CLUSTER_SHINGLES, MOST_BITS = 64, 2, 4, 8, 300, 12, 4_000_000_000, 4_000_000, 23
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
with np.errstate(over="ignore"):
    POWER = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, dtype=np.uint64))
    FACTOR = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)) | U(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes' numbers, each times the power of its place, then mixed."""
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ~SPACE[b], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    value = BYTE[b[inside[1:-1]]] * POWER[place & 4095]
    if sizes.max() > 4096:
        value *= mix((place >> 12).astype(np.uint64) + U(1)) | U(1)
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), dtype=np.uint64)
    for j in range(min(k, len(w))):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[j : j + n])
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 2048):
        part = ((h[at : at + 2048, None] * FACTOR) >> U(32)).min(axis=0).astype(np.uint32)
        out = np.minimum(out, part)
    return out


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_id (a hash that tells the texts of a doc_id apart), n_shingles, digest of the set and signature of every document."""
    ready(docs.sparkSession)

    def of(batches):
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "text_id", "n_shingles", "digest", "sig"],
            )

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "xxhash64(text) AS text_id", "text").mapInArrow(of, "doc_id long, text_id long, n_shingles long, digest binary, sig binary")


def classify(rows: DataFrame, work: Work) -> DataFrame:
    """The classes of documents: digest, cid, sig, n shingles, size, and the smallest of its documents (doc_id, text_id). cids are unique."""
    first = F.min(F.struct("doc_id", "text_id"))
    classes = work.put(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(first.alias("r"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("size")).select("digest", F.col("r.doc_id").alias("cid"), "sig", "n", "size", "r.doc_id", "r.text_id"))
    n, turn = classes.count(), 0
    while classes.select("cid").distinct().count() < n:  # ids with several texts
        turn += 1
        keeps = classes.groupBy("cid").agg(F.min("digest").alias("digest")).select("digest", F.lit(True).alias("_keeps"))
        new = F.when(F.col("_keeps"), F.col("cid")).otherwise(F.xxhash64("digest", F.lit(turn)))
        classes = work.put(classes.join(keeps, "digest", "left").withColumn("cid", new).drop("_keeps"))
    return classes


def children(keys: np.ndarray, sig: np.ndarray, branches: int = BRANCHES) -> np.ndarray:
    """The child nodes of each document's nodes; keys: documents x nodes."""
    out = []
    for j in range(branches):
        pick = mix(keys + U((j + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        c = (pick % U(COORDINATES)).astype(np.int64)
        out.append(mix((keys ^ pick) * U(0x9E3779B97F4A7C15) + (c.astype(np.uint64) << U(32)) + np.take_along_axis(sig, c, axis=1).astype(np.uint64)))
    return np.concatenate(out, axis=1)


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def picks(percent: int) -> float:
    """Picks of a node below the first levels."""
    return 2 * PERCENT / percent


def missed(percent: int, levels: int, trees: int, first: int = 2) -> float:
    """The chance that no node of the last level holds both of a pair at the threshold, over the draw of the coordinates."""
    p, rate, out = percent / 100, picks(percent), 0.0
    for k in range(COORDINATES + 1):
        x, gone = k / COORDINATES, 0.0
        for level in range(levels + first):
            n = rate if level < levels else float(BRANCHES)
            one = 1 - x + x * gone
            gone = one ** int(n) * (1 - (n - int(n)) * (1 - one))
        out += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) * gone**trees
    return out


def below(keys: np.ndarray, sig: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes one level below each row's node, and the rows they are of: rate picks on average, the last one as the node's hash says."""
    whole, part = int(rate), rate - int(rate)
    nodes = children(keys[:, None], sig, whole + (part > 0))
    row = np.tile(np.arange(len(keys)), nodes.shape[1])
    nodes = nodes.T.ravel()
    if part > 0:
        go = np.concatenate((np.ones(whole * len(keys), dtype=bool), mix(keys ^ U(0x5851F42D4C957F2D)) < U(int(part * (1 << 64)))))
        nodes, row = nodes[go], row[go]
    return nodes, row


def _sprout(rows: DataFrame, rate: float) -> DataFrame:
    """(node, cid) one level below rows (node, cid, sig)."""

    def of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, row = below(batch.column("node").to_numpy().view(np.uint64), _signatures(batch), rate)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(batch.column("cid").to_numpy()[row])], names=["node", "cid"])

    return rows.select("cid", "sig", "node").mapInArrow(of, "node long, cid long")


def _grow(rows: DataFrame, levels: int, trees: int = TREES) -> DataFrame:
    """(node, cid) some levels below the roots of the trees; rows: cid, sig."""

    def of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, cid = _signatures(batch), batch.column("cid").to_numpy()
            keys = np.tile(mix(np.arange(1, trees + 1, dtype=np.uint64)), (len(cid), 1))
            for _ in range(levels):
                keys = children(keys, sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(cid, keys.shape[1]))], names=["node", "cid"])

    return rows.select("cid", "sig").mapInArrow(of, "node long, cid long")


def close(percent: int) -> int:
    """Equal coordinates that a pair at the threshold has but for a chance of some millionths: 4.6 standard deviations below the mean."""
    p = percent / 100
    return int(COORDINATES * p - 4.6 * math.sqrt(COORDINATES * p * (1 - p)))


def _alike(sig: np.ndarray, least: int) -> np.ndarray:
    """Pairs (i < j) with at least so many equal coordinates, row by row."""
    out = []
    for i in range(len(sig) - 1):
        j = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= least)
        if len(j):
            out.append(np.stack([np.full(len(j), i), j + i + 1], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _roots(n: int, pairs) -> list[int]:
    """Of 0 to n - 1 the smallest that the pairs join each with."""
    up = list(range(n))
    for i, j in pairs:
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[max(i, j)] = min(i, j)
    for i in range(n):
        up[i] = up[up[i]]
    return up


def _groups(members: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The alike classes of each list of members: arrays of cids, one for each group of at least two."""
    rows = members.withColumn("id", F.xxhash64("members")).select("id", F.explode("members").alias("cid")).join(classes.select("cid", "sig"), "cid").groupBy("id").agg(F.collect_list(F.struct("cid", "sig")).alias("x"))

    def of(batches):
        for batch in batches:
            found = []
            for x in batch.column("x"):
                cid = np.array([y["cid"].as_py() for y in x])
                order = np.argsort(cid)
                sig = np.frombuffer(b"".join(y["sig"].as_py() for y in x), dtype=np.uint32).reshape(-1, COORDINATES)[order]
                cid, by = cid[order], {}
                for k, r in enumerate(_roots(len(cid), _alike(sig, least).tolist())):
                    by.setdefault(r, []).append(int(cid[k]))
                found += [g for g in by.values() if len(g) > 1]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["members"])

    return rows.select("x").mapInArrow(of, "members array<long>").distinct()


def _small(level: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """The distinct member lists of the nodes with at most LIMIT classes; hot nodes leave before the shuffle."""
    hot = sizes.filter((F.col("n") * HOT > total) & (F.col("n") > LIMIT)).select("node")
    rows = level.join(F.broadcast(hot), "node", "left_anti").join(sizes.filter(F.col("n") <= LIMIT).select("node"), "node")
    return rows.groupBy("node").agg(F.sort_array(F.collect_set("cid")).alias("members")).filter(F.size("members") > 1).select("members").distinct()


def _sizes(level: DataFrame) -> DataFrame:
    return level.groupBy("node").agg(F.count("*").alias("n"), F.min("cid").alias("v")).filter("n > 1")


def _large(level: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """The rows of the nodes with over LIMIT classes, with the node's smallest cid as v."""
    return spread(level, sizes.filter(F.col("n") > LIMIT).select("node", "v", F.col("n").alias("_n")), ["node"], total)


def descend(level: DataFrame, classes: DataFrame, clusters: DataFrame, work: Work, least: int, percent: int) -> DataFrame:
    """Alike groups from the nodes of large clusters (cid, root, c classes): level by level, till nodes are small; what LEVELS more levels
    can't split goes by pairs of blocks, and a cluster with more rows than all pairs of its blocks have goes by those."""
    sizes, total = work.put(_sizes(level)), level.count()
    lists = _small(level, sizes, total)
    level = _large(level, sizes, total).drop("v")
    for step in range(LEVELS + 1):
        level = work.put(level.distinct().join(clusters, "cid"))
        wide = work.put(level.groupBy("root").agg(F.count("*").alias("rows"), F.first("c").alias("c")).filter(F.col("rows") > F.col("c") * F.col("c") / (LIMIT // 4)).select("root"))
        lists = lists.unionByName(_blocks(clusters.join(wide, "root").select(F.col("root").alias("node"), "cid")))
        level = level.join(wide, "root", "left_anti").select("node", "cid")
        if step == LEVELS:
            lists = lists.unionByName(_blocks(level))
        elif level.isEmpty():
            break
        else:
            level = work.put(_sprout(level.join(classes, "cid"), picks(percent)))
            sizes, total = work.put(_sizes(level)), level.count()
            lists = lists.unionByName(_small(level, sizes, total))
            level = _large(level, sizes, total).drop("v")
    return work.put(_groups(lists.distinct(), classes, least))


def _blocks(rows: DataFrame) -> DataFrame:
    """Every pair of blocks of a node's classes as a list: what is left of nodes that don't split."""
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / (LIMIT // 4)).cast("int").alias("b"))
    dealt = rows.join(sizes, "node").withColumn("k", F.pmod(F.xxhash64("cid", "node"), F.col("b")).cast("int"))
    pairs = dealt.select("node", "cid", F.explode(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.least(F.col("k"), j).alias("i"), F.greatest(F.col("k"), j).alias("j")))).alias("p"))
    return pairs.groupBy("node", "p").agg(F.sort_array(F.collect_set("cid")).alias("members")).filter(F.size("members") > 1).select("members")


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(cid, root) of all ends of edges (u, v): alternating large and small stars, till nothing changes."""
    pairs = work.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state, total = None, pairs.count()
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.put(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("_n")))
        large = work.put(spread(both.filter("v > u"), least, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        work.drop(least)
        least = work.put(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")))
        small = spread(large, least, ["u"], total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = work.put(small)
        work.drop(pairs), work.drop(large), work.drop(least)
        pairs = new
        now = tuple(pairs.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state, total = now, now[0]
    return pairs.select(F.col("u").alias("cid"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("cid"), F.col("v").alias("root"))).distinct()


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """All pairs (i < j) with 100 * intersection >= percent * union, counted exactly through the shingles they share."""
    sizes = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.empty(0, dtype=bool)
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:], [len(flat)])) if len(starts) else starts
    group = np.cumsum(new) - 1
    mine = np.argsort(owner, kind="stable")
    group, bounds = group[mine], np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(len(sets)):
        shared = np.zeros(len(sets), dtype=np.int64)
        g = group[bounds[i] : bounds[i + 1]]
        for at in range(0, len(g), 4096):
            s, n = starts[g[at : at + 4096]], (ends - starts)[g[at : at + 4096]]
            where = np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            shared += np.bincount(owner[where], minlength=len(sets))
        near = np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared))
        out += [(i, int(j)) for j in near if j > i]
    return out


def _confirm(rows: DataFrame, key: str, k: int, percent: int) -> DataFrame:
    """Links (u, v) that join what is linked within each group of rows (key, cid, text): a star for each component."""

    def of(group: pa.Table) -> pa.Table:
        cid = group.column("cid").to_numpy()
        order = np.argsort(cid)
        texts = group.column("text")
        roots = _roots(len(cid), linked([shingles(texts[int(j)].as_py(), k) for j in order], percent))
        pairs = [(int(cid[order[i]]), int(cid[order[r]])) for i, r in enumerate(roots) if i != r]
        return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

    return rows.select(key, "cid", "text").groupBy(key).applyInArrow(of, "u long, v long").distinct()


def _likely(docs: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, text_id and text of all rows that near (doc_id, text_id) names, and of few others: the rest leaves before the shuffle."""
    id_ = F.xxhash64("doc_id", "text_id")
    likely = bitmap(near.select(id_.alias("h")), 16, MOST_BITS)(lambda seen: let(id_, seen))
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "xxhash64(text) AS text_id", "text").filter(likely)


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id and kept of every document."""
    ready(docs.sparkSession)
    work = Work(docs.sparkSession, "neardup")
    rows = work.put(sketches(docs, k))
    classes = classify(rows, work)
    keyed, least = classes.select("cid", "sig"), close(percent)
    n = classes.count()
    first = min(10, max(2, round(math.log(max(n, 2)) / math.log(60))))
    level = work.put(_grow(keyed, first))
    sizes, total = work.put(_sizes(level)), level.count()
    lists = work.put(_groups(_small(level, sizes, total), keyed, least))
    stars = _large(level, sizes, total).select(F.col("cid").alias("u"), "v")
    near = work.put(components(lists.select(F.explode("members").alias("u"), F.col("members")[0].alias("v")).unionByName(stars), work))
    work.drop(level), work.drop(sizes)
    near = near.join(classes.select("cid", "n", "doc_id", "text_id"), "cid")
    load = near.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    load = work.put(load.select("root", "c", ((F.col("c") * F.col("s") > CLUSTER_WORK) | (F.col("s") > CLUSTER_SHINGLES)).alias("large"), F.col("c").alias("_n")))
    near = work.put(spread(work.put(near), load, ["root"], n))
    found = _likely(docs, near).join(near, ["doc_id", "text_id"]).select("root", "c", "large", "cid", "text")
    texts = work.put(found.dropDuplicates(["cid"]))
    links = _confirm(texts.filter("NOT large"), "root", k, percent)
    huge = texts.filter("large")
    if not huge.isEmpty():
        clusters = huge.select("cid", "root", "c")
        roots = work.put(_grow(keyed.join(clusters.select("cid"), "cid"), first, DEEP_TREES))
        deep = lists.unionByName(descend(roots, keyed, clusters, work, least, percent)).distinct()
        parts = deep.withColumn("id", F.xxhash64("members")).select("id", F.explode("members").alias("cid")).join(huge.select("cid", "text"), "cid")
        links = links.unionByName(components(_confirm(parts, "id", k, percent), work).filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    links = work.put(links.select(F.col("u").alias("cid"), F.col("v").alias("root")))
    work.drop(texts)
    named = work.put(classes.join(links, "cid", "left").select("digest", "doc_id", F.coalesce("root", "cid").alias("root"), "size"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("c"), F.count("*").alias("_n"))  # cids aren't ids of documents everywhere
    named = work.put(spread(named, work.put(smallest), ["root"], n).select("digest", "c", F.col("size").alias("_n")))
    able = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    slim = rows.select("doc_id", "text_id", "n_shingles", "digest")
    own = spread(slim.filter(able), named, ["digest"], rows.count()).select("doc_id", "text_id", "n_shingles", F.col("c").alias("component_id"))
    out = own.unionByName(slim.filter(~F.coalesce(able, F.lit(False))).select("doc_id", "text_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _labelled(docs, k, percent).drop("text_id")


def keep(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all columns; a document is a doc_id with its text."""
    gone = _labelled(docs, k, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_id").alias("_gone_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"]), "left_anti")
