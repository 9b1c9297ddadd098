"""N-gram Jaccard join: a MinHash LSH forest finds candidates, the shingles that their texts share are counted exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom, textvec
from .common import carried, checkpoint, chunk_pairs, of_caller, released, short_batches, small, table
from .graph import components, forest

#: Prefix trees; minhashes that a tree has to itself; places of the sequence that a tree is sorted by, which goes on with other trees' minhashes.
TREES, OWN, LONGEST = 25, 5, 12
#: Share of the links at the threshold that the trees are meant to find.
TARGET = 0.9999
#: Standard deviations that a signature's estimate may lie under the threshold and still be verified.
SLACK = 5.0
#: Documents of one prefix, documents and bytes of one cluster, and bytes of clusters that a task holds at once.
TOGETHER, CLUSTER, BYTES = 4_096, 512, 1 << 23
#: Entries of an incidence matrix at a time.
MATRIX = 1 << 22
#: Rows of a block of signatures that are compared at once.
ROWS = 64


def trees_for(threshold: float, target: float, depth: int) -> int:
    """Trees in which two texts at the threshold must be held against each other by prefixes of ``depth`` minhashes to be found with the target probability."""
    return max(1, math.ceil(math.log(1 - target) / math.log1p(-(threshold**depth))))


def depths(threshold: float, target: float) -> tuple[int, int]:
    """The shortest prefix and the longest one that a document may stop at: with the longest in all trees the target is met just so, with shorter ones in fewer."""
    longest = max((d for d in range(1, OWN + 1) if trees_for(threshold, target, d) <= TREES), default=0)
    if not longest:
        raise ValueError(f"{TREES} trees cannot find links at {threshold} with probability {target}")
    return max(1, longest - 2), longest


def shingles(chunk: textvec.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle and the chunk's text that it is of (ascending). A text of fewer words is one shingle."""
    h, n = chunk.hashes, np.diff(chunk.first)
    doc = chunk.doc_of()
    out = textvec.windows(h, width)
    inside = doc[width - 1 :] == doc[: len(out)]
    out, of = out[inside], doc[: len(inside)][inside]
    for few in range(1, width):
        short = np.flatnonzero(n == few)
        if len(short):
            out = np.concatenate((out, textvec.windows(h, few)[chunk.first[short]]))
            of = np.concatenate((of, short))
    order = np.argsort(of, kind="stable")
    return out[order], of[order]


def signatures(chunk: textvec.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with any word, and 16 bits of each of their minhashes."""
    h, of = shingles(chunk, width)
    at, first = np.unique(of, return_index=True)
    out = np.zeros((len(at), TREES * OWN), "<u2")
    if len(at):
        h = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
        draw = np.random.default_rng(23).integers(0, 1 << 32, (TREES * OWN, 2), dtype=np.uint32) | np.uint32(1)
        for i, (a, b) in enumerate(draw):
            x = (h ^ b) * a
            least = np.minimum.reduceat(x ^ (x >> np.uint32(15)), first)
            out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return at, out


def sequence(sketch: np.ndarray, tree: int) -> np.ndarray:
    """The minhashes that a tree is sorted by."""
    return sketch[:, (tree * OWN + np.arange(LONGEST)) % (TREES * OWN)]


def exact_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) without repeats, shingles numbered by their very words: words are told apart by themselves and runs by the numbers of their halves, so nothing rests on a hash."""
    names: dict[bytes, int] = {}
    parts = [t.split() for t in texts]
    n = np.array([len(p) for p in parts])
    word = np.fromiter((names.setdefault(w, len(names)) for p in parts for w in p), np.int64, int(n.sum()))
    doc, first = np.repeat(np.arange(len(texts)), n), np.concatenate(([0], np.cumsum(n)))
    ofs, runs, base = [], [], 0
    for size in sorted({min(width, int(k)) for k in n if k}):
        ids, have = word, 1
        while have < size:
            step = min(have, size - have)
            ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
            have += step
        at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1])
        at = at[n[doc[at]] >= width] if size == width else first[:-1][n == size]
        ofs.append(doc[at])
        runs.append(ids[at] + base)
        base += int(ids.max()) + 1
    of, run = np.concatenate(ofs), np.concatenate(runs)
    both = np.unique(of * base + run)
    return both // base, both % base


def alike(sketch: np.ndarray, tree: int, least: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows that agree in ``least`` places or more; with ``fresh`` only pairs of a row with it and one without matter.

    Rows are sorted as the tree's leaves are, and neighbours, whose common prefix is the longest, are joined first. Prefixes are then shortened up to the root that these rows share: a pair in different parts of the forest has one end outside the largest, so only those rows are still held against all.
    """
    order = np.lexsort(sequence(sketch, tree).T[::-1])
    sketch, fresh = sketch[order], None if fresh is None else fresh[order]
    p, q = spanning(sketch, least, fresh)
    return order[p], order[q]


def spanning(sketch: np.ndarray, least: int, fresh: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    n = len(sketch)
    close = (sketch[1:] == sketch[:-1]).sum(1) >= least
    if fresh is not None:
        close &= fresh[1:] != fresh[:-1]
    a, b = np.flatnonzero(close).tolist(), (np.flatnonzero(close) + 1).tolist()
    root = np.concatenate(([0], np.cumsum(~close)))
    root, looked = np.unique(root, return_index=True)[1][root], np.zeros(n, bool)
    while True:
        counts = np.bincount(root, minlength=n)
        rest = np.flatnonzero((root != counts.argmax()) & ~looked)
        if not len(rest):
            break
        i = rest[0]
        looked[i] = True
        hits = (sketch == sketch[i]).sum(1) >= least
        if fresh is not None:
            hits &= fresh != fresh[i]
        hits[i] = False
        at = np.flatnonzero(hits & (root != root[i]))
        if len(at):
            names, first = np.unique(root[at], return_index=True)
            a += [i] * len(first)
            b += at[first].tolist()
            low = min(int(names[0]), int(root[i]))
            root[np.isin(root, np.append(names, root[i]))] = low
    return np.array(a, np.int64), np.array(b, np.int64)


def shared(of: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of ``n`` texts share, from (text, shingle) entries without repeats, by products of incidence matrices."""
    _, which, counts = np.unique(which, return_inverse=True, return_counts=True)
    common = counts[which] > 1
    of, which = of[common], which[common]
    _, which = np.unique(which, return_inverse=True)
    order = np.argsort(which, kind="stable")
    of, which = of[order], which[order]
    out, step = np.zeros((n, n), np.int64), max(256, MATRIX // n)
    total = int(which[-1]) + 1 if len(which) else 0
    for lo in range(0, total, step):
        p, q = np.searchsorted(which, (lo, lo + step))
        m = np.zeros((n, min(step, total - lo)), np.float32)
        m[of[p:q], which[p:q] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def partners(sketch: np.ndarray, least: int, chunk: np.ndarray | None = None) -> np.ndarray:
    """Which rows agree with another one (of another chunk, if there are two) in ``least`` places or more."""
    out = np.zeros(len(sketch), bool)
    for lo in range(0, len(sketch), ROWS):
        part = np.zeros((min(ROWS, len(sketch) - lo), len(sketch)), np.int16)
        for place in sketch.T:
            part += place[lo : lo + ROWS, None] == place[None, :]
        hits = part >= least
        hits[np.arange(len(hits)), lo + np.arange(len(hits))] = False
        if chunk is not None:
            hits &= chunk[lo : lo + ROWS, None] != chunk[None, :]
        out[lo : lo + ROWS] |= hits.any(1)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group begins (and the end), of rows that come sorted by ``keys``; the last group of a batch waits for the next batch."""

    def cuts(t: pa.Table) -> np.ndarray:
        columns = [t[n].to_numpy() for n in keys]
        return np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [t.num_rows]))

    wait = None
    for batch in batches:
        wait = pa.concat_tables([*([wait] if wait else []), pa.Table.from_batches([batch])])
        at = cuts(wait)
        if len(at) > 2:
            yield wait.slice(0, int(at[-2])), at[:-1]
            wait = wait.slice(int(at[-2])).combine_chunks()
    if wait and wait.num_rows:
        yield wait, cuts(wait)


def sketches(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(t.num_rows, -1)


def prefix_groups(nodes: DataFrame, threshold: float, target: float) -> DataFrame:
    """(prefix, t, chunks, member): the nodes under each root of the trees' tries.

    A root is the shortest prefix, by trie node, under which at most ``TOGETHER`` nodes stand; where even the longest prefix that the target allows has more, these are dealt out as chunks. Nodes with short prefixes meet the target in few trees and stand in no others; only those of crowded prefixes go on to all trees.
    """
    shortest, longest = depths(threshold, target)
    few, span = min(TREES, trees_for(threshold, target, shortest)), range(shortest, longest + 1)
    prefix = [F.xxhash64("t", F.lit(d), F.expr(f"substring(sig, t * {2 * OWN} + 1, {2 * d})")) for d in span]

    def places(of: DataFrame, lo: int, hi: int) -> DataFrame:
        return of.select(F.col("node").alias("member"), "sig", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("t")).select("member", "t", F.array(*prefix).alias("path"))

    def at_level(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = rows.withColumn("prefix", F.col("path")[k])
        shared = checkpoint(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        crowded = (F.col("n") > TOGETHER) & F.lit(k + 1 < len(span))
        found = rows.join(shared.filter(~crowded).select("prefix", F.ceil(F.col("n") / TOGETHER).cast("int").alias("chunks")), "prefix")
        return rows, found.select("prefix", "t", "chunks", "member"), shared.filter(crowded).select("prefix")

    first = places(nodes, 0, few)
    rows, found, crowded = at_level(first, 0)
    if crowded.limit(1).count():
        # In the other trees they stand beside one another only: a pair with one end elsewhere is met in the first ones.
        pressed = rows.join(small(checkpoint(crowded), 100_000), "prefix", "left_semi").select(F.col("member").alias("node")).distinct()
        rest = places(nodes.join(checkpoint(pressed), "node", "left_semi"), few, TREES) if few < TREES else None
        rows = first if rest is None else first.unionByName(rest)
        rows, found, crowded = at_level(rows, 0)
        for k in range(1, len(span)):
            rows, more, crowded_next = at_level(rows.join(small(checkpoint(crowded), 100_000), "prefix", "left_semi").drop("prefix"), k)
            found, crowded = found.unionByName(more), crowded_next
    return found


def near_texts(docs: DataFrame, threshold: float = 0.8, width: int = 5, target: float = TARGET, slack: float | None = SLACK) -> DataFrame:
    """``docs`` with ``n_links`` (other rows whose text is near), ``component_id`` (smallest doc_id reachable by links) and ``kept`` (this row is the one of its component that stays).

    Texts are near if the sets of their shingles of ``width`` words, as they are, have a Jaccard coefficient of ``threshold`` or more; a text of fewer words is one shingle of its own. Null and empty texts are near nothing: no links, their own doc_id, kept. A row without doc_id counts as one with the smallest number. Rows that repeat are linked; of a component's rows one is kept, of those with the smallest doc_id one text, and of rows that repeat both one. Texts may be of any length. An empty table gives no rows. Columns of ``docs`` with the names added are replaced; other names are free.

    Equal texts are one node. Nodes under one root of a trie whose signatures agree nearly enough are joined, and so form clusters; in these the nodes that have a partner by signature are verified by their words, and only counts and spanning trees leave a task. Groups and clusters of any size are dealt out as pairs of chunks. ``slack`` is how many standard deviations a signature may lie under the threshold to be verified; with None all pairs under a root are.
    """
    spark, rows = docs.sparkSession, carried(docs, ("n_links", "component_id", "kept"))
    full = F.col("in_text")
    rows = rows.withColumns({"own_node": F.xxhash64(F.sha2(full, 256)), "own_id": F.coalesce("in_doc_id", F.lit(-(1 << 63)))})
    raw = full.cast("binary").alias("text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in textvec.chunks(batch["text"].to_pylist()):
                at, sig = signatures(c, width)
                if len(at):
                    own = batch.take(pa.array(c.at + at))
                    size = pa.array([len(c.texts[i]) for i in at], pa.int64())
                    yield pa.RecordBatch.from_arrays([own["own_node"], own["own_id"], size, pa.array([s.tobytes() for s in sig], pa.binary())], ["node", "id", "size", "sig"])

    with short_batches(spark):
        signed = rows.select("own_node", "own_id", raw).mapInArrow(sign, "node long, id long, size long, sig binary")
        nodes = checkpoint(signed.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")))

    places = TREES * OWN
    least = 0 if slack is None else max(0, math.floor(places * threshold - slack * math.sqrt(places * threshold * (1 - threshold))))
    members = chunk_pairs(prefix_groups(nodes, threshold, target), "member")
    dealt = members.join(nodes.select(F.col("node").alias("member"), "sig"), "member")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in grouped(batches, ["prefix", "a", "b"]):
            member, chunk, a, b, tree = (t[n].to_numpy() for n in ("member", "chunk", "a", "b", "t"))
            sketch, out = sketches(t), []
            two = cuts[:-1][np.diff(cuts) == 2]
            two = two[((a[two] == b[two]) | (chunk[two] != chunk[two + 1])) & ((sketch[two] == sketch[two + 1]).sum(1) >= least)]
            out.append((member[two], member[two + 1]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 2:
                    p, q = alike(sketch[lo:hi], int(tree[lo]), least, chunk[lo:hi] if a[lo] != b[lo] else None)
                    out.append((member[lo + p], member[lo + q]))
            p, q = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    keys = ["prefix", "a", "b"]
    laid = dealt.select(*keys, "t", "chunk", "member", "sig").repartition(*keys).sortWithinPartitions(*keys, "member")
    clusters = components(laid.mapInArrow(candidates, "a long, b long"))

    # Within a cluster, pairs of chunks are looked through by signature: only texts with a partner there go on.
    cluster = checkpoint(clusters.join(nodes.select("node", "id", "size", "copies", "sig"), "node"))
    sizes = cluster.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER), F.ceil(F.sum("size") / BYTES)).cast("int").alias("chunks"))
    keys = ["component", "a", "b"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in grouped(batches, keys):
            chunk, a, b = (t[n].to_numpy() for n in ("chunk", "a", "b"))
            sketch, keep = sketches(t), np.zeros(t.num_rows, bool)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                keep[lo:hi] = partners(sketch[lo:hi], least, chunk[lo:hi] if a[lo] != b[lo] else None) if hi - lo > 2 else hi - lo == 2
            yield from t.filter(pa.array(keep)).select(names).to_batches()

    names = ["node", "id", "size", "copies", "component", "chunk", "a", "b"]
    looked = chunk_pairs(cluster.join(sizes, "component"), "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    wanted = checkpoint(looked.select(*names, "sig").mapInArrow(look, "node long, id long, size long, copies long, component long, chunk int, a int, b int"))
    total = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    bits = bloom.bits_for(total["n"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bloom.gathered((textvec.mix(batch["node"].to_numpy().view(np.uint64)) for batch in batches), bits, 2)

    in_use = spark.sparkContext.broadcast(bloom.build(wanted.select("node").mapInArrow(seen, bloom.BLOBS), bits)[0])

    @F.pandas_udf("boolean")
    def in_cluster(node: pd.Series) -> pd.Series:
        return pd.Series(bloom.contains(in_use.value, textvec.mix(node.to_numpy().view(np.uint64)), 2))

    texts = rows.select("own_node", "own_id", raw).filter(in_cluster("own_node"))
    texts = texts.join(wanted, (F.col("own_node") == F.col("node")) & (F.col("own_id") == F.col("id"))).select(*(n for n in names if n not in ("id", "size")), "text")
    buckets = max(1, total["bytes"] // (2 * BYTES))
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by([*((k, "ascending") for k in keys), ("node", "ascending")])
        node, copies, chunk, component, a, b = (t[n].to_numpy() for n in ("node", "copies", "chunk", *keys))
        new = np.concatenate(([True], (component[1:] != component[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        # Rows that repeat doc_id and text.
        once = np.flatnonzero(new | np.concatenate(([True], node[1:] != node[:-1])))
        texts = t["text"].take(pa.array(once)).to_pylist()
        new, node, copies, chunk, a, b = (x[once] for x in (new, node, copies, chunk, a, b))
        cuts = np.concatenate((np.flatnonzero(new), [len(node)]))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = hi - lo
            if n < 2:
                continue
            of, which = exact_shingles(texts[lo:hi], width)
            inter, size = shared(of, which, n), np.bincount(of, minlength=n)
            near = inter / np.maximum(size[:, None] + size[None, :] - inter, 1) >= threshold
            np.fill_diagonal(near, False)
            if a[lo] != b[lo]:
                near &= chunk[lo:hi, None] != chunk[None, lo:hi]
            links = near @ copies[lo:hi]
            p, q = np.nonzero(np.triu(near))
            root, some = forest(n, p, q), links > 0
            out.append((node[lo:hi][some], node[lo:hi][root[some]], links[some]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, names=["a", "b", "n"])

    with short_batches(spark):
        found = checkpoint(texts.groupBy("bucket").applyInArrow(verify, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    joined = nodes.select("node", "id", "copies").join(links, "node", "left").join(components(found.select("a", "b")), "node", "left")
    joined = checkpoint(joined.withColumn("component", F.coalesce("component", "node")))
    first = joined.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first"))
    plain = joined.filter("linked is null").select("node", F.col("id").alias("least"), F.col("node").alias("keeper"), (F.col("copies") - 1).alias("n"))
    near = joined.filter("linked is not null").join(first, "component").select("node", F.col("first.id").alias("least"), F.col("first.node").alias("keeper"), (F.col("copies") - 1 + F.col("linked")).alias("n"))
    # Most nodes have no company; their own id says it all, so only the others are looked up.
    told = small(checkpoint(near.unionByName(plain.filter("n > 0"))), 100_000)
    out = rows.join(told, F.col("own_node") == F.col("node"), "left")
    stays = F.col("node").isNull() | ((F.col("own_id") == F.col("least")) & (F.col("node") == F.col("keeper")))
    out = out.select(*of_caller(out), "own_node", "own_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "own_id").alias("component_id"), stays.alias("kept"))
    # Repeated rows are rare: only if there are any, one of each is chosen.
    repeats = rows.filter(F.length(full) > 0).groupBy(F.col("own_id").alias("i"), F.col("own_node").alias("m")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if repeats.limit(1).count():
        same = (F.col("own_id") == F.col("i")) & (F.col("own_node") == F.col("m"))
        nth = F.row_number().over(Window.partitionBy("own_id", "own_node").orderBy(F.xxhash64(*of_caller(out))))
        out = out.join(repeats, same, "left_anti").unionByName(out.join(repeats, same, "left_semi").withColumn("kept", F.col("kept") & (nth == 1)))
    return released(out, n_links=F.col("n_links"), component_id=F.col("component_id"), kept=F.col("kept"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_links, component_id, kept; cases as in ``near_texts``."""
    return near_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_links", "component_id", "kept")


#: The same rows by SQL, over all pairs of texts with a shingle in common.
ORACLE = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM word WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE pair.n / CAST(x.n + y.n - pair.n AS DOUBLE) >= 0.8
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT b, r FROM reach JOIN link ON a = reach.doc_id AND r < b
)
SELECT doc_id, (SELECT count(*) FROM link WHERE a = doc_id) AS n_links, min(r) AS component_id, min(r) = doc_id AS kept FROM reach GROUP BY doc_id
"""
