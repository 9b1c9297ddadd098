"""Embedding near-dedup with an inverted multi-index: two codebooks on vector halves make a grid of cells, a query visits its nearest cells, hits are verified exactly."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small, table
from .graph import components, forest
from .topk import whole

#: Codewords of each half grow with the square root of the vectors, between these; vectors that the codebooks are fitted on at most (those of the lowest hash); vectors of a tile in one task.
FEWEST, MOST, SAMPLE, CHUNK = 16, 1_024, 20_000, 4_096
#: Share of links that visits are meant to find, from one of their two ends; vectors whose links with all others it is measured on, links of theirs at least, and the steps of the measure.
TARGET, ASKED, ENOUGH, STEP = 0.997, 512, 200, 1 / 512


def squared(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codebook.T + (codebook * codebook).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from ``k`` of the given rows."""
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(5).permutation(len(centres))[:k]].copy()
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        for j in range(len(centres)):
            if (mine := own == j).any():
                centres[j] = x[mine].mean(0)
    # Along the direction in which they differ most, so that neighbours stand close to one another.
    _, _, axes = np.linalg.svd(centres - centres.mean(0), full_matrices=False)
    return centres[np.argsort(centres @ axes[0], kind="stable")] if len(centres) > 1 else centres


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def excesses(first: np.ndarray, second: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How much farther than its nearest cell (by the sum of squared distances in both halves) each row must look to come to the cell (u, v)."""
    at = np.arange(len(first))
    return first[at, u] + second[at, v] - first.min(1) - second.min(1)


def foreseen(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, target: float) -> float:
    """The excess that finds ``target`` of partners at the threshold from the rows of ``x``: partners in random directions of the whole space, and of the space that the rows themselves fill, whichever need more. For tables with too few links to measure on."""
    rng = np.random.default_rng(11)
    most = 0.0
    for noise in (rng.standard_normal(x.shape), rng.standard_normal((len(x), len(x))) @ x if len(x) <= SAMPLE // 5 else x[rng.permutation(len(x))] - x):
        noise -= (noise * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        y = threshold * x + np.sqrt(1 - threshold**2) * noise / np.where(length > 0, length, 1)
        (first, second), (u, v) = ([squared(h, b) for h, b in zip(halves(z), books, strict=True)] for z in (x, y))
        most = max(most, float(np.quantile(excesses(first, second, u.argmin(1), v.argmin(1)), target)))
    return most


def traverse(first: np.ndarray, second: np.ndarray, excess: float) -> tuple[np.ndarray, np.ndarray]:
    """What a multi-sequence traversal comes to for each row: cells (i, j) by rising sum of the two sequences of distances, until the sum is ``excess`` over the least. The cells come to are a staircase: for each i the second may lie as far as given here (nothing where that is below the nearest); with the row's bound. All rows are worked out at once, so no queue of cells is kept."""
    most = first.min(1) + second.min(1) + excess
    return most[:, None] - first, most


def tiles_of(first: np.ndarray, second: np.ndarray, excess: float, grid: int) -> list[np.ndarray]:
    """The tiles, blocks of neighbouring cells, that each row's traversal comes to."""
    reach, _ = traverse(first, second, excess)
    rows = np.arange(first.shape[1]) * grid // first.shape[1]
    columns = np.arange(second.shape[1]) * grid // second.shape[1]
    near = np.stack([second[:, columns == c].min(1, initial=np.inf) for c in range(grid)], 1) - 1e-9
    far = np.stack([reach[:, rows == r].max(1, initial=-np.inf) for r in range(grid)], 1)
    return [np.flatnonzero(x) for x in (far[:, :, None] >= near[:, None, :]).reshape(len(first), -1)]


def measured(vectors: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], asked: list, threshold: float) -> dict[tuple[int, int], int]:
    """How many links of the vectors ``asked`` (a bounded number of rows: dim, x, node, label) with all ``vectors`` need which excess, by length and step of it, looked for from the end that needs less: every row is compared with those asked."""
    by_dim = {d: [r for r in asked if r["dim"] == d] for d in books}
    probes = {d: (np.array([r["node"] for r in rs]), np.array([r["label"] for r in rs]), unit(np.array([r["x"] for r in rs], np.float64))) for d, rs in by_dim.items() if rs}
    shared = vectors.sparkSession.sparkContext.broadcast((books, probes))

    def count(batches):
        books, probes = shared.value
        found: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in set(dims.tolist()) & set(probes):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                y = unit(part["x"].flatten().to_numpy().reshape(part.num_rows, dim).astype(np.float64))
                node, label, x = probes[dim]
                # A probe's own row is no partner.
                links = (y @ x.T >= threshold) & (part["label"].to_numpy()[:, None] == label) & (part["node"].to_numpy()[:, None] != node)
                p, q = np.nonzero(links)
                if not len(p):
                    continue
                far = {k: [squared(h, b) for h, b in zip(halves(z), books[dim], strict=True)] for k, z in (("y", y), ("x", x))}
                cell = {k: [d.argmin(1) for d in ds] for k, ds in far.items()}
                there = excesses(*(d[p] for d in far["y"]), *(c[q] for c in cell["x"]))
                back = excesses(*(d[q] for d in far["x"]), *(c[p] for c in cell["y"]))
                found.update((dim, int(k)) for k in np.floor(np.minimum(there, back) / STEP))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int32()) for i in range(2)] + [pa.array(list(found.values()), pa.int64())], ["dim", "step", "n"])

    rows = vectors.select("dim", "x", "node", F.col("label").cast("long").alias("label")).mapInArrow(count, "dim int, step int, n long")
    return {(r["dim"], r["step"]): r["n"] for r in rows.groupBy("dim", "step").agg(F.sum("n").alias("n")).collect()}


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, target: float = TARGET) -> DataFrame:
    """One row for each of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels and a cosine of ``threshold`` or more, in double precision, are linked; a null vector or label, a zero vector, null or non-finite components, and vectors of another length link with nothing. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id reachable. Rows that repeat a vec_id count each; exact copies are collapsed before the search and counted by their number. Vectors may be of any length. An empty table gives no rows; other columns are ignored.

    The grid's cells are kept in tiles of neighbouring cells; a vector lies in its own cell's tile and visits the other tiles that its traversal comes to, once each. A pair is looked for from both ends and counted once; what is found is verified, so no link is below the threshold. How far a traversal goes is measured: by the links of ``ASKED`` vectors with all rows, so that ``target`` of these are come to; where they have fewer than ``ENOUGH`` links, by made-up partners (``foreseen``).
    """
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    wide = "<f4" if kind == "float" else "<f8"
    own = F.transform("embedding", lambda x: x.cast(kind))
    scaled = vectors.select("vec_id", "label", F.when(whole(F.col("embedding")), own).alias("x")).withColumn("top", F.array_max(F.transform("x", F.abs)))
    valid = F.col("label").isNotNull() & F.coalesce(F.col("top") > 0, F.lit(False))
    rows = checkpoint(scaled.withColumn("node", F.when(valid, F.xxhash64("label", "x"))).select("vec_id", "label", "node", F.when(valid, F.col("x")).alias("x")))
    distinct = rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("x"))
    distinct = checkpoint(distinct)
    sample = distinct.select("dim", "x", "node").orderBy(F.xxhash64("node", F.lit(3)), "node").limit(SAMPLE)
    total = distinct.count()
    codewords = int(min(MOST, max(FEWEST, 1 << (int(np.sqrt(total)) // 4).bit_length())))

    def learn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(frame.sort_values("node")["x"].to_list()).astype(np.float64))
        books = tuple(codebook(h, codewords) for h in halves(x))
        return pd.DataFrame({"dim": [key[0]], "first": [books[0].tobytes()], "second": [books[1].tobytes()], "k1": [len(books[0])], "k2": [len(books[1])], "excess": [foreseen(x[:4000], books, threshold, target)]})

    # One group a vector length, of a bounded sample; the books of the commonest lengths fit any driver.
    learnt = sample.groupBy("dim").applyInPandas(learn, "dim int, first binary, second binary, k1 int, k2 int, excess double").collect()
    books = {r["dim"]: (np.frombuffer(r["first"]).reshape(r["k1"], -1), np.frombuffer(r["second"]).reshape(r["k2"], -1)) for r in learnt}
    asked = distinct.select("dim", "x", "node", F.col("label").cast("long").alias("label")).orderBy(F.xxhash64("node", F.lit(9)), "node").limit(ASKED).collect()
    needed = measured(distinct, books, asked, threshold)
    excess = {}
    for r in learnt:
        steps = sorted((k, n) for (dim, k), n in needed.items() if dim == r["dim"])
        links = sum(n for _, n in steps)
        upto = np.cumsum([n for _, n in steps])
        excess[r["dim"]] = (steps[int(np.searchsorted(upto, target * links))][0] + 1) * STEP if links >= ENOUGH else r["excess"]
    shared = distinct.sparkSession.sparkContext.broadcast({d: (b, excess[d]) for d, b in books.items()})

    def model(dim: int) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        # A length that the sample lacks has a single cell.
        return shared.value.get(dim, ((np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))), 0.0))

    def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        books, excess = model(x.shape[1])
        return *(squared(h, b) for h, b in zip(halves(x), books, strict=True)), excess

    def encode(batches):
        for batch in batches:
            dims, grids = batch["dim"].to_numpy(), batch["grid"].to_numpy()
            for dim, grid in sorted(set(zip(dims.tolist(), grids.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((dims == dim) & (grids == grid))))
                x = part["x"].flatten().to_numpy().reshape(part.num_rows, dim)
                first, second, excess = distances(unit(x.astype(np.float64)))
                home = (first.argmin(1) * grid // first.shape[1]) * grid + second.argmin(1) * grid // second.shape[1]
                visits = [t[t != h].tolist() for t, h in zip(tiles_of(first, second, excess, grid), home, strict=True)]
                yield pa.RecordBatch.from_arrays([part["node"], part["label"], part["dim"], part["copies"], pa.array([v.astype(wide).tobytes() for v in x], pa.binary()), pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], ["node", "label", "dim", "copies", "x", "tile", "visits"])

    # As many tiles as a label's vectors fill.
    crowd = distinct.groupBy("label", "dim").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / CHUNK)).cast("int").alias("grid"))
    gridded = distinct.join(small(checkpoint(crowd), 100_000), ["label", "dim"]).withColumn("label", F.col("label").cast("long"))
    index = checkpoint(gridded.select("node", "label", "dim", "copies", "x", "grid").mapInArrow(encode, "node long, label long, dim int, copies long, x binary, tile int, visits array<int>"))
    keys, carry = ["label", "dim", "tile"], ["node", "copies", "x"]
    home = index.select(*keys, *carry, F.lit(True).alias("home"))
    asked = home.unionByName(index.select("label", "dim", F.explode("visits").alias("tile"), *carry, F.lit(False).alias("home")))
    # A full tile and its many visitors are dealt over pairs of chunks.
    parts = asked.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count_if("home") / CHUNK)).cast("int").alias("ni"), F.ceil(F.count(F.lit(1)) / (4 * CHUNK)).cast("int").alias("nq"), F.max("home").alias("full"))
    parts = parts.filter("full").drop("full")
    dealt = asked.join(small(checkpoint(parts), 100_000), keys).withColumns({"i": F.pmod(F.xxhash64("node"), F.col("ni")).cast("int"), "q": F.pmod(F.xxhash64("node", F.lit(1)), F.col("nq")).cast("int")})
    at_home = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda b: F.struct(F.col("i").alias("ic"), b.alias("qc"), F.lit(True).alias("is_index"), (b == F.col("q")).alias("is_query")))
    away = F.transform(F.filter(F.sequence(F.lit(0), F.col("ni") - 1), lambda a: ~F.col("home") | (a != F.col("i"))), lambda a: F.struct(a.alias("ic"), F.col("q").alias("qc"), F.lit(False).alias("is_index"), F.lit(True).alias("is_query")))
    laid = dealt.select(*keys, *carry, F.inline(F.when(F.col("home"), F.concat(at_home, away)).otherwise(away)))

    def verify(t: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        x = unit(np.frombuffer(b"".join(t["x"].to_pylist()), wide).reshape(len(node), -1).astype(np.float64))
        its, qs = (np.flatnonzero(t[n].to_numpy(zero_copy_only=False)) for n in ("is_index", "is_query"))
        if not len(its) or not len(qs):
            return none
        first, second, excess = distances(x)
        most = traverse(first, second, excess)[1]
        u, v, nearest = first.argmin(1), second.argmin(1), second.min(1)
        found = []
        for row in np.unique(u[its]):
            mine = its[u[its] == row]
            for lo in range(0, len(qs), CHUNK):
                comers = qs[lo : lo + CHUNK]
                comers = comers[first[comers, row] + nearest[comers] <= most[comers]]
                if not len(comers):
                    continue
                # Of the row's cells those within the query's reach are looked into.
                p, q = np.nonzero((first[comers, row][:, None] + second[np.ix_(comers, v[mine])] <= most[comers][:, None]) & (x[comers] @ x[mine].T >= threshold))
                p, q = comers[p], mine[q]
                # Seen from both ends, a pair counts from its larger node only.
                back = first[q, u[p]] + second[q, v[p]] <= most[q]
                keep = (node[p] > node[q]) | ((node[p] < node[q]) & ~back)
                found.append((p[keep], q[keep]))
        if not sum(len(p) for p, _ in found):
            return none
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        links = np.bincount(p, weights=copies[q], minlength=len(node)) + np.bincount(q, weights=copies[p], minlength=len(node))
        root, some = forest(len(node), p, q), links > 0
        return pa.table({"a": node[some], "b": node[root[some]], "n": links[some].astype(np.int64)})

    found = checkpoint(laid.groupBy(*keys, "ic", "qc").applyInArrow(verify, "a long, b long, n long"))
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    joined = components(found.select("a", "b")).join(linked, "node", "left")
    placed = rows.select("vec_id", "node").join(distinct.select("node", "copies"), "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.filter("node is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = placed.join(smallest, "component", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept; cases as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
