"""Embedding near-dedup by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, components, parts, table

#: Vectors that codebooks and the number of visited cells are fitted on at most; every vector is indexed.
SAMPLE = 20_000
#: Wanted vectors in a cell, codewords of a half at most, and vectors living in a cell that one task holds.
CELL, CODEWORDS, BLOCK = 192, 1024, 2048
#: Visitors of a cell compared in one task; those of a crowded cell are cut into parties.
GUESTS = 8192
RECALL, QUERIES = 0.995, 600
#: Vector lengths that have an index of their own, the commonest; vectors of another length are all compared, in blocks.
LENGTHS = 64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that squares stay finite."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (x.shape[1] + 1) // 2
    return x[:, :at], x[:, at:]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


class MultiIndex:
    """Codebooks of the two halves of vectors of one length; cells are their product."""

    def __init__(self, sample: np.ndarray, n: int, alike: float, recall: float = RECALL):
        x = unit(sample)
        k = max(1, min(CODEWORDS, len(x), int(np.ceil(np.sqrt(n / CELL)))))
        self.books = [k_means(h, k, i) for i, h in enumerate(halves(x))]
        self.k, self.visits = k, 1
        self.visits = self._fitted(x, alike, recall)

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each unit vector, nearest first, by the sum of both halves' squared distances.

        The multi-sequence order: a cell of the i-th and j-th nearest codewords has (i + 1)(j + 1) - 1 cells
        before it at least, so only those below the wanted number are ever in the queue.
        """
        visits = min(visits, self.k * self.k)
        d = [squared(h, c) for h, c in zip(halves(x), self.books, strict=True)]
        near = [y.argsort(1, kind="stable")[:, : min(self.k, visits)] for y in d]
        m = near[0].shape[1]
        i, j = (a.ravel() for a in np.meshgrid(np.arange(m), np.arange(m), indexing="ij"))
        some = (i + 1) * (j + 1) <= visits
        i, j = i[some], j[some]
        rows = np.arange(len(x))[:, None]
        cost = d[0][rows, near[0]][:, i] + d[1][rows, near[1]][:, j]
        best = cost.argsort(1, kind="stable")[:, :visits]
        return near[0][rows, i[best]] * self.k + near[1][rows, j[best]]

    def _fitted(self, x: np.ndarray, alike: float, recall: float) -> int:
        """Cells to visit so that of pairs at just the wanted cosine, of sampled vectors and random directions, the wanted share meets."""
        rng = np.random.default_rng(7)
        q = x[rng.choice(len(x), min(QUERIES, len(x)), replace=False)]
        noise = rng.standard_normal(q.shape)
        noise -= (noise * q).sum(1, keepdims=True) * q
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        y = np.where(size > 1e-12, alike * q + np.sqrt(1 - alike**2) * noise / np.maximum(size, 1e-12), q)
        visits = 1
        while visits < self.k * self.k:
            a, b = self.order(q, visits), self.order(y, visits)
            if ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= recall:
                return visits
            visits += max(1, visits // 4)
        return self.k * self.k


def _floats(column: pa.Array) -> list[np.ndarray]:
    flat, at = np.asarray(column.flatten(), np.float64), column.offsets.to_numpy()
    return [flat[a - at[0] : b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]


def classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, embedding, n): the distinct vectors that can link and how many rows have each; and (hash) of those hashes that unlike vectors share.

    A node is a hash of the components; vectors that share one are told apart by a second hash.
    """
    ok = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < double('infinity') AND NOT isnan(x)) AND exists(embedding, x -> x <> 0)")
    own = scratch.save(vectors.where(ok).groupBy(F.xxhash64("embedding").alias("hash"), "embedding").agg(F.count("*").alias("n")))
    clash = scratch.save(own.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash"))
    return with_nodes(own, clash).select("node", "embedding", "n"), clash


def with_nodes(df: DataFrame, clash: DataFrame) -> DataFrame:
    """df (hash, embedding, and any more) with node."""
    shared = clash.select("hash", F.lit(True).alias("shared"))
    return df.join(shared, "hash", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64(F.lit("again"), "embedding")).otherwise(F.col("hash"))).drop("shared")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links of a spanning forest of the bipartite graph."""
    rows, columns, out = near.any(1), near.any(0), []
    while rows.any():
        todo = [(int(rows.argmax()), True)]
        rows[todo[0][0]] = False
        while todo:
            x, is_row = todo.pop()
            new = np.flatnonzero(near[x] & columns if is_row else near[:, x] & rows)
            (columns if is_row else rows)[new] = False
            out += [(x, int(y)) if is_row else (int(y), x) for y in new]
            todo += [(int(y), not is_row) for y in new]
    return out


def _compare(alike: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Links from a block of a cell's visitors to a block of those that live there: counts, and spanning forests."""
        at_home = rows["home"].to_numpy()
        block, visitors = rows.filter(pa.array(at_home)).combine_chunks(), rows.filter(pa.array(~at_home)).combine_chunks()
        ids, counts, forest = [], [], []
        if len(block) and len(visitors):
            one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            h, h_id, h_n = unit(np.stack(_floats(one(block["embedding"])))), block["node"].to_numpy(), block["n"].to_numpy()
            h_visits = np.stack(_floats(one(block["visits"]))).T
            q_id, q_n, q_cell, every = visitors["node"].to_numpy(), visitors["n"].to_numpy(), visitors["own"].to_numpy(), _floats(one(visitors["embedding"]))
            back = np.zeros(len(h), np.int64)
            for i in range(0, len(every), BLOCK):
                s = slice(i, i + BLOCK)
                near = (unit(np.stack(every[s])) @ h.T >= alike) & (q_id[s, None] != h_id[None, :])
                ids.append(q_id[s])
                counts.append(near @ h_n)
                forest += [(int(q_id[i + x]), int(h_id[y])) for x, y in _forest(near)]
                for v in h_visits:  # where the other visits this one's cell, the way back is counted there
                    near &= v[None, :] != q_cell[s, None]
                back += q_n[s] @ near
            ids.append(h_id)
            counts.append(back)
        a, n = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (ids, counts))
        a, n = a[n > 0], n[n > 0]
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(a), pa.array([x for x, _ in forest], pa.int64())]), "b": pa.concat_arrays([none, pa.array([x for _, x in forest], pa.int64())]), "n": pa.concat_arrays([pa.array(n), pa.array([0] * len(forest), pa.int64())])})

    return run


def near_duplicates(vectors: DataFrame, alike: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Pairs found have a cosine of alike or more in double precision. Vectors that are null, empty, all zero, or hold null or
    non-finite components link with nothing, nor do vectors of unlike lengths. Rows of one vector are one class, whose
    rows link with each other; rows count apart even under one vec_id. A null vec_id is never a component's id unless
    no other is there, and is not kept.

    Every vector lives in one cell and visits the nearest, in multi-sequence order, as many as reach the wanted recall on the
    sample. A crowded cell is cut into blocks of BLOCK and its visitors into parties of GUESTS; every party meets every block.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    own, clash = classes(vectors, scratch)
    own = scratch.save(own.withColumn("size", F.size("embedding")))
    sizes = {r["size"]: r["c"] for r in own.groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "size").limit(LENGTHS).collect()}
    indexes = {}
    for r, n in sizes.items():
        few = own.where(F.col("size") == r).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
        indexes[r] = MultiIndex(np.stack(_floats(few["embedding"].combine_chunks())), n, alike, recall)
    held = spark.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            visits: list[list[int]] = [[0]] * len(b)
            x = _floats(b.column(1))
            for size in {len(v) for v in x} & held.value.keys():
                index, rows = held.value[size], [i for i, v in enumerate(x) if len(v) == size]
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    for i, cells in zip(some, index.order(unit(np.stack([x[i] for i in some])), index.visits).tolist(), strict=True):
                        visits[i] = cells
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v[0] for v in visits], pa.int64()), pa.array(visits, pa.list_(pa.int64()))], [*b.schema.names, "own", "visits"])

    kind = own.schema["embedding"].dataType.simpleString()
    placed = scratch.save(own.mapInArrow(place, f"node long, embedding {kind}, n long, size int, own long, visits array<long>"))
    guests = placed.select("size", F.explode("visits").alias("cell"), "node", "embedding", "n", "own", F.expr("CAST(array() AS array<bigint>)").alias("visits"), F.lit(False).alias("home"))
    homes = placed.select("size", F.col("own").alias("cell"), "node", "embedding", "n", "own", "visits", F.lit(True).alias("home"))
    both = homes.unionByName(guests)
    crowd = both.groupBy("size", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("home")) / GUESTS).cast("int").alias("parties"))
    crowd = scratch.save(crowd.where("blocks > 1 or parties > 1"))
    both = both.join(crowd, ["size", "cell"], "left").withColumns({x: F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) for x in ("blocks", "parties")})
    dealt = lambda n, mine, seed: F.when(mine, F.array(F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    both = both.withColumn("block", F.explode(dealt("blocks", F.col("home"), 0))).withColumn("party", F.explode(dealt("parties", ~F.col("home"), 1)))
    found = scratch.save(both.groupBy("size", "cell", "block", "party").applyInArrow(_compare(alike), "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    label = components(found.where("b is not null").select("a", "b"), scratch)
    of = own.select("node", F.col("n").alias("alike")).join(counts, "node", "left").join(label, "node", "left").select("node", "alike", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    of = scratch.save(of)
    ok = scratch.save(with_nodes(vectors.withColumn("hash", F.xxhash64("embedding")), clash).select("vec_id", "node").join(of, "node", "left"))
    least = scratch.save(ok.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least")))
    out = ok.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("alike") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
