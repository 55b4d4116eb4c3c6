"""Near copies by wide SimHash fingerprints: deletion-variant signatures find candidates, the shingles' sets themselves decide.

Texts alike to 0.8 in their word shingles differ in some 15 % of a fingerprint's bits, too many for 64 bits cut in two. The same
index over more bits finds them: SEGMENTS segments of BITS bits, of which some are expected to differ by one bit at most. By calculation a pair at
just 0.8 meets in one of 48 segments of 24 bits with probability 0.994, at 0.85 with 0.9998.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, arrow_map, components, fresh
from .simhash import LOWER

#: Words of a shingle and least similarity (Jaccard).
WIDTH, ALIKE = 5, 0.8
#: Segments and their bits (two halves of 12). With n documents a key has n / 2^23 by chance: for over some 10^9, take more of both.
SEGMENTS, BITS = 48, 24
HALF, WORDS = BITS // 2, SEGMENTS * BITS // 64
#: Of the last 128 bits, how many may differ in candidates: 4.5 standard deviations above what 0.8 gives.
FAR = 38
#: Fingerprints that are looked at in one place.
ROUTE = 50_000
#: Sets, and shingles in them, that are compared in one place; larger candidate groups are cut into blocks, and all pairs of blocks are compared.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
_SALT = np.random.default_rng(42).integers(0, 1 << 63, WORDS, np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 hashes of the shingles; fewer words than width are one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts, (ends[min(width, len(words)) - 1 :] - 1).tolist(), strict=True)], np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits: each bit set where over half of the shingles' remixed hashes have it."""
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(found), 255):
        h = found[i : i + 255, None] ^ _SALT
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")


def name_of(words: list[bytes]) -> bytes:
    """128 bits that stand for the words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def _signed(b: pa.RecordBatch) -> pa.RecordBatch:
    each = [words_of(x) for x in b.column(1).to_pylist()]
    made = [fingerprint(shingles(w)).tobytes() if w else None for w in each]
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(name_of, each)), pa.binary()), pa.array(made, pa.binary())], ["doc_id", "name", "fp"])


def _node(names: pa.Array) -> np.ndarray:
    """A name's first 64 bits: what candidates go by."""
    return np.frombuffer(b"".join(x[:8] for x in names.to_pylist()), "<i8")


def _routed(lanes: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        """Fingerprints dealt by each half of each segment: for (segment, half, lane) the segments, nodes and last words."""
        out: list[tuple] = []
        if b.num_rows:
            node = _node(b.column(0))
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(b.num_rows, SEGMENTS, BITS)
            values = bits @ (1 << np.arange(BITS, dtype=np.int64))
            last = raw.view("<u8")[:, -2:]
            for s in range(SEGMENTS):
                for half in (0, 1):
                    v = values[:, s]
                    if half:  # the half that deals comes first
                        v = (v >> HALF) | ((v & ((1 << HALF) - 1)) << HALF)
                    lane = (v & ((1 << HALF) - 1)) % lanes
                    order = lane.argsort(kind="stable")
                    cut = np.flatnonzero(np.concatenate([[True], np.diff(lane[order]) != 0]))
                    for i, j in zip(cut, [*cut[1:], len(order)], strict=True):
                        at = order[i:j]
                        out.append(((s * 2 + half) * lanes + int(lane[at[0]]), v[at].astype("<u4").tobytes(), node[at].astype("<i8").tobytes(), last[at].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(4)], ["route", "segment", "node", "last"])

    return run


def forest(node: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints of which at most FAR of the last bits differ: each is compared with all not yet reached."""
    order = node.argsort(kind="stable")
    left, out = order, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(last[left] ^ last[x]).sum(1) <= FAR
            if hit.any():
                got, left = left[hit], left[~hit]
                todo += got.tolist()
                out += [(int(node[x]), int(node[y])) for y in got.tolist()]
    return out


def stars(links: np.ndarray) -> np.ndarray:
    """For links (a, b) one link (least, node) for each node but the least of those that links join: keys that find the same group leave the same links."""
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.stack([nodes[label], nodes], 1)
    return out[label != np.arange(len(nodes))]


def candidates(segment: np.ndarray, node: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Links (least, node) among fingerprints of a route that agree in a half and in all but one bit of the other, and are near enough in their last bits.

    The other half's one-wildcard variants are the keys; a key's members leave the links of a spanning forest, and these a star for each group that they join.
    """
    found: list[np.ndarray] = []
    for wild in range(HALF, BITS):
        key = segment & ~np.uint32(1 << wild)
        order = key.argsort(kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(key)]]))
        small = np.repeat(size <= 16, size)
        for by in range(1, 16):
            at = np.flatnonzero((key[by:] == key[:-by]) & small[by:])
            if not len(at):
                break
            a, b = order[at], order[at + by]
            near = np.bitwise_count(last[a] ^ last[b]).sum(1) <= FAR
            found.append(np.stack([node[a[near]], node[b[near]]], 1))
        for i in np.flatnonzero(size > 16):
            at = order[start[i] : start[i] + size[i]]
            found.append(np.array(forest(node[at], last[at]), np.int64).reshape(-1, 2))
    out = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return stars(out)


def _candidates(rows: pa.Table) -> pa.Table:
    get = lambda n, kind: np.frombuffer(b"".join(rows[n].to_pylist()), kind)
    out = candidates(get("segment", "<u4"), get("node", "<i8"), get("last", "<u8").reshape(-1, 2))
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def _named(b: pa.RecordBatch) -> pa.RecordBatch:
    each = [words_of(x) for x in b.column(0).to_pylist()]
    names = pa.array(list(map(name_of, each)), pa.binary())
    return pa.RecordBatch.from_arrays([names, pa.array(_node(names), pa.int64()), pa.array([b" ".join(w) for w in each], pa.binary())], ["name", "node", "words"])


def _sets(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(x.split()).view(np.int64) for x in b.column(2).to_pylist()]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["name", "component", "shingles"])


def spanning(names: list, sets: list[np.ndarray], alike: float = ALIKE) -> list[tuple]:
    """Links of a spanning forest over the sets at alike or more: each is compared with all of a like size that are not yet reached.

    What two sets share is bounded first, by the shingles that any other set has and by bitmaps of these (a bit that only one of the two has is a
    shingle that they don't share); where the bounds allow a link, shingles are counted.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = sizes.argsort(kind="stable")
    order = order[sizes[order] > 0]
    if len(order) < 2:
        return []
    sizes, flat = sizes[order], np.concatenate([sets[i] for i in order.tolist()])
    holders = np.repeat(np.arange(len(order)), sizes)
    _, ids, held = np.unique(flat, return_inverse=True, return_counts=True)
    common = held[ids] > 1
    flat, ids, holders = flat[common], ids[common], holders[common]
    kept = np.bincount(holders, minlength=len(order))
    starts = np.cumsum(kept) - kept
    left = np.flatnonzero(kept >= alike * sizes - 1e-9)
    if len(left) < 2:
        return []
    bits = 1 << max(6, int(2 * len(flat) // len(order)).bit_length())
    maps = np.zeros((len(order), bits), bool)
    maps[holders, (flat.view(np.uint64) & np.uint64(bits - 1)).view(np.int64)] = True
    maps = np.ascontiguousarray(np.packbits(maps, axis=1).view(np.uint64)[left].T)  # a row for each word
    ones = np.bitwise_count(maps).sum(0, dtype=np.int64)
    mark = np.zeros(len(held), bool)
    out: list[tuple] = []
    todo: list[tuple] = []  # sets that were reached, with their bitmaps
    free = np.ones(len(left), bool)
    n_free, seed = len(left), 0
    while n_free:
        if not todo:
            seed += int(free[seed:].argmax())
            free[seed] = False
            n_free -= 1
            todo.append((int(left[seed]), maps[:, seed].copy(), int(ones[seed])))
            continue
        if n_free * 2 < len(left):
            left, maps, ones = left[free], np.ascontiguousarray(maps[:, free]), ones[free]
            free, seed = np.ones(n_free, bool), 0
        x, bitmap, own = todo.pop()
        size = sizes[left]
        lo, hi = np.searchsorted(size, alike * sizes[x] - 1e-6), np.searchsorted(size, (sizes[x] + 1e-6) / alike, side="right")
        both = np.bitwise_count(maps[:, lo:hi] & bitmap[:, None]).sum(0, dtype=np.int64)
        least = (alike * (size[lo:hi] + sizes[x]) - 1e-6) / (1 + alike)
        at = lo + np.flatnonzero(free[lo:hi] & (kept[x] - own + both >= least) & (kept[left[lo:hi]] - ones[lo:hi] + both >= least))
        if not len(at):
            continue
        y = left[at]
        n = kept[y]
        ends = np.cumsum(n)
        mine = ids[starts[x] : starts[x] + kept[x]]
        mark[mine] = True
        both = np.add.reduceat(mark[ids[np.arange(ends[-1]) - np.repeat(ends - n - starts[y], n)]], ends - n, dtype=np.int64)
        mark[mine] = False
        hits = at[both >= alike * (sizes[y] + sizes[x] - both) - 1e-9]
        free[hits] = False
        n_free -= len(hits)
        todo += [(int(left[i]), maps[:, i].copy(), int(ones[i])) for i in hits.tolist()]
        out += [(names[order[x]], names[order[i]]) for i in left[hits].tolist()]
    return out


def _links(rows: pa.Table) -> pa.Table:
    found = []
    if rows.num_rows > 1:
        lists = rows["shingles"].combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        found = spanning(rows["name"].to_pylist(), [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
    return pa.table({c: pa.array([e[k] for e in found], pa.binary()) for k, c in enumerate("ab")})


def compared(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links of ALIKE or more that span every group of the sets (name, component, shingles) of one component.

    A component's sets are dealt over blocks, and each pair of blocks is one group. Its rows go to Python as they are sorted: executors never hold groups as rows of arrays.
    """
    sizes = sets.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = sets.join(scratch.save(sizes).hint("merge"), "component").withColumn("own", F.expr("CAST(pmod(xxhash64(name), blocks) AS INT)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name", "shingles")
    return dealt.groupBy("component", "i", "j").applyInArrow(_links, "a binary, b binary")


def linked(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(name, rep) of the distinct texts, rep the least doc_id; and (node, component) of those names that links of ALIKE or more join."""
    each = scratch.save(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), lambda: _signed, "doc_id long, name binary, fp binary"))
    reps = scratch.save(each.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp")))
    n = reps.count()
    lanes = max(1, min(1 << HALF, n // ROUTE + 1))
    routed = arrow_map(reps.where("fp is not null").select("name", "fp"), lambda: _routed(lanes), "route long, segment binary, node binary, last binary")
    near = components(routed.groupBy("route").applyInArrow(_candidates, "a long, b long"), scratch)
    near = scratch.save(near.distinct())
    words = arrow_map(docs.select(F.col("text").cast("binary").alias("text")), lambda: _named, "name binary, node long, words binary")
    picked = words.join(near.hint("merge"), "node").groupBy("name").agg(F.first("component").alias("component"), F.first("words").alias("words")).select("name", "component", "words")
    sets = scratch.save(arrow_map(picked, lambda: _sets, "name binary, component long, shingles array<long>"))
    return reps.select("name", "rep"), components(compared(sets, scratch), scratch).distinct()


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, name, component_id) for each row of docs: component_id is the smallest doc_id that links of ALIKE or more reach.

    Texts that are the same words but for A-Z's case and white space have one name (128 bits). Texts without words are alike. Rows with a null
    doc_id take part, as in near_duplicates; a component of such rows alone has a null id.
    """
    scratch = Scratch(docs.sparkSession, "wide")
    reps, found = linked(docs, scratch)
    of = scratch.save(reps.join(found.withColumnRenamed("node", "name"), "name", "left").select("name", "rep", F.coalesce("component", "name").alias("component")))
    ids = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = scratch.save(of.join(ids, "component").select("name", "component_id"))
    names = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), lambda: _named_ids, "doc_id long, name binary")
    return names.join(of, "name").select("doc_id", "name", "component_id")


def _named_ids(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([name_of(words_of(x)) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "name"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of docs that links of ALIKE or more join, and all that are in none.

    Of a group stays the row of the least doc_id (a null one only where no other is there), of several such rows that of the least name, of
    rows alike in both any one. Copies are one before they are exchanged.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    reps, found = linked(docs, scratch)
    of = found.withColumnRenamed("node", "name").join(reps, "name").select("name", "component", F.struct(F.col("rep").isNull().alias("none"), "rep", "name").alias("key"))
    of = scratch.save(of)
    best = of.groupBy("component").agg(F.min("key").alias("best"))
    name, row, key = fresh(docs, "__name", "__row", "__key")
    gone = scratch.save(of.join(best.hint("merge"), "component").where("key <> best").select(F.col("name").alias(name)))
    at, columns = docs.columns.index("text"), docs.columns

    def named(b: pa.RecordBatch) -> pa.RecordBatch:
        names = [name_of(words_of(x)) for x in b.column(at).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.binary())], [*columns, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    one = arrow_map(docs, lambda: named, schema).select(name, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id")).alias(key))
    one = one.groupBy(name).agg(F.min_by(row, key).alias(row))
    return one.join(gone.hint("merge"), name, "left_anti").select(f"{row}.*")
