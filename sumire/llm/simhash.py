"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, arrow_map, components, parts, table

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits: each set where it is set in over half of the XXH64 hashes (seed 42) of the word shingles.

    A-Z are lower-cased; words are runs of anything but space and U+0009 to U+000D. Fewer words than
    width: the whole sequence is one shingle. No word (null, empty or white text): zero.
    """
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _kernel(width: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), lambda: _kernel(width), "doc_id long, fp long")


#: Groups of more fingerprints than this are indexed again by the rest of their bits.
GROUP = 4096


def spanning(fps: np.ndarray, near: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints at near or fewer differing bits: each is compared with all not yet reached."""
    if len(fps) == 2:
        a, b = fps.tolist()
        return [(a, b)] if a != b and ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= near else []
    left, out = np.unique(fps), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count((left ^ x).view(np.uint64)) <= near
            if hit.any():
                got, left = left[hit], left[~hit]
                todo += list(got)
                out += [(int(x), int(y)) for y in got]
    return out


def _links(near: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(0)
        values, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = [e for i, j in zip(at[:-1], at[1:], strict=True) for e in spanning(values[i:j], near)]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _variants(value, bits: int, tag: int):
    """Keys of a segment of so many bits: itself and each of its one-wildcard variants, with tag, place and the bits left."""
    keys = [F.shiftleft(F.lit(tag * 33 + 32).cast("long"), 32).bitwiseOR(value)]
    keys += [F.shiftleft(F.lit(tag * 33 + b).cast("long"), 32).bitwiseOR(value.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << b)).cast("long"))) for b in range(bits)]
    return keys


def links(fps: DataFrame, scratch: Scratch, near: int = 3) -> DataFrame:
    """(a, b): links that span every group of distinct fp at near or fewer differing bits (near at most 3).

    Two halves of 32 bits: with 3 differing bits one half differs by at most one, so the two share
    that half or one of its one-wildcard variants. Keys are counted first, and those of one fingerprint dropped.
    A key's fingerprints are verified against each other and leave the links of a spanning forest, fewer than there
    are fingerprints. The members of a key of more than GROUP are never gathered: they are indexed once more by the
    quarters of their other half, of which again one differs by at most one bit; such a group agrees in 47 bits
    and more, so it has 2^18 members at most.
    """
    if near > 3:
        raise ValueError("two segments find pairs at 3 bits or fewer")
    fps = fps.repartition(parts(fps.sparkSession), "fp")  # each makes 66 keys: over all cores, however few files hold them
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = [F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32)]
    index = fps.select("fp", F.explode(F.array(*[k for i, h in enumerate(halves) for k in _variants(h, 32, i)])).alias("key"))
    crowds = scratch.save(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    index = scratch.save(index.join(crowds.hint("merge"), "key"))  # crowds grow with the documents
    groups = index.where(F.col("n") <= GROUP).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    other = F.when(F.col("key") < F.shiftleft(F.lit(33).cast("long"), 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(low))
    short = F.lit(0xFFFF).cast("long")
    again = index.where(F.col("n") > GROUP).select("key", "fp", F.explode(F.array(*_variants(other.bitwiseAND(short), 16, 0), *_variants(F.shiftrightunsigned(other, 16), 16, 1))).alias("sub"))
    again = again.groupBy("key", "sub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return arrow_map(groups.unionByName(again), lambda: _links(near), "a long, b long")


def near_duplicates(docs: DataFrame, near: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that links reach. Rows with a null doc_id take part; a component
    of such rows alone has a null id. Rows of one doc_id are each judged by their own text.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.save(fingerprints(docs, width))
    reps = scratch.save(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(reps.select("fp"), scratch, near), scratch)
    of = scratch.save(reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    ids = scratch.save(of.groupBy("component").agg(F.min("rep").alias("component_id")))
    of = scratch.save(of.join(ids, "component").select("fp", "component_id"))
    return each.join(of, "fp").select("doc_id", "fp", "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word shingles alike to 0.8 or more, the one of the least doc_id; see wide.keep_one."""
    from .wide import keep_one

    return keep_one(docs)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
