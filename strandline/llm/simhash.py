"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point within half the radius of
both, so if each emits all variants within half the radius, they meet. On whole
64-bit fingerprints of radius 4 that is 2,081 variants a fingerprint. Here balls
are put around halves first: of two fingerprints within 4 bits, one 32-bit half
differs in 2 bits at most, and the variants within 1 bit of that half (33 for
each half) meet. Pairs that collide there are verified. Only where a variant of a
half collects more than ``CROWD`` fingerprints, as in a very large group of near
copies, do its members emit the full ball; members that share a full variant are
within the radius of one another by the triangle inequality, so each is linked to
the smallest. What a task finds leaves it as a forest, so no group is ever
expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import connected_components, cut, join_hot, small_batches, stars, table

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints under one variant of a half that are compared with each other: up
#: to here that costs less than shuffling the 2,081 variants of each.
CROWD = 1024
#: Rows that a task holds while it looks for collisions.
HELD = 1 << 19

_BITS = np.unpackbits(np.arange(256, dtype="u1")[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's k-word shingles, repeats included; of all its words where they are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip((ends - lengths).tolist(), ends[k - 1 :].tolist(), strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """SimHash: the bits that more than half of the hashes have."""
    planes = hashes.view("u1").reshape(-1, 8)
    counts = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = (2 * counts > len(hashes)).astype("u1")
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's k-word shingles, as an unsigned 64-bit number."""
    return majority(shingles(text, k, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long); null and empty texts: 0."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t or "", k) for t in batch.column(1).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _columns(batches, names, rows=HELD):
    """Column arrays of about ``rows`` rows each, from smaller batches."""
    kept, n = [], 0
    for batch in batches:
        kept.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept, n = [], 0
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _emit_halves(batches):
    flips = np.concatenate([[0], 1 << np.arange(32, dtype=np.int64)])
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for block in (0, 1):
            half = (fp >> (32 * block)) & 0xFFFFFFFF
            keys = (half[:, None] ^ flips) | (block << 32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, 33))], names=["key", "fp"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view("u8"))


def _meet_halves(radius: int):
    def run(batches):
        """Rows sorted by key, fp: verified links (a, b), and members of crowded keys (a, null)."""
        held_key, held_fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        none = np.zeros(0, np.int64)

        def out(a, b, crowd):
            left, right = np.concatenate([a, crowd]), np.concatenate([b, crowd])
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right, mask=np.arange(len(left)) >= len(a))], names=["a", "b"])

        def work(key, fp, last):
            """Links and crowd of the groups that are whole, and what to hold of the last."""
            nonlocal crowded
            members = none
            if crowded is not None and len(key):
                same = key == crowded
                members, key, fp = fp[same], key[~same], fp[~same]
                if len(key):
                    crowded = None
            if not len(key):
                return none, none, members, none, none
            new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            size = np.diff(np.append(new, len(key)))
            held = slice(len(key), None)
            if not last:
                if size[-1] > CROWD:
                    crowded = key[-1]
                else:
                    held = slice(new[-1], None)
            per_row = np.repeat(size, size)
            big = per_row > CROWD
            hold = np.zeros(len(key), bool)
            hold[held] = True
            members = np.concatenate([members, fp[big & ~hold]])
            small = (per_row > 1) & ~big & ~hold
            k, f = key[small], fp[small]
            # Rows that a group still has from each row on; pairs at a lag are a prefix of this order.
            rest = (per_row - (np.arange(len(key)) - np.repeat(new, size)))[small]
            order = np.argsort(-rest, kind="stable")
            depth = -rest[order]
            a, b = [none], [none]
            for lag in range(1, CROWD):
                pair = order[: np.searchsorted(depth, -lag, side="left")]
                if not len(pair):
                    break
                x, y = f[pair], f[pair + lag]
                near = _apart(x, y) <= radius
                # A pair whose halves differ in one bit or none meets often; once is enough.
                high = k[pair] >> 32 == 1
                half, other = np.where(high, x >> 32, x) & 0xFFFFFFFF, np.where(high, y >> 32, y) & 0xFFFFFFFF
                near &= (_apart(half, other) > 1) | (half == (k[pair] & 0xFFFFFFFF))
                a.append(x[near])
                b.append(y[near])
            return *stars(np.concatenate(a), np.concatenate(b)), np.unique(members), key[held], fp[held]

        for key, fp in _columns(batches, ("key", "fp")):
            a, b, members, held_key, held_fp = work(np.concatenate([held_key, key]), np.concatenate([held_fp, fp]), False)
            yield out(a, b, members)
        a, b, members, _, _ = work(held_key, held_fp, True)
        yield out(a, b, members)

    return run


def ball(radius: int) -> np.ndarray:
    """Masks of at most ``radius`` set bits."""
    one = 1 << np.arange(64, dtype="u8")
    out = [np.zeros(1, "u8"), one]
    while len(out) <= radius:
        out.append(np.unique((out[-1][:, None] | one).ravel()))
        out[-1] = out[-1][np.bitwise_count(out[-1]) == len(out) - 1]
    return np.concatenate(out[: radius + 1]).view("i8")


def _emit_ball(radius: int):
    def run(batches):
        masks = ball(radius)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 128):
                part = fp[at : at + 128]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks)))], names=["key", "fp"])

    return run


def _meet_ball(batches):
    """Rows sorted by key, fp: each fingerprint to the smallest under its key, as a forest."""
    key_was, first_was = None, None
    for key, fp in _columns(batches, ("key", "fp")):
        new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        first = np.repeat(fp[new], np.diff(np.append(new, len(key))))
        if key_was is not None and key[0] == key_was:
            first[key == key_was] = first_was
        key_was, first_was = key[-1], first[-1]
        x, y = stars(fp[fp != first], first[fp != first])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within radius bits.

    fps: one column fp without repeats. radius: an even number up to 4.
    """
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    halves = fps.select("fp").mapInArrow(_emit_halves, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    met = cut(halves.mapInArrow(_meet_halves(radius), "a long, b long"), "met")
    crowd = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    full = crowd.mapInArrow(_emit_ball(radius // 2), "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return met.where("b is not null").union(full.mapInArrow(_meet_ball, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id of its component, for every row.

    Documents with one fingerprint are one node; texts without words have
    fingerprint 0 and link like any other. A null doc_id never names a component
    unless all of its doc_ids are null. Repeated rows come back repeated.
    """
    rows = cut(fingerprints(docs, k=k), "fps")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = connected_components(links(nodes.select("fp"), radius), "a", "b")
    member = cut(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "members")
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = cut(join_hot(member, lowest, "root").select("fp", "component_id"), "components")
    return join_hot(rows, by_fp, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
