"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every k-word shingle of the text with A-Z
lowered; a bit is set if more than half of the hashes set it.  Equal
fingerprints collapse first, so a group of copies is one value.

Candidates: two fingerprints within distance r that are cut into r + 2
blocks agree on at least two blocks, so every pair meets in a bucket of one
pair of blocks.  A bucket above ``BUCKET`` values is cut again by blocks of
the bits it doesn't share yet, until it fits: with r + 1 blocks a pair
agrees on one of them, and few free bits hold few different values.  No
bucket is capped and no pair is lost.

Comparison: a bucket's fingerprints are stored as 64 vertical bit planes
with one fingerprint per bit of a machine word.  A query's difference to 64
fingerprints is one XOR per plane, added into saturating carry-save
counters; blocks in which every lane has exceeded the radius are abandoned.
Each task emits a spanning star for the links it has found, and the
components of all stars come from min-label contraction with checkpoints.

Nulls and texts without words have fingerprint zero, linked like any other.
A document's component is the smallest doc_id reachable; null ids sort
behind all others.  Repeated rows give one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import numtext as nt
from quarry.llm.common import exact, stored, text_column
from quarry.session import checkpoint_dir

SHINGLE = 3
RADIUS = 2
SEED = 42
#: values compared with each other in one piece
BUCKET = 4096
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = _U(0xFFFFFFFFFFFFFFFF)


# -- fingerprints ----------------------------------------------------------

def slice_fingerprints(buf: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    w = nt.words(buf, offs)
    out = np.zeros(w.n, np.uint64)
    if not len(w.start):
        return out
    # words side by side with one space between: a shingle is one span
    inside = ~nt.SPACE[buf]
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(at[-1], 32, np.uint8)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    flat[keep] = _LOWER[buf[inside]]
    data = memoryview(flat.tobytes())
    n_words = np.diff(w.first)
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    has = np.flatnonzero(n_sh)
    doc = np.repeat(np.arange(w.n), n_sh)
    base = np.cumsum(n_sh) - n_sh
    i = np.arange(len(doc)) - base[doc] + w.first[doc]
    last = np.minimum(i + k, w.first[doc + 1])
    a, b = at[i].tolist(), (at[last] - 1).tolist()
    xx = xxhash.xxh64_intdigest
    hashes = np.array([xx(data[x:y], SEED) for x, y in zip(a, b)], np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, base[has], axis=0, dtype=np.int32)
    major = np.packbits(sums * 2 > n_sh[has, None], axis=1)
    out[has] = major.view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits as a signed number."""
    docs = exact(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j, buf, offs in nt.slices(b.column(1), 1 << 20):
                fp = slice_fingerprints(buf, offs, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, fp long")


# -- bit-sliced comparison -------------------------------------------------

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, blocks): bit l of word [p, b] is bit p of fingerprint 64 b + l."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0].astype(np.uint64)


def compare_blocks(planes: np.ndarray, used: np.ndarray, left: np.ndarray, right: np.ndarray,
                   radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the lanes of the block pairs (left, right).

    ``used``: the lanes of each block that hold a fingerprint.  Returns the
    positions (64 block + lane) of the two sides of each link; within one
    block, the second lane is the later one.
    """
    found_a, found_b = [], []
    width = max(1, int(radius).bit_length())
    for lane in range(64):
        query = (used[left] >> _U(lane)) & _U(1) != 0
        later = _U(0xFFFFFFFFFFFFFFFF >> (lane + 1) << (lane + 1)) if lane < 63 else _U(0)
        alive_lanes = np.where(left == right, used[right] & later, used[right])
        pairs = np.flatnonzero(query & (alive_lanes != 0))
        if not len(pairs):
            continue
        alive = alive_lanes[pairs]
        counters = [np.zeros(len(pairs), np.uint64) for _ in range(width)]
        for p in range(64):
            l, r = left[pairs], right[pairs]
            carry = planes[p, r] ^ (_U(0) - ((planes[p, l] >> _U(lane)) & _U(1)))
            for i in range(width):                      # carry-save: add one bit to every lane
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            alive &= ~carry                             # overflow: beyond any radius of this width
            if p % 4 == 3:
                over = alive & _above(counters, radius)
                alive ^= over
                keep = alive != 0
                if not keep.all():                      # abandoned blocks leave
                    pairs, alive = pairs[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                    if not len(pairs):
                        break
        if len(pairs):
            hit = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, col = np.nonzero(hit)
            found_a.append(left[pairs[row]] * 64 + lane)
            found_b.append(right[pairs[row]] * 64 + col)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than the radius."""
    more = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], _ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key; small buckets share blocks of 64 lanes."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    place = np.zeros(len(starts), np.int64)
    pos = 0
    for k, s in enumerate(sizes.tolist()):              # one step for each bucket
        if s > 64 - pos % 64 and pos % 64:
            pos += 64 - pos % 64
        place[k] = pos
        pos += s
    blocks = -(-pos // 64)
    where = np.repeat(place - starts, sizes) + np.arange(len(keys))
    lanes = np.zeros(blocks * 64, np.uint64)
    lanes[where] = fps
    row = np.full(blocks * 64, -1, np.int64)
    row[where] = np.arange(len(keys))
    used = np.packbits(row.reshape(-1, 64) >= 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
    planes = bit_planes(lanes)
    own = np.arange(blocks)
    out = [compare_blocks(planes, used, own, own, radius)]
    for k in np.flatnonzero(sizes > 64):                # a bucket of many blocks: every pair of its blocks
        b0, n = place[k] // 64, -(-sizes[k] // 64)
        i, j = np.triu_indices(int(n), 1)
        out.append(compare_blocks(planes, used, b0 + i, b0 + j, radius))
    a, b = (np.concatenate([x[s] for x in out]) for s in (0, 1))
    return row[a], row[b]


def stars(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its component) for linked values only."""
    x, y = fps[a], fps[b]
    nodes, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = inv[:len(x)], inv[len(x):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def compare_partition(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> star edges; keeps at most ``rows`` rows and one bucket."""
    held_k, held_f, held = [], [], 0

    def flush(k: np.ndarray, f: np.ndarray):
        a, b = bucket_links(k, f, radius)
        u, v = stars(f.view(np.int64), a, b)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held_k.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_f.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        held += len(held_k[-1])
        if held < rows:
            continue
        k, f = np.concatenate(held_k), np.concatenate(held_f)
        cut = int(np.searchsorted(k, k[-1]))            # the last bucket may go on
        if cut:
            yield flush(k[:cut], f[:cut])
        held_k, held_f, held = [k[cut:]], [f[cut:]], len(k) - cut
    if held:
        yield flush(np.concatenate(held_k), np.concatenate(held_f))


# -- candidates ------------------------------------------------------------

def block_masks(free: int, count: int) -> list[int]:
    """The set bits of ``free`` cut into ``count`` masks of nearly equal size."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(radius: int) -> list[int]:
    m = block_masks((1 << 64) - 1, radius + 2)
    return [m[i] | m[j] for i in range(len(m)) for j in range(i)]


def link_stars(values: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Star edges (u, v) whose components are those of the links among distinct ``fp``."""
    spark = values.sparkSession
    masks = first_masks(radius)
    level = values.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    edges = None
    depth = 0
    while True:
        keyed = level.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        keyed = stored(keyed, f"simhash-level{depth}") if depth == 0 else keyed
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = stored(sizes, f"simhash-sizes{depth}")
        ready = keyed.join(sizes.filter(F.col("n") <= bucket), "key").select("key", "fp")
        run = lambda it, r=radius: compare_partition(it, r)
        found = stored(ready.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")
                       .mapInArrow(run, "u long, v long").distinct(), f"simhash-stars{depth}")
        edges = found if edges is None else edges.unionByName(found)
        if not sizes.filter(F.col("n") > bucket).limit(1).count():
            return edges
        # too large: cut by blocks of the bits that its values may differ in
        large = keyed.join(sizes.filter(F.col("n") > bucket), "key").select("fp", "mask")
        shared = [r.mask for r in large.select("mask").distinct().collect()]    # one for each combination of blocks
        cuts = {m: [_signed((m & (1 << 64) - 1) | b) for b in block_masks(~m & (1 << 64) - 1, radius + 1)] for m in shared}
        choice = F.create_map(*[x for m, bs in cuts.items() for x in (F.lit(m), F.array(*[F.lit(b) for b in bs]))])
        level = stored(large.select("fp", F.explode(choice[F.col("mask")]).alias("mask")).distinct(), f"simhash-cut{depth}")
        depth += 1


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest node of each node's component, for edges (u, v).

    Alternates large-star (every neighbour that is greater points to the
    smallest neighbour) and small-star (every smaller one does), which ends
    with each node linked to its root.  Each round is a minimum per node
    (pre-aggregated) and an equi-join, checkpointed.  The rounds end when one
    leaves the set of edges as it was, compared edge by edge.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    count = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")) \
            .select("e.*").filter("u <> v").distinct()
        before, old = edges, count
        edges = small.checkpoint()
        count = edges.count()
        if count == old and not edges.join(before, ["u", "v"], "left_anti").limit(1).count():
            return edges.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (signed), fingerprint (hex), component_id."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    values = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-values")
    roots = components(link_stars(values.select("fp"), radius))
    rooted = values.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
