"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct ``shingle``-word shingles (a shorter text: all its words as one).
Two permutations of the 32-bit numbers make the whole signature: the first scatters the shingles,
and coordinate k is the least value of the second over the scattered shingles circularly shifted by
k. ``rows`` coordinates make a band; documents that agree on a band share a bucket.

Copies collapse first: one representative (the smallest id) stands for all documents with one set.
Buckets never give all their pairs. In a round each bucket has one leader, the first of its members
in an order that all buckets share: at first the document that meets most others in its buckets, then
by hash. A document is paired with the leader of most of its buckets, the pairs are verified on full
sets, and verified links join components. Documents of buckets that the rounds leave with several
components are open. Open documents of different components are
compared only where they must be: two sets that reach the similarity share a shingle among the
rarest of each, at places that leave room for enough more, and differ in few bits of a bitmap (prefix,
positional and bitmap filter, none of which loses a link). The sizes that a place leaves possible are part of
the join key, in bands, so texts that share a passage without being alike enough are not met in pairs. So every pair that shares a band is verified, ruled out or joined already, with no cap on
bucket sizes or partners, and pairs of a large group of unlike edits are not listed. With 32 bands
of 4 rows a pair at similarity 0.8 shares no band with probability 5e-8. Shingles are compared by
64-bit hashes and whole sets, when copies collapse, by 128-bit ones.

Texts are shuffled once, to fetch the sets of documents that are in some candidate pair. Results of
every round are written to the cluster's shared folder, so lost executors cost one round at most.

Defined cases: no words: empty set, linked with nothing; a null id is linked with nothing and kept;
rows of one id are one node with a set for each text; a text of any length is one set; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, rolling, split_words, starts_of, text_slices, word_hashes, written

#: Elements of one step over all coordinates: small enough for a core's cache.
BLOCK = 1 << 15
#: Longs of a set's bitmap.
LONGS = 8
#: Sizes of one band differ by less than this share.
STEP = 0.05


def first_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit numbers."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def second_permutation(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Another bijection of the 32-bit numbers, in place."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)
    return np.multiply(x, np.uint32(0x846CA68B), out=x)


def signatures(sets: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Signature of each set: sets[starts[i]:starts[i+1]], none of them empty."""
    out = np.empty((len(starts) - 1, coordinates), np.uint32)
    scattered = first_permutation(sets.astype(np.uint32))
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK, side="right")) - 1)
        own, at = scattered[starts[i] : starts[j]], starts[i:j] - starts[i]
        value, spare = np.empty_like(own), np.empty_like(own)
        for k in range(coordinates):
            np.add(own, np.uint32(k), out=value)  # the circular shift
            out[i:j, k] = np.minimum.reduceat(second_permutation(value, spare), at)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each document and band."""
    out = np.zeros((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, on end; offsets of the texts."""
    words, per_text = split_words(pc.ascii_lower(texts))
    hashes, at = word_hashes(words), starts_of(per_text)
    every = rolling(hashes, shingle)
    sets = []
    for i, n in enumerate(per_text.tolist()):
        if n >= shingle:
            sets.append(np.unique(every[at[i] : at[i + 1] - shingle + 1]))
        elif n:  # no run of ``shingle`` words hashes like a shorter one
            short = rolling(hashes[at[i] : at[i + 1]], n)
            sets.append(mix64(short ^ np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), starts_of(np.array([len(s) for s in sets], np.int64))


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), key (128-bit hash of the set, null if empty), bands (bucket keys)."""

    def run(batches):
        for part in text_slices(batches, "text"):
            sets, at = shingle_sets(pc.fill_null(part.column("text"), ""), shingle)
            size = np.diff(at)
            full = np.flatnonzero(size)
            keys = [xxhash.xxh3_128_digest(sets[at[i] : at[i + 1]].tobytes()) if size[i] else None for i in range(len(size))]
            found = band_keys(signatures(sets, starts_of(size[full]), bands * rows), bands, rows)
            offsets = starts_of(np.where(size > 0, bands, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], names=["id", "n", "key", "bands"])

    return docs.mapInArrow(run, "id long, n long, key binary, bands array<long>")


def bitmaps(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """The parity of the elements on each of 64 * LONGS bits, for each set: LONGS integers."""
    count, size = len(at) - 1, 64 * LONGS
    out = np.zeros((count, LONGS), np.uint64)
    for i in range(0, count, 1024):
        j = min(i + 1024, count)
        own = sets[at[i] : at[j]]
        bit = np.repeat(np.arange(j - i), np.diff(at[i : j + 1])) * size + (own % np.uint64(size)).astype(np.int64)
        odd = np.bincount(bit, minlength=(j - i) * size).astype(np.uint8) & 1
        out[i:j] = np.packbits(odd.reshape(j - i, size), axis=1).view(np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * LONGS), pa.array(out.ravel().view(np.int64)))


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, shingles (the whole set as 64-bit hashes), bits: a bitmap of which shingles fall on each bit an odd number of times."""

    def run(batches):
        for part in text_slices(batches, "text"):
            sets, at = shingle_sets(pc.fill_null(part.column("text"), ""), shingle)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64))), bitmaps(sets, at)], names=["id", "shingles", "bits"])

    return docs.mapInArrow(run, "id long, shingles array<long>, bits array<long>")


def verify(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity num / den, exactly.

    The first join gives ``a`` its set: a leader that stands in many pairs is met there by short rows.
    """
    num, den = similarity
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def prefix_entries(documents: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The entries of every set as the smaller and as the larger one of a pair; see ``prefix_pairs``.

    Both have token, small and large: the token, and the size bands of the smaller and the larger set.
    """
    num, den = similarity
    tokens = documents.join(sets.withColumn("n", F.size("shingles").cast("long")), ["id", "n"]).select("id", "n", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(shared, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    marked = documents.join(sets.select("id", F.size("shingles").cast("long").alias("n"), "bits"), ["id", "n"])
    rows = marked.join(ordered, ["id", "n"]).withColumn("alone", F.col("n") - F.size("tokens"))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    room = div(F.col("n") * (den - num), den) + 1 - F.col("alone")  # places that can start a match
    rows = rows.where(room > 0).select("id", "n", "component", "bits", "alone", F.posexplode(F.slice("tokens", F.lit(1), room.cast("int"))).alias("place", "t"))
    bits = [F.get("bits", F.lit(k)).alias(f"bits{k}") for k in range(LONGS)]
    rows = rows.select("id", "n", "component", F.col("t.token").alias("token"), (F.col("n") - F.col("alone") - F.col("place")).alias("rest"), *bits)
    band = lambda size: F.floor(F.log(size.cast("double")) / math.log(1 + STEP))
    every = lambda low, high: F.explode(F.sequence(band(low), band(high)))
    own, most = F.col("n"), div(F.col("rest") * (num + den), num) - F.col("n")  # the largest partner that the rest allows
    low, high = div(own * num + (den - 1), den), F.least(own, most)
    small = rows.where(own <= most).withColumn("small", band(own)).withColumn("large", every(own, most))
    large = rows.where(low <= high).withColumn("large", band(own)).withColumn("small", every(low, high))
    return small, large


def prefix_pairs(documents: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components that may reach the similarity; none that does is missing.

    Shingles are ordered by how many of the documents hold them. The first shingle that two sets
    share, at places p and q (from 0), bounds what they share by the rest of either set, so
    n - p and m - q must reach num / (num + den) of n + m. Shingles of one document only take the
    first places and are not joined. So a place of the smaller set bounds the size of the larger one
    and the other way round, and entries are joined on the size bands of both besides the shingle:
    a common passage that follows a text's own shingles meets only sizes that it still can link, most often none.
    Bitmaps hold the parity of the shingles that fall on each bit, so two sets differ in at least as
    many shingles as their bitmaps in bits.
    """
    num, den = similarity
    small, large = prefix_entries(documents, sets, similarity)
    other = large.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), "token", "small", "large", F.col("rest").alias("rx"), *[F.col(f"bits{k}").alias(f"x{k}") for k in range(LONGS)])
    both = F.col("n") + F.col("nx")
    ordered = (F.col("n") < F.col("nx")) | (F.col("n") == F.col("nx")) & (F.col("id") < F.col("x"))
    fits = ordered & (F.col("component") != F.col("cx")) & ((num + den) * F.col("rest") >= num * both) & ((num + den) * F.col("rx") >= num * both) & (den * F.col("n") >= num * F.col("nx"))
    differ = reduce(add, [F.bit_count(F.col(f"bits{k}").bitwiseXOR(F.col(f"x{k}"))) for k in range(LONGS)])
    found = small.join(other, ["token", "small", "large"]).where(fits & ((num + den) * differ <= (den - num) * both))
    return found.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of the edges (a, b).

    In a round every node of the remaining graph takes the smallest label around it, and then that
    node's own; edges are then drawn between labels, and those inside a label are gone. So a star of
    any size is one round, and rounds handle ever fewer edges.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_, steps = written(both(edges).where("a != b").distinct(), "links"), []
    while not open_.isEmpty():
        nearest = written(open_.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("near")), "near")
        onward = nearest.select(F.col("node").alias("near"), F.col("near").alias("far"))
        step = written(nearest.join(onward, "near").select("node", F.col("far").alias("label")), "labels")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in "ab")
        moved = open_.where("a < b").join(left, "a").join(right, "b").where("to_a != to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        open_ = written(both(moved).distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    labels = steps[-1]
    for step in reversed(steps[:-1]):  # a label of one round is a node of the next, unless it is settled
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = step.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
        labels = written(labels, "labels")
    return labels.select("node", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 4, rounds: int = 2) -> DataFrame:
    """id, n_shingles, component_id and kept for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = written(sketch(docs, shingle, bands, rows), "sketches")
    named = sketches.where("id is not null and key is not null")
    # tables on both sides of a join, so that Spark splits the partition of a hot key
    groups = written(named.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "groups")
    heads = named.groupBy("id", "key", "n", "bands").agg(F.lit(1).alias("one")).join(groups, (named.key == groups.key) & (named.id == groups.rep), "left_semi")
    placed = heads.select("id", "n", F.explode("bands").alias("band")).withColumn("component", F.col("id"))

    # copies of one set link to their representative; they are edges already
    edges = written(named.select("id", "key").join(groups.where("size > 1"), "key").where("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "copies")
    num, den = similarity
    sets = None
    for step in range(rounds + 1):
        if step:
            label = components(edges)
            edges = label.where("component < node").select(F.col("component").alias("a"), F.col("node").alias("b"))
            placed = buckets.drop("component").join(label, buckets.id == label.node, "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
        sizes = placed.groupBy("band").agg(F.count("*").alias("met"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        placed = written(placed.join(written(sizes.select("band", "met"), "sizes"), "band"), "open-buckets")
        # one order for all buckets, so that near copies meet one leader in most of theirs: first by how many
        # documents one meets in its buckets, which is most for the least changed copy, then by hash
        met = F.sum("met") if step == 0 else F.lit(0)
        order = placed.groupBy("id").agg(met.alias("met")).select(F.col("id").alias("x"), F.struct(-F.col("met"), F.xxhash64("id", F.lit(step))).alias("turn"))
        lead = placed.join(order, placed.id == order.x).groupBy("band").agg(F.min(F.struct("turn", "id", "n", "component")).alias("lead"))
        lead = written(lead.select("band", F.col("lead.id").alias("x"), F.col("lead.n").alias("nx"), F.col("lead.component").alias("cx")), "leaders")
        buckets = written(placed.drop("met").join(lead, "band"), "buckets")
        if step < rounds:
            # a document asks the leader of most of its buckets
            sized = (den * F.col("n") >= num * F.col("nx")) & (den * F.col("nx") >= num * F.col("n"))
            asked = buckets.where((F.col("component") != F.col("cx")) & sized).groupBy("id", "x").agg(F.count("*").alias("shared"))
            pairs = asked.groupBy("id").agg(F.max(F.struct("shared", "x")).alias("most")).select(F.col("most.x").alias("a"), F.col("id").alias("b"))
        else:
            pairs = prefix_pairs(written(buckets.select("id", "n", "component").distinct(), "open"), sets, similarity)
        pairs = written(pairs, "pairs")
        if sets is None:
            sets = written(full_sets(docs.join(written(buckets.select("id").distinct(), "wanted"), "id", "left_semi"), shingle).distinct(), "sets")
        edges = edges.union(written(verify(pairs, sets, similarity), "found"))
    label = components(edges)
    out = sketches.select("id", "n").join(label, sketches.id == label.node, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
