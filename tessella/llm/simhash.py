"""SimHash near-duplicates, linked by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import shingle_sets
from tessella.llm.common import connected_components, documents, drop_table, write_table

SEED = 42


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([hash64(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter(
        (hash64(joined[i:j], SEED) for i, j in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1
    )


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes give 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row (id, fp) per row of ``docs``; fp is the fingerprint as a signed long. Null text counts as no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (id, fp, s, n, bands) per row (id, text): the fingerprint, and a digest, the size and the table keys of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, sizes, bands = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle)
                unique = np.unique(hashes)
                fps.append(majority(hashes))
                digests.append(shingle_sets.set_digest(unique))
                sizes.append(len(unique))
                bands.append(shingle_sets.band_keys(unique))
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], names=["id", "fp", "s", "n", "bands"])

    return docs.mapInArrow(run, "id long, fp long, s binary, n long, bands array<long>")


def covering_masks(radius: int) -> list[int]:
    """2^(r+1)-1 masks of 64 bits such that for any r bit positions some mask leaves all of them out.

    Bit i gets a non-zero code c(i) in r+1 bits; mask v keeps the bits whose code has odd parity with v.
    At most r differing bits give at most r linear conditions on v, which r+1 bits can always meet.
    """
    codes = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if bin((i % codes + 1) & v).count("1") % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(radius: int, most: int):
    """mapInArrow body over rows (t, key, fp, rep) sorted by bucket: a spanning forest of each bucket's links."""

    def forest(t, key, fp, rep):
        n = len(t)
        label, active, left, right = np.arange(n), np.arange(n), [], []
        for shift in range(1, most):
            active = active[active + shift < n]
            active = active[(t[active] == t[active + shift]) & (key[active] == key[active + shift])]
            if not len(active):
                break
            near = active[np.bitwise_count(fp[active] ^ fp[active + shift]) <= radius]
            left.append(near)
            right.append(near + shift)
        if not left:
            return rep[:0], rep[:0]
        left, right = np.concatenate(left), np.concatenate(right)
        while True:  # smallest row reachable, by repeated minimum and pointer jumping
            new = label.copy()
            np.minimum.at(new, left, label[right])
            np.minimum.at(new, right, label[left])
            new = new[new]
            if (new == label).all():
                break
            label = new
        rows = np.flatnonzero(label != np.arange(n))
        return rep[rows], rep[label[rows]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate([k, c.view(np.uint64) if i == 2 else c]) for i, (k, c) in enumerate(zip(kept, cols))]
            t, key = cols[:2]
            if not len(t):
                continue
            cut = np.flatnonzero((t == t[-1]) & (key == key[-1]))[0]  # the last bucket may go on in the next batch
            kept = [c[cut:] for c in cols]
            a, b = forest(*[c[:cut] for c in cols])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        a, b = forest(*kept)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 4, pairwise: int = 256) -> DataFrame:
    """Edges (a, b) between representatives whose components are those of all pairs within ``radius`` bits.

    ``distinct`` has rows (fp, rep), one per fingerprint. Each fingerprint goes to one bucket of every
    covering table; buckets of up to ``pairwise`` fingerprints are compared in full inside a task, which
    returns a spanning forest. Fingerprints of larger buckets are linked exactly in linear work: two are
    within r bits if and only if some word lies within ceil(r/2) bits of one and floor(r/2) of the other,
    so each emits its neighbours in those balls and meets the others in an aggregate.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    spread = distinct.select("fp", "rep", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("t", "key"))
    sizes = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = write_table(sizes, "bucket-sizes")
    small = spread.join(sizes.where(F.col("n") <= pairwise), ["t", "key"], "left_semi").select("t", "key", "fp", "rep")
    small = small.repartition("t", "key").sortWithinPartitions("t", "key")
    found = small.mapInArrow(_bucket_links(radius, pairwise), "a long, b long")
    if not sizes.where(F.col("n") > pairwise).isEmpty():
        hot = write_table(spread.join(sizes.where(F.col("n") > pairwise), ["t", "key"], "left_semi").select("fp", "rep").distinct(), "hot")
        found = found.unionByName(_ball_links(hot, radius))
    return found


def _ball(radius: int) -> list[int]:
    out, layer = [0], [(0, -1)]
    for _ in range(radius):
        layer = [(m | 1 << i, i) for m, last in layer for i in range(last + 1, 64)]
        out += [m for m, _ in layer]
    return out


def _ball_links(hot: DataFrame, radius: int) -> DataFrame:
    """Edges through shared words of the half-radius balls; the odd radius' larger ball is met with the smaller one only."""
    wide, narrow = (radius + 1) // 2, radius // 2
    flips = F.array(*[F.lit(_signed(m)) for m in _ball(wide)])
    inner = len(_ball(narrow))
    near = hot.select("rep", F.posexplode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("i", "word"))
    centre = near.where(F.col("i") < inner).groupBy("word").agg(F.min("rep").alias("b"), F.max("rep").alias("top"), F.count("*").alias("n"))
    if wide == narrow:
        centre = centre.where("n > 1")
    return near.join(centre.select("word", "b"), "word").where("rep != b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, pairwise: int = 256) -> DataFrame:
    """Rows (id, fp, component_id): component_id is the smallest id reachable over links of at most ``radius`` bits.

    Defined results: a null or empty text, or one of white space only, has fingerprint 0 and is linked like
    any other; equal texts share a fingerprint and so a component; repeated rows each give a row; a row
    with a null id gets its fingerprint's component (null if no other row has an id there); an empty
    table gives no rows. Other columns of ``docs`` are neither read nor returned.
    """
    marks = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = write_table(marks.groupBy("fp").agg(F.min("id").alias("rep")), "distinct-fingerprints")
    parts = connected_components(links(distinct.where("rep IS NOT NULL"), radius, pairwise), "a", "b")
    known = distinct.join(parts, distinct.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    known = write_table(known, "known-fingerprints")
    drop_table(parts)
    drop_table(distinct)
    return marks.join(known, "fp").select("id", "fp", "component_id")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4, pairwise: int = 256
) -> DataFrame:
    """Rows (id, fp, component_id) as of ``near_duplicates``, over links of at most ``radius`` bits and, besides, of sets of shingles
    with a Jaccard similarity of ``similarity`` or more.

    Two texts of similarity 0.8 differ in ten of the 64 bits on average, which no affordable number of covering tables
    reaches; so candidates of the second kind come from MinHash tables and are compared exactly (``shingle_sets.components``).
    Nulls, empty texts, repeats and empty tables are treated as in ``near_duplicates``; texts without words are linked by their fingerprint.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = write_table(sketches(rows, shingle), "sketches")
    classes = marks.groupBy("fp", "s").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = write_table(classes, "sketch-classes")
    named = classes.where("rep IS NOT NULL")
    distinct = write_table(named.groupBy("fp").agg(F.min("rep").alias("rep")), "distinct-fingerprints")
    by_set = named.groupBy("s").agg(F.min("rep").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    by_set = write_table(by_set, "distinct-sets")
    same_fp = named.select("fp", F.col("rep").alias("a")).join(distinct, "fp").where("a != rep").select("a", F.col("rep").alias("b"))
    same_set = named.select("s", F.col("rep").alias("a")).join(by_set.select("s", "low"), "s").where("a != low").select("a", F.col("low").alias("b"))
    edges = write_table(links(distinct, radius, pairwise).unionByName(same_fp).unionByName(same_set), "near-edges")
    parts = shingle_sets.components(by_set.select(F.col("low").alias("rep"), "n", "bands"), edges, rows, lambda t: shingle_hashes(t, shingle), similarity)
    known = classes.join(parts, classes.rep == parts.node, "left").select("fp", "s", F.coalesce("component", "rep").alias("component_id"))
    known = write_table(known, "known-classes")
    for t in (classes, distinct, by_set, edges, parts):
        drop_table(t)
    return marks.join(known, ["fp", "s"]).select("id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
