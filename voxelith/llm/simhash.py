"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a fixed set of
reference fingerprints (pivots): the origin, pivots inside each of four 16-bit
blocks, and eight pivots that span all bits.

* *Candidates.* Flipping one bit moves the coordinates, relative to the
  origin's, of the pivots of one block only.  Fingerprints at most two bits
  apart therefore agree on all relative coordinates of at least two of the
  four blocks: six equi-join keys, one for each pair of blocks.
* *Splitting.* A key that more than ``split`` fingerprints share (a large group
  of near copies) is split by further pivots: what lies outside its two blocks
  is cut into four smaller blocks, of which two agree again.  After the third
  level all but eight bits agree, so no bucket holds over 256 fingerprints.
* *Discard.* A pair whose distances to any wide pivot differ by more than the
  limit cannot be within it (triangle inequality); it goes before the check.
* *Verify.* Survivors are compared bit by bit.

Identical fingerprints are folded before anything is joined, so a text copied
a million times is one fingerprint.  Limits above two bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import bounded_batches, discard, fresh, join_hot, materialise

BLOCKS, WIDE = 4, 8
#: Bits of a block at each level of splitting.
WIDTHS = (16, 8, 4)
#: Hashes of one document that are counted at a time.
STEP = 1 << 16


def block_pivots(width: int, seed: int = 20) -> list[int]:
    """``width`` half-weight references inside a block whose distances, relative to the origin's, determine its bits."""
    rng = np.random.default_rng(seed + width)
    while True:
        rows = np.array([rng.permutation(width) < width // 2 for _ in range(width)], float)
        if np.linalg.matrix_rank(rows) == width:
            return [sum(1 << i for i in np.flatnonzero(r).tolist()) for r in rows]


def wide_pivots(seed: int = 20) -> list[int]:
    """``WIDE`` half-weight references over all bits."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(i) for i in rng.permutation(64)[:32]) for _ in range(WIDE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(raw: bytes | None, shingle: int, seed: int) -> int:
    """64-bit SimHash of one whole UTF-8 text; a bit is set if over half the shingle hashes set it."""
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        end = min(n, at + STEP)
        runs = [words[at + i : end + i] for i in range(shingle)] if len(words) >= shingle else None
        texts = map(join, zip(*runs, strict=False)) if runs else iter([join(words)])
        h = np.fromiter((digest(s, seed) for s in texts), np.uint64, end - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 5, seed: int = 42, into: str = "simhash") -> DataFrame:
    """The frame without its text, plus the fingerprint as a signed long (null text: zero)."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(keep).withColumn(into, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.large_binary())
            fps = pa.array([_signed(simhash(x.as_py(), shingle, seed)) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], fps], names=[*keep, into])

    return bounded_batches(docs).select(text, *keep).mapInArrow(run, schema)


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("byte")


def _relative(block: Column, width: int) -> Column:
    """Distances of a block's bits to its pivots, less the distance to the origin; one loop over the pivots, as the driver compiles what is written out."""
    pivots = F.array(*(F.lit(p).cast("long") for p in block_pivots(width)))
    return F.transform(pivots, lambda p: (F.bit_count(block.bitwiseXOR(p)) - F.bit_count(block)).cast("byte"))


def _with_keys(rows: DataFrame, rest: str, width: int) -> DataFrame:
    """Replace the bits ``rest`` by ``keys``: for each pair of its four blocks a key of relative coordinates, and the bits outside, packed."""
    keep = [c for c in rows.columns if c != rest]
    part = [F.shiftrightunsigned(rest, b * width).bitwiseAND(F.lit((1 << width) - 1)) for b in range(BLOCKS)]
    cut = rows.select(*keep, F.array(*part).alias("part"))
    cut = cut.select("*", F.transform("part", lambda p: F.xxhash64(_relative(p, width))).alias("near"))
    pairs = []
    for i, (a, b) in enumerate(combinations(range(BLOCKS), 2)):
        c, d = (x for x in range(BLOCKS) if x not in (a, b))
        pairs.append(F.struct(F.lit(i).alias("pair"), *(F.lit(x).alias(n) for n, x in zip("abcd", (a, b, c, d), strict=True))))

    def key(p: Column) -> Column:
        near, part = (lambda at, of=of: F.get(of, p[at]) for of in ("near", "part"))
        left = part("c").bitwiseOR(F.shiftleft(part("d"), width))
        return F.struct(F.xxhash64(p["pair"], near("a"), near("b")).alias("key"), p["pair"].cast("byte").alias("pair"), left.alias("rest"))

    return cut.select(*keep, F.transform(F.array(*pairs), key).alias("keys"))


def pivot_table(fps: DataFrame) -> DataFrame:
    """``(fp, w0..w7, keys array<struct<key, pair, rest>>)``: wide distances, and a key for each pair of blocks."""
    fp = F.col("fp")
    wide = fps.select("fp", *(_distance(fp, p).alias(f"w{i}") for i, p in enumerate(wide_pivots())), fp.alias("bits"))
    return _with_keys(wide, "bits", WIDTHS[0])


def _pairs(a: DataFrame, distance: int) -> DataFrame:
    """Pairs inside the buckets of ``a`` that no wide pivot discards and that are at most ``distance`` bits apart."""
    ws = [f"w{i}" for i in range(WIDE)]
    a = a.select("key", "fp", *ws)
    b = a.select("key", *(F.col(c).alias(f"{c}_b") for c in a.columns if c != "key"))
    gap = reduce(F.greatest, (F.abs(F.col(w) - F.col(f"{w}_b")) for w in ws))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= distance
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("fp") < F.col("fp_b")) & (gap <= distance) & near)
    return pairs.select(F.col("fp").alias("u"), F.col("fp_b").alias("v"))


def links(fps: DataFrame, distance: int = 2, split: int = 64) -> tuple[DataFrame, list[str]]:
    """All edges ``(u, v)`` between distinct fingerprints at most ``distance`` bits apart; a pair may come up several times.

    Also the paths of the stored tables that it reads.
    """
    if not 0 <= distance <= BLOCKS - 2:
        raise ValueError(f"the blocks prove completeness up to {BLOCKS - 2} bits")
    ws = [f"w{i}" for i in range(WIDE)]
    keyed = pivot_table(fps).select("fp", *ws, F.inline_outer("keys"))  # the outer forms bring no filter that makes the keys a second time
    found, paths = [], []
    for level in range(len(WIDTHS)):
        last = level + 1 == len(WIDTHS)
        keyed, path = materialise(keyed, "keyed")
        paths.append(path)
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
        if last:
            found.append(_pairs(keyed, distance))
            break
        sizes, path = materialise(sizes.where("n > 1"), "sizes")
        paths.append(path)
        found.append(_pairs(keyed.join(sizes.where(F.col("n") <= split), "key", "left_semi"), distance))
        if not sizes.where(F.col("n") > split).take(1):
            break
        dense = join_hot(keyed, sizes.where(F.col("n") > split), "key", sizes).where("n is not null")
        below = _with_keys(dense.select("fp", *ws, F.struct("key", "pair").alias("above"), "rest"), "rest", WIDTHS[level + 1])
        keyed = below.select("fp", *ws, "above", F.explode_outer("keys").alias("k"))
        keyed = keyed.select("fp", *ws, F.xxhash64("above", "k.key").alias("key"), "k.pair", "k.rest")
    return reduce(DataFrame.union, found), paths


def _groups(rows: DataFrame, shingle: int, distance: int, seed: int) -> tuple[DataFrame, list[str]]:
    """``rows(doc_id, text, ...)`` without the text, with ``simhash`` and ``root``, the fingerprint that stands for its component."""
    spark = rows.sparkSession
    marked, marked_at = materialise(with_fingerprint(rows, "text", shingle, seed), "simhash")
    fps, fps_at = materialise(marked.groupBy("simhash").agg(F.count("*").alias("n")), "fps")
    edges, used = links(fps.select(F.col("simhash").alias("fp")), distance)
    star = connected_components(edges)
    for path in used:
        discard(spark, path)
    rooted = star.select(F.col("node").alias("simhash"), "root")
    out = join_hot(marked, rooted, "simhash", fps).withColumn("root", F.coalesce("root", "simhash"))
    return out, [marked_at, fps_at]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 2, seed: int = 42) -> DataFrame:
    """Per document ``(doc_id, simhash long, component_id)``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` differing bits.  Null and empty texts have fingerprint zero and
    link like any other; repeated rows come back repeated; a null doc_id comes
    back as null and never names a component unless all its documents have null
    ids.  An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found, _ = _groups(rows, shingle, distance, seed)
    found, _ = materialise(found, "grouped")
    names = found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    names, _ = materialise(names, "names")
    return join_hot(found, names.drop("n"), "root", names).select("doc_id", "simhash", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 2, seed: int = 42) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Rows are told apart by id and text: rows that repeat both fold to one, different texts that share an id are
    grouped each by its own fingerprint, so no text goes unless its group keeps one.  Where several
    texts of a group share the smallest id, the one with the smallest hash stays.  Rows with a null id
    stay.  All columns are kept; extra columns may have any name.  An empty table gives no rows.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    ident, words = fresh(docs, "kept_id"), fresh(docs, "kept_text")
    digest = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(text).isNull())
    rows = named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest.alias("digest"))
    found, _ = _groups(rows, shingle, distance, seed)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("best")).select(F.col("best.doc_id").alias(ident), F.col("best.digest").alias(words))
    # repeated rows fold on the map side before anything else is dealt by id
    once = named.withColumn(ident, F.col(doc_id)).withColumn(words, digest).dropDuplicates([ident, words])
    kept = once.join(best, [ident, words], "left_semi").select(docs.columns)
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
