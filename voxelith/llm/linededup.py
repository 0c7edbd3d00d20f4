"""Line dedup by pairwise alignment.

A text is cut into lines: at line breaks, after sentences, and, in each stretch
of ``WINDOW`` words that has neither, after its smallest two-word hash
(winnowing).  Where a cut falls depends on the words near it only, so any 50
words that two texts share, with the same line breaks, hold at least two whole
lines with at least 20 words in all, whatever stands around them.  Lines that
follow each other are hashed in pairs; such a pair is rare even where a short
line is common.

* Each line pair belongs to the first document (smallest id) that has it.  A
  later document with the same pair overlaps with that one; this is one link
  for each later occurrence, however many documents share a passage.
* For each overlapping pair of documents the shared line pairs, numbered where
  they repeat, are unique in both; as in patience diff the longest run that
  rises in both documents (patience sorting) is the alignment.  What it rejects
  is common too where it makes a block of ``min_words`` words that follow each
  other in both documents: blocks in another order than the owner's.
* Lines of the later document that lie in an alignment form common blocks;
  blocks of at least ``min_words`` words are deleted.

Only hashes, ids and places move, and never more than one later document's own
lines come together in a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, join_hot, materialise, replaced
from .textkit import NON_SPACE, Words, mix, ngrams
from .textkit import batches as runs_of

_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True
#: Two-word hashes in a row of which one at least is followed by a cut: among 50 words the first cut
#: comes after 15 at most and the last before 15 at most, which leaves 20 and, as these are more than
#: a window, a cut between them.
WINDOW = 15


def _sliding(op, a: np.ndarray) -> np.ndarray:
    """``sliding(op, a, WINDOW)`` from windows of 2, 4 and 8, two of which overlap in a whole one."""
    low = a
    for w in (1, 2, 4):
        low = op(low[:-w], low[w:])
    return op(low[: len(a) - WINDOW + 1], low[WINDOW - 8 :])


def _winnowed(hashes: np.ndarray, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ends`` and, for each window of one text that has no end, its smallest two-word hashes (all, where they tie)."""
    grams = ngrams(hashes, 2) | np.uint64(1)
    if len(grams) < WINDOW:
        return ends
    grams[ends[:-1]] = 0
    low = _sliding(np.minimum, grams)
    low[text[WINDOW:] != text[:-WINDOW]] = 0
    around = np.zeros(WINDOW - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate([around, low, around]))
    return ends | np.concatenate([best == grams, [False]])


class Lines:
    """The lines of several texts: first byte (in the joined buffer), words, hash, text, place in it."""

    def __init__(self, raws: list[bytes | None]):
        w = Words(raws, NON_SPACE, fold=False)
        self.bytes_from, self.texts = w.first, len(raws)
        n = len(w.starts)
        if not n:
            self.start = self.words = self.text = self.place = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.cuts = np.zeros(len(raws) + 1, np.int64)
            return
        breaks = np.flatnonzero(w.plain == 10)
        ends = _SENTENCE_END[w.plain[w.ends - 1]]
        before = np.searchsorted(w.starts, breaks) - 1  # the word that each break follows
        ends[before[before >= 0]] = True
        ends[:-1] |= w.text[1:] != w.text[:-1]
        ends = _winnowed(w.hashes, w.text, ends)
        first = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        self.words = np.diff(np.concatenate([first, [n]]))
        inner = (np.arange(n) - np.repeat(first, self.words)).astype(np.uint64)
        self.hash = mix(np.add.reduceat(mix(w.hashes + inner * np.uint64(0xA24BAED4963EE407)), first) + self.words.astype(np.uint64))
        self.start, self.text = w.starts[first], w.text[first]
        self.cuts = np.searchsorted(self.text, np.arange(len(raws) + 1))
        self.place = np.arange(len(first)) - self.cuts[self.text]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each line with the one after it and the number of its occurrence in the text, and ``place << 32 | words << 16 | next words``."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        follows = np.concatenate([self.text[1:] == self.text[:-1], [False]])
        both = mix(self.hash * np.uint64(3) + np.where(follows, np.roll(self.hash, -1), np.uint64(1)))
        in_text = mix(both + self.text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(in_text, kind="stable")
        other = np.concatenate([[True], in_text[order][1:] != in_text[order][:-1]])
        nth = np.empty(n, np.uint64)
        nth[order] = np.arange(n) - np.maximum.accumulate(np.where(other, np.arange(n), 0))
        keys = mix(both + nth * np.uint64(0x9FB21C651E98DF25)).view(np.int64)
        words = np.minimum(self.words, 0xFFFF)
        return keys, (self.place << 32) | (words << 16) | np.where(follows, np.roll(words, -1), 0)


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def moved(theirs: np.ndarray, mine: np.ndarray, left: np.ndarray, min_words: int) -> np.ndarray:
    """Those of the line pairs ``left`` by an alignment that make blocks of at least ``min_words`` words in both documents.

    Blocks of one owner have no pair of its text in common, so a longest rising run holds a block whole or not at all.
    """
    step = np.diff(mine[left] >> 32)
    out = [left[:0]]
    for chain in np.split(left, np.flatnonzero((step > 2) | (np.diff(theirs[left]) != step)) + 1):
        x = mine[chain]
        ends = np.append(np.diff(x >> 32) > 1, True)
        if (x >> 16 & 0xFFFF).sum() + (x[ends] & 0xFFFF).sum() >= min_words:
            out.append(chain)
    return np.concatenate(out)


def deletions(owner: np.ndarray, theirs: np.ndarray, mine: np.ndarray, min_words: int) -> list[int]:
    """Places of the lines to delete from one document, from all its shared line pairs."""
    order = np.lexsort((mine, owner))
    owner, theirs, mine = owner[order], theirs[order] >> 32, mine[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    words: dict[int, int] = {}
    for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True):
        a = theirs[at:end]
        kept = mine[at:end]
        if not (np.diff(a) > 0).all():
            run = np.array(rising(a.tolist()))
            left = np.setdiff1d(np.arange(len(a)), run)
            kept = kept[np.concatenate([run, moved(a, kept, left, min_words)])]
        for x in kept.tolist():
            words[x >> 32] = x >> 16 & 0xFFFF
            if x & 0xFFFF:
                words[(x >> 32) + 1] = x & 0xFFFF
    out: list[int] = []
    block: list[int] = []
    for p in [*sorted(words), -1]:
        if block and p != block[-1] + 1:
            if sum(words[q] for q in block) >= min_words:
                out += block
            block = []
        block.append(p)
    return out


def without(raw: bytes, gone: dict[int, int], starts: np.ndarray, keys: np.ndarray) -> tuple[bytes, int]:
    """The text without the given lines (place to line-pair hash), and how many went.

    ``starts`` and ``keys`` are the first byte and the line-pair hash of each of the text's lines.
    A line goes only if its pair's hash, or that of the pair before it, is the expected one, so
    rows that share an id but not a text can't lose each other's lines.
    """
    starts = starts.copy()
    starts[:1] = 0
    ends = np.concatenate([starts[1:], [len(raw)]])
    drop = [p for p in gone if p < len(keys) and gone[p] in (int(keys[p]), int(keys[p - 1]) if p else None)]
    keep = np.ones(len(starts), bool)
    keep[drop] = False
    return b"".join(raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)), len(drop)


def materialise_alone(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``materialise``, after which the files of the shuffles that made the table go: only the table is read again."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialise(df, tag)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def shared_lines(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """``(doc_id, shared array<struct<owner, theirs, mine, key>>)`` for each document that shares line pairs with an earlier one.

    Also the paths of the tables that it reads.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(text).cast("string"), F.col(doc_id).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, ids = b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for at, part in runs_of(raws):
                cut = Lines(part)
                keys, places = cut.pairs()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[at + cut.text]), pa.array(places)], names=["key", "doc", "place"])

    found, path = materialise(bounded_batches(rows).mapInArrow(run, "key long, doc long, place long"), "lines")
    first = found.groupBy("key").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.min_by("place", "doc").alias("theirs"), F.count("*").alias("n"))
    first, owners = materialise_alone(first.where("owner < last").drop("last"), "owners")
    later = join_hot(found, first.drop("n"), "key", first, "inner").where("doc <> owner")
    return later.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("owner", "theirs", F.col("place").alias("mine"), "key")).alias("shared")), [path, owners]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 20, counts: bool = False) -> DataFrame:
    """``docs`` with each text's common blocks deleted, if an earlier document has them.

    Every row and column stays; a text that is one large block becomes empty.
    ``counts`` adds ``n_lines`` and ``n_deleted`` (replacing columns of these names).  Null texts stay null; rows
    with a null id stay as they are and delete nothing elsewhere; rows that repeat
    an id are one document and don't delete each other's lines.  Ids are whole numbers.
    """
    docs = replaced(docs, "n_lines", "n_deleted") if counts else docs
    shared, paths = shared_lines(docs, doc_id, text)
    kind = "doc_id long, gone array<struct<place:long,key:long>>"

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.list_(pa.struct([("place", pa.int64()), ("key", pa.int64())]))
        for b in batches:
            out = []
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            owner, theirs, mine, key = (x.to_numpy() for x in lists.values.flatten())
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                of = dict(zip((mine[s:e] >> 32).tolist(), key[s:e].tolist(), strict=True))
                out.append([{"place": p, "key": of.get(p, of.get(p - 1))} for p in deletions(owner[s:e], theirs[s:e], mine[s:e], min_words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, target)], names=["doc_id", "gone"])

    gone, _ = materialise_alone(shared.mapInArrow(plan, kind).where(F.size("gone") > 0), "deletions")
    for path in paths:
        discard(docs.sparkSession, path)
    mark, place = fresh(docs, "gone"), docs.columns.index(text)
    key = fresh(docs, "gone_id")
    joined = docs.join(gone.select(F.col("doc_id").alias(key), F.col("gone").alias(mark)), F.col(doc_id).cast("long") == F.col(key), "left").drop(key)
    extra = ["n_lines", "n_deleted"] if counts else []
    schema = docs
    for c in extra:
        schema = schema.withColumn(c, F.lit(0).cast("long"))

    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, plans = b.column(place).cast(pa.large_binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            n, gone_n = [], [0] * len(raws)
            for at, part in runs_of([raw if counts or plan else None for raw, plan in zip(raws, plans, strict=True)]):
                cut = Lines(part)
                keys, _ = cut.pairs()
                n += np.diff(cut.cuts).tolist()
                for t, raw in enumerate(part):
                    if raw is not None and plans[at + t]:
                        mine = slice(int(cut.cuts[t]), int(cut.cuts[t + 1]))
                        gone = {g["place"]: g["key"] for g in plans[at + t]}
                        raws[at + t], gone_n[at + t] = without(raw, gone, cut.start[mine] - cut.bytes_from[t], keys[mine])
            cols = [*b.columns[:-1]]
            texts = pa.array(raws, pa.large_binary()).cast(pa.large_string())
            cols[place] = texts if b.column(place).type == pa.large_string() else texts.cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols + [pa.array(n, pa.int64()), pa.array(gone_n, pa.int64())] * bool(counts), names=[*names, *extra])

    return joined.mapInArrow(apply, schema.schema)
