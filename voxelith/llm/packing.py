"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups.

Documents are tokenised where they lie and cut into pieces of at most
``capacity`` tokens (only documents longer than a sequence are cut).  Only the
pieces' lengths travel: they are dealt at random into groups of about
``group_size`` pieces, and each group is packed on its own by first-fit
decreasing.  A tournament tree over the bins' free room finds the first bin
that a piece fits in O(log bins).  Groups have the same expected size at every
scale, so memory per task is bounded, and no key (not even a repeated doc_id)
can gather pieces: the group is drawn from the row's place, not its contents.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

EOS = 1


#: Characters of white space in a row up to which the fast encoder is used.
SPACES = 50_000


class Encoder:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE tokenizer file.

    ``tiktoken`` runs the same file about six times as fast and gives the same ids (a test holds them
    against each other).  Its pattern engine stops at about a million white-space characters in a row,
    so texts with over ``2 * SPACES`` of them in a row go through ``tokenizers`` itself.  Special tokens
    of the file are recognised in texts, as ``tokenizers`` does by default.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        to_byte = {chr(b): b for b in plain}
        to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.exact = Tokenizer.from_file(path)
        self.special = tuple(special)

    def ids(self, text: str) -> list[int]:
        if long_space(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        if any(x in text for x in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


def long_space(text: str) -> bool:
    """Whether some aligned ``SPACES`` characters are all white space: true for every run of twice as many."""
    return any(text[i : i + SPACES].isspace() for i in range(0, len(text) - SPACES + 1, SPACES))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``: the cut documents, each ended by ``eos``.

    A null text counts as empty and gives one piece, the end token.  Repeated rows come back repeated; other
    columns of ``docs`` play no part, whatever their names.  An empty table gives no rows.
    """
    rows = docs.select(F.col(text).cast("string"), F.col(doc_id).alias("doc_id"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for b in batches:
            at, start, length, crc, total, kept = [], [], [], [], [], []
            for i, t in enumerate(b.column(0)):
                ids = np.array([*encode(t.as_py() or ""), eos], "<u4")
                for s in range(0, len(ids), capacity):
                    part = ids[s : s + capacity]
                    at.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            cols = [b.column(1).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return bounded_batches(rows).mapInArrow(run, schema)


class Tournament:
    """The largest free room below each node; leaves are bins in order of opening."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; its number, and its room before."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        before = room[node]
        room[node] = before - size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            most = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
        return leaf, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each size; the sizes must come in decreasing order."""
    tree = Tournament(len(sizes), capacity)
    return [(b, capacity - room) for b, room in map(tree.place, sizes)]


def pack(cut: DataFrame, capacity: int = 2048, group_size: int = 8192, seed: int = 42) -> DataFrame:
    """Add ``sequence_id long`` and ``offset long`` to a materialised table of pieces.

    ``cut`` must be stored (its rows keep their places when a task runs again).
    Sequence ids are unique; offsets have no gaps inside a sequence.  Equal
    lengths are ordered by (doc_id, start), so repeated rows are simply packed twice.
    """
    if "length" not in cut.columns:
        raise ValueError("pieces need a length")
    groups = max(1, -(-cut.count() // group_size))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    out = cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["start"], pdf["doc_id"].rank(method="dense"), -pdf["length"]))
        pdf = pdf.iloc[order].reset_index(drop=True)
        placed = np.array(first_fit_decreasing(pdf["length"].tolist(), capacity), np.int64).reshape(-1, 2)
        group = pdf["_group"].iloc[0]
        return pdf.drop(columns="_group").assign(sequence_id=group * (1 << 32) + placed[:, 0], offset=placed[:, 1])

    return dealt.groupBy("_group").applyInPandas(one, out)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, group_size: int = 8192, with_ids: bool = False) -> DataFrame:
    """Pack all documents; ``with_ids`` also returns each piece's token ids.

    A document of any length works (it is cut); an empty table gives no rows.
    """
    cut, _ = materialise(pieces(docs, tokenizer, doc_id, text, capacity, with_ids=with_ids), "pieces")
    return pack(cut, capacity, group_size)
