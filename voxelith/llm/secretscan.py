"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed: its blob is the SHA-256 of
the text.  The ledger, a Parquet table that only grows, holds each scanned blob
with the rule versions it was scanned under and what they found.  A run scans
only pairs of blob and rule version that the ledger lacks (a text that occurs a
million times is scanned once, a rule that changed is rerun alone) and joins
findings back to all paths.  Texts whose blob the ledger already has are hashed, not moved.

Spans come from ``split`` and ``regexp_extract_all`` with one pattern: the
lengths of the parts between matches and of the matches add up to offsets in
code points.  Arrays grow by copying, so the sums are windows over one row for each
match of a text, linear in the number of matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, join_hot, materialise, replaced

#: Unseen blobs up to which their addresses (32 bytes each) are sent to the executors.
SMALL = 500_000


@dataclass(frozen=True)
class ScanRule:
    """Leftmost non-overlapping matches of a Java regular expression whose group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The look-ahead only skips places where no alternative can start.
BASE_RULES = (
    ScanRule("assign", r"""(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ScanRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    ScanRule("hex", r"[0-9a-f]{24,}", 0, 24),
)

FINDING = "array<struct<at:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob binary, scanned array<string>, findings {FINDING}"


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the UTF-8 bytes (null text: of the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


PART = "array<struct<rank:int,nth:int,gap:int,whole:int,kept:boolean>>"


def _parts(text: Column, rule: ScanRule, rank: int) -> Column:
    """Each match of one rule in order: what lies before it since the last one, its length, and whether it is kept."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    wholes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    checked = wholes if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(wholes)).alias("gap"), wholes.alias("whole"), checked.alias("checked"))
    one = lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), x["gap"].alias("gap"), x["whole"].alias("whole"), (x["checked"] >= rule.least).alias("kept"))
    return F.transform(zipped, one).cast(PART)


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[ScanRule], text: str = "text", blobs: DataFrame | None = None) -> DataFrame:
    """``(blob, text, seen)``: each blob with a rule version that it was not scanned under, once.

    ``blobs(blob)`` are the addresses of the versions, if they are known already.  Where at most ``SMALL`` blobs
    are unseen, their addresses are broadcast, so that no other text is shuffled; more are joined.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = versions.select(blob_of(F.col(text)).alias("blob"), content.alias("text"))
    none = F.array().cast("array<string>")
    if ledger is None:
        return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", none)
    seen = ledger.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    found = (texts if blobs is None else blobs).select("blob").distinct().join(seen, "blob", "left")
    todo = found.withColumn("seen", F.coalesce("seen", none)).where(F.size(F.array_except(keys, F.col("seen"))) > 0)
    todo, _ = materialise(todo, "unseen")
    few = F.broadcast(todo) if todo.count() <= SMALL else todo
    return texts.join(few.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(few, "blob")


def scan_blobs(blobs: DataFrame, rules: Sequence[ScanRule]) -> DataFrame:
    """``(blob, scanned, findings)`` for blobs with text and the rule versions seen before."""
    todo = [~F.array_contains("seen", r.key) for r in rules]
    hits = [F.when(t & F.col("text").rlike(r.pattern), _parts(F.col("text"), r, i)).otherwise(F.array().cast(PART)) for i, (t, r) in enumerate(zip(todo, rules, strict=True))]
    scanned = F.array_except(F.array(*(F.lit(r.key) for r in rules)), F.col("seen"))
    found, _ = materialise(blobs.select("blob", scanned.alias("scanned"), F.concat(*hits).alias("parts")), "matches")
    clean = found.where(F.size("parts") == 0).select("blob", "scanned", F.array().cast(FINDING).alias("findings"))
    end = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("blob", "rank").orderBy("nth")).cast("int")
    rows = found.select("blob", "scanned", F.inline("parts")).withColumn("end", end)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rank") + 1)
    one = F.when(F.col("kept"), F.struct((F.col("end") - F.col("whole")).alias("at"), "rank", kind.alias("kind"), "end"))
    some = rows.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.array_sort(F.collect_list(one)).cast(FINDING).alias("findings"))
    return clean.unionByName(some)


def scan(versions: DataFrame, ledger_path: str, rules: Sequence[ScanRule] = BASE_RULES, text: str = "text") -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with all versions and return their findings.

    ``versions`` is any table with a text column: one row for each path and
    historical version.  Returns its other columns and ``findings``, sorted by
    start, then rule, of the current rule versions.  Null and empty texts have
    none; repeated rows come back repeated; a column named ``findings`` is replaced.  A run that dies leaves the ledger as
    it was or complete for its blobs; blobs scanned twice by two runs at once
    count once.
    """
    spark = versions.sparkSession
    if len({r.kind for r in rules}) != len(rules):
        raise ValueError("one rule for each kind")
    kind = T._parse_datatype_string(LEDGER)
    marked = addressed(versions, text)
    known = spark.read.schema(kind).parquet(ledger_path) if _exists(spark, ledger_path) else None
    scan_blobs(unseen(versions, known, rules, text, marked.select(F.col(marked.columns[-1]).alias("blob"))), rules).write.mode("append").parquet(ledger_path)
    return findings(marked, spark.read.schema(kind).parquet(ledger_path), rules)


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """A stored table of the versions' columns without text and ``findings``, and last their blob."""
    keep = [c for c in replaced(versions, "findings").columns if c != text]
    return materialise(versions.select(*(F.col(f"`{c}`") for c in keep), blob_of(F.col(text)).alias(fresh(versions, "blob"))), "addressed")[0]


def findings(marked: DataFrame, ledger: DataFrame, rules: Sequence[ScanRule] = BASE_RULES) -> DataFrame:
    """Join the ledger's findings under the given rule versions back to all paths of an ``addressed`` table."""
    *keep, key = marked.columns
    current = ledger.select("blob", "scanned", F.explode("findings").alias("f"))
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, str(r.version))))[F.col("f.kind")]
    mine = F.array_contains("scanned", F.concat(F.col("f.kind"), F.lit("@"), version))
    current = current.where(mine).groupBy(F.col("blob").alias(key)).agg(F.array_sort(F.collect_set("f")).alias("findings"))
    joined = join_hot(marked, current, key)
    return joined.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rendered(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["at"].cast("string"), f["end"].cast("string"))), ",")
