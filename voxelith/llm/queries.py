"""The operators' queries over whole tables, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, linededup, packing, quality, secretscan, simhash, topk, toxicity, urlfilter
from .common import doc_crc, read, shared_dir

RULES = (
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
)
ROUNDS, STAY, THRESHOLD = 10, 0.15, 0.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op2_urlgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(read(spark, sf_dir, "pages"), RULES, rounds=ROUNDS, stay=STAY, threshold=THRESHOLD)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, lambda c: doc_crc(c) % 3 != 1)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topk.topk(rows.where(F.col("vec_id") % 100 == 0), rows, k=10)


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contamination(docs, read(spark, sf_dir, "benchmark"), into="c")
    items = F.array_join("c.items", ",")
    return out.select("doc_id", F.col("c.n_words").alias("n_words"), decontam.n_hit("c").alias("n_hit"), F.size("c.items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("c.runs") > 0).alias("contaminated"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # one ledger for each corpus: a second run over it scans what is new
    corpus = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    out = secretscan.scan(docs, f"{shared_dir(spark)}/ledgers/{corpus}")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secretscan.rendered(F.col("findings"))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), lambda c: doc_crc(c) % 3 != 1)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), lambda c: doc_crc(c) % 5 != 0)
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_urlgraph, op3_packing, op4_langid, op5_topk, op6_linededup, op7_decontam, op8_secrets, op9_toxicity, op10_quality)}

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host_sql(url: str) -> str:
    return rf"coalesce(translate(regexp_extract({url}, '^(?s:.*?)://([^/?#]*)', 1), {_LOW}), '')"


def _op2_sql() -> str:
    text = verdict = "NULL::VARCHAR"
    for r in sorted(RULES, key=lambda r: (len(r.text), r.text)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        text, verdict = f"CASE WHEN {fits} THEN '{r.text}' ELSE {text} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\s>]+)"
    parts = [
        f"p AS (SELECT page_id, html, {_host_sql('url')} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"m AS (SELECT *, {text} AS rule, {verdict} AS rule_verdict FROM p)",
        f"l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM m)",
        f"l2 AS (SELECT src, {_host_sql('''CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END''')} AS dst FROM l)",
        "e0 AS (SELECT src, dst, count(*) AS n FROM l2 WHERE dst <> '' AND src <> '' AND src <> dst GROUP BY 1, 2)",
        "e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS fw, n / sum(n) OVER (PARTITION BY dst) AS bw FROM e0)",
        "s0 AS (SELECT host, count(*) FILTER (rule_verdict = 'allow') / count(*) AS t0, count(*) FILTER (rule_verdict = 'block') / count(*) AS d0 FROM m WHERE host <> '' GROUP BY 1 UNION ALL SELECT src, 0, 0 FROM e UNION ALL SELECT dst, 0, 0 FROM e)",
        "r0 AS MATERIALIZED (SELECT host, max(t0) AS t0, max(d0) AS d0, host IN (SELECT src FROM e) AS has_out, host IN (SELECT dst FROM e) AS has_in, max(t0) AS t, 1.0::DOUBLE AS u, max(d0) AS d, 1.0::DOUBLE AS v, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS u1, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS v1 FROM s0 GROUP BY host)",
    ]
    for i in range(ROUNDS):
        again = lambda lost, total: f"({STAY} + CASE WHEN {total} > 0 THEN {1 - STAY} * coalesce({lost}, 0) / {total} ELSE 0 END)"
        parts.append(f"""m{i} AS MATERIALIZED (SELECT sum(t) FILTER (NOT has_out) AS lt, sum(u) FILTER (NOT has_out) AS lu, sum(d) FILTER (NOT has_in) AS ld,
            sum(v) FILTER (NOT has_in) AS lv, sum(t0) AS ts, sum(d0) AS ds, count(*) AS n FROM r{i})""")
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT host, t0, d0, has_out, has_in,
            {again("lt", "ts")} * t0 + {1 - STAY} * coalesce(f1, 0) AS t, {again("lu", "n")} + {1 - STAY} * coalesce(f2, 0) AS u,
            {again("ld", "ds")} * d0 + {1 - STAY} * coalesce(b1, 0) AS d, {again("lv", "n")} + {1 - STAY} * coalesce(b2, 0) AS v,
            coalesce(f1, 0) AS t1, coalesce(f2, 0) AS u1, coalesce(b1, 0) AS d1, coalesce(b2, 0) AS v1
            FROM r{i} CROSS JOIN m{i}
            LEFT JOIN (SELECT dst AS host, sum(fw * t) AS f1, sum(fw * u) AS f2 FROM e JOIN r{i} ON host = src GROUP BY dst) USING (host)
            LEFT JOIN (SELECT src AS host, sum(bw * d) AS b1, sum(bw * v) AS b2 FROM e JOIN r{i} ON host = dst GROUP BY src) USING (host))""")
    share = lambda seed, part, whole: f"greatest({seed}, least(1, CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0 END))"
    parts.append(f"r AS (SELECT host, {share('t0', 't1', 'u1')} AS trust, {share('d0', 'd1', 'v1')} AS distrust FROM r{ROUNDS})")
    low = f"round(coalesce(distrust, 0) - coalesce(trust, 0), 9) >= {THRESHOLD}"
    return f"WITH {', '.join(parts)} SELECT page_id, m.host, path, rule, coalesce(rule_verdict, CASE WHEN {low} THEN 'block' ELSE 'allow' END) AS verdict FROM m LEFT JOIN r ON r.host = m.host"


_WORDS = r"regexp_extract_all(translate(text, " + _LOW + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_urlgraph": _op2_sql(),
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op7_decontam": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
        b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
        bl AS (SELECT item_id, ws, least(10, len(ws)) AS l FROM b WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i : i + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS i FROM bl)),
        dw AS (SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l)),
        m AS (SELECT doc_id, item_id, i, dw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
        h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS w FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}


def _op8_sql() -> str:
    either = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
    assign = f"({'|'.join(either(k) for k in ('password', 'passwd', 'secret', 'token', 'api_?key'))})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, 2, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24)]
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {n} AS k, '{kind}' AS kind, a, a + len(w) AS b FROM (
              SELECT doc_id, unnest(wholes) AS w, unnest(checked) AS c,
                     unnest(list_transform(range(1, len(wholes) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(wholes[1 : i - 1], lambda g: len(g))), 0)))::BIGINT AS a
              FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS wholes, regexp_extract_all(t, '{pattern}', {group}) AS checked FROM d)
            ) WHERE len(c) >= {least}"""
        for n, (kind, pattern, group, least) in enumerate(kinds)
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
        s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""


ORACLES["op8_secrets"] = _op8_sql()
