"""The corpus pipeline, stage by stage, against plain versions; the queries and their DuckDB SQL."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from voxelith.llm import decontam, packing, simhash
from voxelith.llm.common import read
from voxelith.llm.queries import ORACLES, QUERIES, tokenizer_path

from .test_text_operators import brute_components, brute_dedup, brute_hits, plain_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_drops_few_clean_documents(spark, stages):
    _, before, after = stages[0]
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, SF, "labels").collect()}
    left = rows(after)
    assert 0 < len(left) <= before.count() and all(r == left[i] for i, r in rows(before).items() if i in left)
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in left for i in clean) > 0.9 * len(clean)


def test_line_dedup(stages):
    _, before, after = stages[1]
    b, a = rows(before), rows(after)
    order = sorted(b)
    assert [a[i]["text"] for i in order] == brute_dedup([b[i]["text"] for i in order])


def test_simhash_keeps_one_of_each_group(stages):
    _, before, after = stages[2]
    b = rows(before)
    order = sorted(b)
    want = {order[r] for r in brute_components([plain_simhash(b[i]["text"], 5) for i in order])}
    assert set(rows(after)) == want


def test_decontamination(spark, stages):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    assert set(rows(after)) == {i for i, r in rows(before).items() if not brute_hits(r["text"], items)[1]}


def test_packing_holds_every_token(stages):
    _, before, after = stages[4]
    total = {i: len(packing.encoder(tokenizer_path()).ids(r["text"])) + 1 for i, r in rows(before).items()}
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][2])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = c.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    order = sorted(names)
    assert sorted(df.columns) == order
    assert sorted(str([r[x] for x in order]) for r in df.collect()) == sorted(str([r[names.index(x)] for x in order]) for r in want)


def test_all_queries_are_registered():
    known = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in known if q.startswith("op") and q[2:3].isdigit()}
    assert "pipeline" in known and set(__spark_entry__.oracle_sql()) <= set(known)
    assert simhash.BLOCKS - 2 >= 2 and decontam.digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
