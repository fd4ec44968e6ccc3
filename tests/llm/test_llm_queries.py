"""The registered queries of the subpackage against SQL, the pipeline stage by stage."""

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from dataweft.llm import mixing, parity_join
from dataweft.llm.queries import load
from llm_rows import corpus, docs  # noqa: F401
from test_text import brute_components

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) == {"op3_source_mix", "op5_exact_topk", "op11_hard_negatives", "op12_warc", "op13_ranked_search"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr(tuple(r)) for r in cur.fetchall())
    assert want and want == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize(("name", "table"), [("op1_attention_lm", "documents"), ("op2_byte_bpe", "documents"), ("op4_token_counts", "documents"), ("op6_html_text", "pages"),
                                             ("op7_suffix_dedup", "documents"), ("op8_parity_join", "documents"), ("op10_toxicity", "documents")])
def test_query_has_a_row_for_each_input(spark, name, table):
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1)).withColumn("key", F.lit("k"))
    extra = spark.createDataFrame([(10**9, None, None, None, None, 1, "k"), (10**9 + 1, "", "en", "src0", 0, 1, "k")], source.schema)
    docs, out = source.unionByName(extra), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out[name] = (docs, docs := spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert docs.columns == source.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    before, after = out["toxicity"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    assert gone and not gone & {r.doc_id for r in labels.where("toxic = 0").collect()} and {10**9, 10**9 + 1}.isdisjoint(gone)
    before, after = out["ngram_jaccard_join"]
    heads = parity_join.components(before, 5, 80).where("doc_id = component_id")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in heads.collect())
    before, after = out["suffix_array_dedup"]
    assert before.count() == after.count() and after.where("n_chars > length(text)").count() == 0
    before, after = out["source_mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}
    before, after = out["byte_bpe"]
    assert before.count() == after.count() and after.where("n_tokens <> size(ids)").count() == 0
    decoded = after.select("doc_id", F.col("decoded_sha256").alias("h")).exceptAll(before.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")))
    assert decoded.count() == 0


def test_one_document_of_each_group_stays(spark, docs, corpus):  # noqa: F811
    """Rows without an id and texts that share one are documents too: each group keeps one row, the least."""
    near = corpus[2][1].split()
    more = [(None, corpus[2][1], "yy", *corpus[2][3:]), (None, " ".join([*near[:-1], "other"]), *corpus[2][2:]), (2, " ".join(f"w{i}" for i in range(30)), *corpus[2][2:]),
            (None, " ".join(f"v{i}" for i in range(30)), *corpus[2][2:]), (None, " ".join(f"v{i}" for i in range(30)), "zz", *corpus[2][3:])]
    rows = list(dict.fromkeys([*corpus, *more]))
    numbered = [(k, r[1]) for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]  # brute force over places instead of ids
    by_place = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    groups = {}
    for (place, _), (n, head) in zip(numbered, brute_components(numbered, 5, 80), strict=True):
        groups.setdefault((head, place if not n else None), []).append(by_place[place])
    frame = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, frame, DATA).select(*docs.columns).collect()]
    assert len(got) == len(set(got)) == len(groups)
    for members in groups.values():
        stay = [r for r in got if r in members]
        assert len(stay) == 1 and (stay[0][0] is None, stay[0][0]) == min(((r[0] is None, r[0]) for r in members), key=lambda x: (x[0], x[1] or 0))


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, DATA).count() == 0
