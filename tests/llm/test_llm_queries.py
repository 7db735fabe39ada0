"""The registered queries over whole small tables, and the pipeline's stages."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from skyquery.llm import queries as llm
from skyquery.llm.queries import table

NAMES = sorted(llm.queries())


def test_all_are_registered():
    assert [n.split("_")[0] for n in sorted(NAMES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert {*NAMES, "pipeline"} <= set(__spark_entry__.queries())


def test_chat_agrees_with_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(llm.oracle_sql()["op10_chat_formatting"]).df()
    got = llm.queries()["op10_chat_formatting"](spark, data).toPandas()
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_substring_digests(spark, data):
    rows = {r.doc_id: r for r in llm.queries()["op8_substring_dedup"](spark, data).collect()}
    seen = set()
    for d in sorted(table(spark, data, "documents").collect(), key=lambda r: r.doc_id):
        w = (d.text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[d.doc_id].n_words, rows[d.doc_id].n_removed, rows[d.doc_id].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_token_totals(spark, data):
    """Every group of the whole table, with the tokenizer itself."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(llm.tokenizer_path())
    want = defaultdict(lambda: [0, 0])
    for d in table(spark, data, "documents").collect():
        for version, n in (("word_bpe_49k", len(t.encode(d.text or "", add_special_tokens=False).ids)), ("characters", len(d.text or ""))):
            want[d.source, d.lang, version][0] += 1
            want[d.source, d.lang, version][1] += n
    got = llm.queries()["op2_token_counts"](spark, data).collect()
    assert {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in got} == dict(want) and len(got) == len(want)


def test_near_duplicate_classes(spark, data):
    from test_operators import brute_classes

    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    links, root = brute_classes(rows)
    got = {r.doc_id: r for r in llm.queries()["op3_ngram_jaccard_join"](spark, data).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: len(v) for k, v in links.items()} and {k: r.class_id for k, r in got.items()} == root


def test_secret_digests(spark, data):
    from test_operators import brute_secrets

    got = {r.doc_id: r for r in llm.queries()["op5_secret_scans"](spark, data).collect()}
    for d in table(spark, data, "documents").collect():
        base = brute_secrets(d.text or "")
        assert got[d.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and {x for x in base.split(",") if x} <= set(got[d.doc_id].spans.split(","))


def test_pipeline(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{i}")
        made = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns
            sizes.append(made.count())
        else:
            assert made.select("doc_id").distinct().count() == sizes[-1]
        if i == 3:
            assert made.filter(F.col("text").rlike(r"[0-9a-f]{24,}")).count() == 0 and made.filter(F.length("text") != F.col("n_chars")).count() == 0
        docs = made
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0.7 * sizes[0]


def test_pipeline_of_odd_documents(spark, data, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns of the names that operators use, no n_chars, and an empty table."""
    docs = table(spark, data, "documents").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None, None, None, None), (-1, None, "en", "x"), (-2, "", None, None), (-3, "word " * 30000, "en", "x"), (-4, "a b", "en", "x"), (-4, "a b", "en", "x"), (-5, "my password = hunter2hunter2 and more", "en", "x")], docs.schema)
    frame = docs.unionByName(odd)
    for name in ("score", "predicted", "base_spans", "secret_spans", "class_id", "kept", "_spans", "item_id", "a.b"):
        frame = frame.withColumn(name, F.lit(name))
    frame.write.parquet(f"{tmp_path}/odd")
    given = spark.read.parquet(f"{tmp_path}/odd")
    before = given
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, before, data), stage(spark, given.limit(0), data)
        assert none.count() == 0
        if i < 4:
            assert out.columns == given.columns == none.columns
            out.write.parquet(f"{tmp_path}/{i}")
            after = spark.read.parquet(f"{tmp_path}/{i}")
            assert after.count() <= before.count() and after.filter("score <> 'score' or `a.b` <> 'a.b'").count() == 0
            before = after
        else:
            assert out.filter("piece = 0").count() == before.count()
    assert before.filter("doc_id = -5").filter(F.col("text").contains("hunter2")).count() == 0


def test_pipeline_leaves_its_last_tables_only(spark, data):
    import os

    from skyquery.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:") + "/skyquery"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert left == ["pieces", "stage-0", "stage-1", "stage-2", "stage-3"]


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op7_language_id", "op6_embedding_near_dedup"])
def test_one_row_each(spark, data, name):
    of = "embeddings" if name.startswith("op6") else "documents"
    key = "vec_id" if of == "embeddings" else "doc_id"
    got = llm.queries()[name](spark, data)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in table(spark, data, of).select(key).collect())
