"""The pipeline's stages on a small corpus, against the operators' brute-force versions."""

import os

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import catalog, quality
from tests.llm.test_dedup import line_brute
from tests.llm.util import SCHEMA, corpus, jaccard_classes

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicate removal", "benchmark decontamination", "piece encoding"]
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.REGISTRY.queries) == list(range(1, 11))


def test_stages(spark, tmp_path):
    import sentencepiece as spm

    name = lambda stem, n: " ".join(stem + chr(97 + i // 8) + chr(97 + i % 8) for i in range(n))
    rows = [(d + 1000 * (i >= 120), *rest) for i, (d, *rest) in enumerate(corpus(8, 120))] + [(300 + i, f"{name('w', 60)} {name(f'tail{chr(97 + i)}', 6)}", "en", "s", 7) for i in range(5)]
    leak = name("bench", 30)
    rows += [(400, f"{name('u', 60)} {leak}", "en", "s", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("__bad", F.lit("extra"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    verdict = {r.doc_id: r.kept for r in quality.judge(at).collect()}
    good = stages["quality rules"](spark, at, str(tmp_path))
    assert sorted(r.doc_id for r in good.collect()) == sorted(d for d, k in verdict.items() if k) and good.columns == at.columns
    kept = [tuple(r)[:5] for r in good.collect()]
    lined = stages["line dedup"](spark, good, str(tmp_path))
    lines = line_brute(kept)
    assert {r.doc_id: r.text for r in lined.collect()} == {d: t for d, t in lines.items() if t.strip()} and lined.columns == at.columns
    assert all(r.n_chars == len(r.text) or r.text == dict((k[0], k[1]) for k in kept)[r.doc_id] for r in lined.collect())
    now = [tuple(r)[:5] for r in lined.collect()]
    near = stages["near-duplicate removal"](spark, lined, str(tmp_path))
    assert {r.doc_id for r in near.collect()} == {c for c, _ in jaccard_classes(now).values()} and near.columns == at.columns
    clean = stages["benchmark decontamination"](spark, near, str(tmp_path))
    assert {r.doc_id for r in near.collect()} - {r.doc_id for r in clean.collect()} == {400} and clean.columns == at.columns
    out = stages["piece encoding"](spark, clean, str(tmp_path)).collect()
    sp = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.n_tokens for r in out} == {d: len(sp.encode(t, add_bos=True, add_eos=True)) for d, t in texts.items()}
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.ids_sha256) for r in out}


def test_stages_take_nulls_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None)] * 2):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            assert len(stage(spark, docs, str(tmp_path)).collect()) in (0, len(rows)), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.REGISTRY.oracles))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.sql("SET threads = 2")
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: None if v is None or v != v else round(v, 5) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else v
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    assert rows(catalog.REGISTRY.queries[name](spark, SF).toPandas()) == rows(con.sql(catalog.REGISTRY.oracles[name]).df())


def test_staged_tables_can_be_dropped(spark):
    from gridloom.llm.common import drop_staged, staged

    df = staged(spark.range(3), "test")
    assert df.count() == 3 and drop_staged(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert drop_staged(spark) == 0
