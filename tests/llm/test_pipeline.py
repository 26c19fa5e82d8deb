"""The pipeline: each stage on its own input, hard rows, and the columns."""

from __future__ import annotations

import sentencepiece

import corpus_pipeline
from plaintide.llm.decontamination import plain

from .conftest import PIECES, TABLES, hard_rows, rows
from .test_duplicates import brute_components
from .test_personal import base

STAGES = dict(corpus_pipeline.STAGES)
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs):
    before = {r.doc_id: r for r in docs.collect()}
    kept = STAGES["language_id"](spark, docs, TABLES)
    assert kept.columns == DOCUMENTS
    assert {r.doc_id for r in kept.collect()} == {i for i, r in before.items() if any(c.isalpha() for c in r.text)}

    groups = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
    kept = STAGES["ngram_join"](spark, docs, TABLES)
    assert kept.columns == DOCUMENTS
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in groups.values()})

    items = [bytes(plain(r.text)[0]) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    kept = STAGES["decontamination"](spark, docs, TABLES)
    assert kept.columns == DOCUMENTS
    assert {r.doc_id for r in kept.collect()} == {i for i, r in before.items() if not any(x in bytes(plain(r.text)[0]) for x in items)}

    clean = STAGES["personal_data"](spark, docs, TABLES)
    assert clean.columns == DOCUMENTS
    after = {r.doc_id: r for r in clean.collect()}
    assert after.keys() == before.keys()
    for i, r in before.items():
        assert not base(after[i].text) and (base(r.text) or after[i].text == r.text or "[" in after[i].text)
        assert after[i].n_chars == (r.n_chars if after[i].text == r.text else len(after[i].text))

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in STAGES["sentence_pieces"](spark, docs, TABLES).collect():
        assert r.ids == library.encode(r.text) and r.text == before[r.doc_id].text


def test_hard_rows_pass_every_stage(spark, hard, nothing):
    want = {"language_id": 9, "decontamination": 13, "personal_data": 13, "sentence_pieces": 13}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, hard, TABLES)
        assert found.columns[:5] == DOCUMENTS
        assert found.count() == want.get(name, found.count())
        assert stage(spark, nothing, TABLES).collect() == []
    left = rows(STAGES["ngram_join"](spark, hard, TABLES).select("doc_id"))
    # 1, 1 and 10 are one text; of the texts linked with them the smallest id stays.
    assert [r[0] for r in left].count(1) == 1 and (10,) not in left and {(2,), (3,), (4,)} <= set(left)
    assert len(hard_rows()) == 13


def test_run(spark):
    found = corpus_pipeline.run(spark, TABLES)
    assert found.columns == [*DOCUMENTS, "n_pieces", "ids"] and 0 < found.count() <= 200


def test_row_numbers_hold_when_scans_are_cut_otherwise(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "docs")
    given = [(None, f"own {i} {i * 7919} {i * 31337} text {i % 5}", "en", "a", i) for i in range(400)] * 2
    spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(8).write.parquet(table)
    operator = corpus_pipeline.ngram_join.shingle_components
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def then_fewer_cores(*args, **options):
        groups, links = operator(*args, **options)
        groups = corpus_pipeline.saved(groups, "groups")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        return groups, links

    monkeypatch.setattr(corpus_pipeline.ngram_join, "shingle_components", then_fewer_cores)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "4m")
        kept = STAGES["ngram_join"](spark, spark.read.parquet(table), TABLES).select("text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.text for r in kept) == sorted({g[1] for g in given})
