"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_models import STOCK, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = [(k, t, lang, "x", 1) for k, t, lang, _ in corpus()]
    long = " ".join(random.Random(9).choices(STOCK["en"].split(), k=200))
    planted = [(1000, long, "en", "x", 1), (1001, long, "en", "y", 1), (1002, long + " of", "en", "x", 1), (1003, "1234 5678 !!", None, "x", 1), (1004, None, None, None, None)]
    spark.createDataFrame(clean + planted, "doc_id long, text string, lang string, source string, score long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, _, _, t in corpus()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        docs = after
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic = {k for k, _, _, t in corpus() if t}
    assert len(toxic - kept[0] | toxic & kept[1]) < 0.1 * len(toxic)
    assert len(kept[0] - toxic - kept[1]) <= 3
    assert not {1003, 1004} & kept[2]
    assert {1000, 1001, 1002} & kept[3] == {1000}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == kept[3]


def test_clashing_columns_and_empty_tables(spark, folder):
    extra = "predicted int, lang_pred string, score string, _score int, row int, component_id long, n long, hash long, label string"
    docs = spark.createDataFrame([(1, "the of and in to", "en", *[7 if "string" not in c else "x" for c in extra.split(", ")]), (2, None, None, *[None] * 9)], f"doc_id long, text string, lang string, {extra}")
    for docs in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, folder)
            assert got.columns == docs.columns
            rows = {r["doc_id"]: r for r in got.collect()}
            assert all(rows[k] == r for k, r in {r["doc_id"]: r for r in docs.collect()}.items() if k in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_registered():
    assert sum(name.startswith("op") or name == "pipeline" for name in __spark_entry__.queries()) == 14


def test_run_against_plain_stages(spark, folder):
    """All rows of run(): what the two classifiers keep, one of each group of near copies by all pairs, and every id of
    what is left, as the tokenizers library gives them, in one place of a gapless sequence."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tests.llm.test_ngram_join import brute
    from veilframe.llm import language, toxicity
    from veilframe.llm.common import tokenizer_path

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fine = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).where("predicted = 0").collect()}
    left = docs.where(docs.doc_id.isin(list(fine)))
    told = {r["doc_id"] for r in language.predict(left, language.fit(left)).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in told}
    kept = {k for k, _, least in brute(sorted(texts.items())) if k == least}
    library, want = Tokenizer.from_file(tokenizer_path()), {}
    library.no_truncation(), library.no_padding()
    for k in kept:
        want[k] = np.array([*library.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == kept and len(kept) < len(texts)
    for k, ids in want.items():
        own = sorted((r for r in pieces if r["doc_id"] == k), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == np.cumsum([0, *(n for _, n in w)])[:-1].tolist() and sum(n for _, n in w) <= 2048
