"""The pipeline's stages against plain versions of their decisions."""

import gc
import time
import weakref

import numpy as np

import corpus_pipeline
from logweave.llm import common, langid, minhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == columns and docs.dtypes == kinds
        if name == "near_dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept and docs.count() == len(kept)
        if name == "secrets":
            assert docs.count() == before.count() and docs.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0 and docs.count() > 0
    assert seen["bpe"].count() == seen["mixing"].count()


def test_odd_rows_survive(spark):
    rows = [(1, "the same words as the other row has", "en", "a", 1), (1, "the same words as the other row has", "en", "a", 1), (None, "no id is here at all", "fr", None, None), (2, None, None, None, None), (3, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stays = {"language": 3, "near_dedup": 4, "secrets": 5, "bpe": 5}  # language rejects the null and the empty text
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        found = stage(spark, docs, SF).collect()
        if name == "mixing":
            assert all(r.text for r in found if r.doc_id not in (2, 3)) and len(found) <= 10
        else:
            assert len(found) == stays[name]
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None"]


def test_rejected_languages(spark):
    """The least score that the language stage asks for costs no document that has words to speak of."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).select("doc_id").collect()}
    gone = [r.text or "" for r in docs.collect() if r.doc_id not in kept]
    assert all(sum(c.isalpha() for c in text) < 20 for text in gone)


def test_rows_that_share_an_id_stay_unless_they_are_near(spark):
    """Both texts of an id survive the dedup stage, and a near copy of either goes."""
    one, two = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, two + " tail"), (3, one + " tail"), (1, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, one), (1, two)] and kept.columns == docs.columns


def test_what_a_long_batch_uses_is_not_idle(monkeypatch):
    monkeypatch.setattr(common, "IDLE", 0.1)
    first = common.held("first", list)
    began = time.monotonic()
    second = common.held("second", list)
    time.sleep(0.2)
    common.used_since(began)
    common.drop_idle()
    assert common.held("second", list) is second and common.held("first", list) is not first


def test_workers_drop_what_earlier_stages_held(monkeypatch):
    """A Python worker runs tasks of all stages; memos of a stage go when those of the next one are made."""
    monkeypatch.setattr(common, "IDLE", 0.0, raising=False)
    model = langid.LanguageModel(["a", "b"], {" x ": 0}, np.zeros((2, 2)), {n: np.array([True, True]) for n in [*langid.SCRIPTS, "other"]})
    language = langid.labeller(model)
    language.predict(["x yz"])
    held = weakref.ref(language)
    del language
    time.sleep(0.01)
    minhash.shingle_set("x yz x")
    gc.collect()
    assert held() is None
