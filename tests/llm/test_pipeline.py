"""The corpus pipeline against each operator's own results, and with odd rows."""

from __future__ import annotations

import functools
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import langid, mixing, near_dedup
from tests.llm.conftest import CLASHES, SCHEMA, passage
from tests.llm.test_dedup import plain_groups
from tests.llm.test_maps import plain_grams, plain_rank, plain_spans


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    """The input and every stage's result, each written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), [documents]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], "").write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [f.collect() for f in out]


def test_stages(stages, documents):
    start, known, kept, clean, mixed, coded = stages
    totals: dict[str, Counter] = {}
    for r in start:
        if r.text is not None and r.lang is not None:
            totals.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    ranks = {lang: {g: i for i, g in enumerate(plain_rank(c))} for lang, c in totals.items()}
    found = {}
    for r in start:
        grams = plain_rank(plain_grams(r.text or ""))
        found[r.doc_id] = max((1 - sum(abs(p[g] - i) if g in p else langid.SIZE for i, g in enumerate(grams)) / (len(grams) * langid.SIZE) for p in ranks.values()), default=0) if grams else -1
    assert {r.doc_id for r in known} == {i for i, score in found.items() if score >= corpus_pipeline.LEAST_SCORE}
    groups = plain_groups([(r.doc_id, r.text) for r in known], 80)
    assert {r.doc_id for r in kept} == {least for _, least in groups}
    assert {tuple(r) for r in kept} <= {tuple(r) for r in known}
    before = {r.doc_id: r.text for r in kept}
    for r in clean:
        assert (r.text == before[r.doc_id]) == (not plain_spans(before[r.doc_id])) and r.n_chars == len(r.text)
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, clean))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = sorted(coded, key=lambda r: r.position)
    assert [r.doc_id for r in coded] == [r.doc_id for r in mixed]
    for r, doc in zip(coded, mixed):
        assert r.ids == library.encode(doc.text, add_special_tokens=False).ids
    assert all(f.columns == documents.columns for f in [documents])
    assert struct.calcsize("<I") == 4 and near_dedup.bands_for(80) > near_dedup.bands_for(85)


def test_odd_rows(spark, odd, empty, tmp_path):
    for name, start in (("odd", odd), ("empty", empty)):
        docs = start
        for stage, run in corpus_pipeline.STAGES:
            run(spark, docs, "").write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            if stage != "bpe_encode":
                assert docs.columns == start.columns and {*CLASHES} < {*docs.columns}
            if name == "odd" and stage == "minhash_dedup":
                # Of rows 4, 5 and 5 again, one stays; the null id's text is its own group.
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 4, 6, 7, 9, 10, 11]
        assert docs.count() == (7 if name == "odd" else 0)


def test_large_scripts_are_kept(spark):
    # 3,500 characters by a flat law of frequency: most pairs of a clean text are in no profile of 300.
    rng = np.random.default_rng(5)
    weights = 1 / (np.arange(3500) + 20)
    weights /= weights.sum()
    texts = ["".join(chr(0x4E00 + c) for c in rng.choice(3500, 150, p=weights)) for _ in range(400)]
    profiles = langid.profiles(langid.learn(spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string")))[0]
    assert np.mean([score < corpus_pipeline.LEAST_SCORE for _, score in profiles.predict(texts)]) > 0.5
    docs = spark.createDataFrame([(i, t, "zh", "a", 150) for i, t in enumerate(texts)] + [(-1, "#!1", "zh", "a", 3)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [*range(400)]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, "").count() == 401


def test_dedup_decides_by_row(spark):
    copy = passage(21) + " more"
    rows = [
        (1, passage(21)), (None, copy), (None, passage(22)), (None, passage(23)), (None, passage(23) + " more"),
        (7, passage(21)), (7, passage(24)), (8, passage(25)), (8, passage(25) + " more"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.minhash_dedup(spark, docs, "").collect()]
    assert len(kept) == 5 and {(1, passage(21)), (None, passage(22)), (7, passage(24))} < {*kept}
    assert sum(t.startswith(passage(23)) for _, t in kept) == sum(t.startswith(passage(25)) for _, t in kept) == 1


def test_mix_is_kept_over_several_files(spark, monkeypatch, tmp_path):
    plain = mixing.mix_sources
    docs = spark.createDataFrame([(i, passage(i), "en", "ab"[i % 2], 1) for i in range(200)], SCHEMA)
    places = []
    for turn, targets in enumerate(({"a": 1, "b": 1}, {"a": 9, "b": 1})):
        monkeypatch.setattr(mixing, "mix_sources", functools.partial(plain, targets=targets))
        mixed = corpus_pipeline.mix_sources(spark, docs, "")
        mixed.write.option("maxRecordsPerFile", 23).parquet(f"{tmp_path}/{turn}")
        files = spark.read.parquet(f"{tmp_path}/{turn}")
        assert len(files.inputFiles()) > 5
        coded = corpus_pipeline.bpe_encode(spark, files, "")
        place = {r.position: r.doc_id for r in coded.collect()}
        line = [r.doc_id for r in plain(docs, targets=targets).orderBy("position").collect()]
        assert [place[i] for i in range(200)] == line
        places.append(place)
    assert places[0] != places[1]


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, rows)) == sorted(map(str, stages[-1]))
