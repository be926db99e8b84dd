"""The stages of the pipeline on rows whose doc_id repeats or is null."""

import os
import time
from collections import Counter

import pytest

pytest.importorskip("factgraph.llm")
import corpus_pipeline  # noqa: E402
from factgraph.llm.common import stored  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_repeated_and_null_doc_ids(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in source.where("length(text) between 500 and 3000").orderBy("doc_id").collect()]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 30").first().text
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source.collect()]
    kinds = Counter(t for _, t, *_ in rows)
    alone = [t for t in texts if kinds[t] == 1][:4]
    row = lambda i, t: (i, t, "en", "x", len(t))
    fresh = [" ".join(f"{w[::-1]}" for w in t.split()) for t in alone]
    rows += [row(9001, fresh[0])] * 5 + [row(None, fresh[1])] * 3 + [row(9002, fresh[2]), row(9002, fresh[3])] + [row(None, leak)]
    docs, counts = spark.createDataFrame(rows, source.select(corpus_pipeline.COLUMNS).schema), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        got = docs.collect()
        counts.append(len(got))
        now = Counter((r.doc_id, r.decoded if name == "sentencepiece" else r.text) for r in got)
        if name == "language_id":
            assert (now[9001, fresh[0]], now[None, fresh[1]], now[9002, fresh[2]], now[9002, fresh[3]], now[None, leak]) == (5, 3, 1, 1, 1)
        elif name == "near_copies":
            assert (now[9001, fresh[0]], now[None, fresh[1]], now[9002, fresh[2]], now[9002, fresh[3]]) == (1, 1, 1, 1)
        else:
            ids = Counter(r.doc_id for r in got)
            assert (ids[9001], ids[9002]) == (1, 2) and ids[None] >= 1 and max(now.values()) == 1
        if name == "decontamination":
            assert not any(leak in r.text for r in got)
    assert counts == sorted(counts, reverse=True)


def test_stages_leave_no_shuffle_files(spark):
    """What a stage and the table that is written from it have shuffled goes when their queries end."""
    def shuffled():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before = shuffled()
    docs = stored(corpus_pipeline.cut_repeats(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF))
    assert docs.count() > 0
    for _ in range(100):  # files are deleted in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
