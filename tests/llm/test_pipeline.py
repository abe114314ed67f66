"""The pipeline, stage by stage, against plain versions."""

import hashlib
from array import array

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from loomtable.llm import queries
from test_operators import ALNUM, docs, groups, leaks

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert {"pipeline", *(n for n, *_ in queries.NAMES)} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = df.columns, {r.doc_id: r.text for r in df.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, SF).persist()
        rows = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
        if name == "quality":
            good = [d for d in kept if labels.get(d) == 1]
            assert sum(d in after for d in good) >= 0.97 * len(good)
            assert all(after[d] == kept[d] for d in after)
        elif name == "near_duplicates":
            assert set(after) == {d for d, n, c in groups(sorted(kept.items()), 5, 80, ALNUM) if n == 0 or d == c}
        elif name == "decontamination":
            assert set(after) == {d for d, _, n, *_ in leaks(kept.items(), bench) if n == 0}
        elif name == "secrets":
            assert set(after) == set(kept)
            assert all(a == kept[d] or "[SECRET]" in a for d, a in after.items())
        else:
            for r in rows:
                ids = lib.encode(kept[r.doc_id] or "", add_special_tokens=False).ids
                assert (r.n_tokens, r.ids_sha256, r.token_ids, r.text) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), ids, kept[r.doc_id])
                assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        df, kept = out, after
    whole = {r.doc_id: (r.token_ids, r.lang) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r.doc_id: (r.token_ids, r.lang) for r in rows}


def test_stages_take_awkward_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "Some words that stand here for no one at all."), (3, "Some words that stand here for no one at all."), (4, "Other words " * 5000)]
    for df in (docs(spark, rows), docs(spark, rows).filter(F.lit(False))):
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
