"""The pipeline against its stages' plain versions."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from loamwork.llm.language_id import Compressors, train
from tests.llm.test_operators import SPACES, near_copies, plain_components, plain_hits, words


def test_run(spark, tmp_path):
    item = words(14, 77, 10**6)
    texts = [words(60, i, 10**6) for i in range(40)] + near_copies(3, [60, 90], 6, 2) + [words(30, 900, 10**6) + " " + item, None, "", "1 2 3", "write to a@b.com " + words(40, 901, 10**6)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = Compressors(train(docs))
    kept = [(i, t) for i, t in enumerate(texts) if model.predict(t)[2]]
    group, _ = plain_components(kept)
    kept = [(i, t) for i, t in kept if group[i] == i and not plain_hits(t, [(1, item)])[1]]
    want = {i: len(re.findall(SPACES, t.replace("a@b.com", "[email]"))) for i, t in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r["size"] for r in got} == want and len(got) == len(want)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


def test_stages_on_odd_tables(spark, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows, missing ids, clashing columns and an empty table."""
    item = words(14, 77, 10**6)
    spark.createDataFrame([(1, item), (None, "x y"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = words(60, 1, 10**6)
    rows = [(1, own, "en", "a", 0), (1, own, "en", "a", 0), (None, own, None, None, None), (2, None, None, "b", None), (2, None, None, "b", None), (3, "", "de", None, 0), (4, words(40_000, 3, 10**6), "en", "a", 0), (5, f"{words(20, 4, 10**6)} {item}", "de", "a", 0), (6, f"mail a@b.com {words(30, 5, 10**6)}", "de", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "key", "node", "n_words", "spans", "hit_runs", "score", "label", "shard", "n"):
        docs = docs.withColumn(name, F.lit("own"))
    want = {"ngram_join": [1, 2, 2, 3, 4, 5, 6], "decontamination": [1, 1, 2, 2, 3, 4, 6, None], "pii": [1, 1, 2, 2, 3, 4, 5, 6, None]}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "mixing":
            assert got.count() == len(rows) and {r["size"] for r in got.filter("doc_id in (2, 3)").collect()} == {0}
        else:
            out = got.collect()
            assert got.columns == docs.columns and all(r.key == "own" for r in out)
            ids = [r.doc_id for r in out]
            assert 2 not in ids and 3 not in ids if name == "language_id" else sorted(ids, key=str) == sorted(want[name], key=str), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
