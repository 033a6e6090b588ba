"""Sources, sinks and streams; fake clients stand for remote services."""

import json

import pytest
from pyspark.sql import functions as F

from loamwork.operators import docs
from loamwork.sources import files, services
from loamwork.streaming import ingest

ROWS = [("rain", "soc", "A", "e", 0.9, "2020-01-01T00:00:00Z"), ("clay", "cec", "B", 'q "x"', 0.5, "2020-01-02T00:00:00Z")]


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame(ROWS, files.CLAIMS)
    files.write_jsonl(df, f"{tmp_path}/c")
    files.write_jsonl(df, f"{tmp_path}/c", append=True)
    assert files.read_jsonl(spark, f"{tmp_path}/c").count() == 4
    (tmp_path / "bad.jsonl").write_text('{"cause":"a"}\n\nnot json\n')
    assert files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl").collect()


def test_snapshot_and_release(spark, tmp_path):
    df = spark.createDataFrame(ROWS, files.CLAIMS)
    files.save_snapshot(df, f"{tmp_path}/s")
    assert sorted(files.load_snapshot(spark, f"{tmp_path}/s").collect()) == sorted(df.collect())
    df.write.parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="no snapshot"):
        files.load_snapshot(spark, f"{tmp_path}/p")
    out = files.release(df, df.select(F.col("cause").alias("value")), {"title": "t"}, f"{tmp_path}/r")
    assert out.count() >= 3 and all(len(r.sha256) == 64 for r in out.collect())


def test_obo(spark, tmp_path):
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: X:1\nname: soil\n\n[Typedef]\nid: p\nname: q\n\n[Term]\nid: X:2\nname: rain\n")
    assert sorted((r.id, r.name) for r in files.read_obo(spark, f"{tmp_path}/o.obo").collect()) == [("X:1", "soil"), ("X:2", "rain")]


def test_services(spark):
    def fetch(q, cursor):
        return {"results": [{"title": f"{q}{cursor}", "abstract_inverted_index": {"A": [0], "B": [2], "C": [4]}, "publication_year": 2020, "doi": "https://doi.org/10.1/X"}], "meta": {"next_cursor": "2" if cursor == "*" else None}}

    rows = services.paged_corpus(spark, fetch, ["q"]).collect()
    assert [(r.title, r.abstract, r.doi) for r in rows] == [("q*", "A B C", "10.1/x"), ("q2", "A B C", "10.1/x")]
    assert services.bindings(json.dumps({"results": {"bindings": [{"c": {"value": "u"}, "l": {"value": "soil"}}]}})) == [("u", "soil")]
    assert 'lcase("a\\"b")' in services.vocabulary_request('a"b')

    def ask(prompt):
        if "bad" in prompt:
            raise OSError("down")
        return '{"claims":[{"cause":"a","effect":"b","confidence":0.5}]}'

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string")
    got = services.model_answers(df, "text", ask, "p", tries=2, wait=0.0)
    assert {r.id: r.error for r in got.collect()} == {1: None, 2: "down"}
    assert docs.parse_claims(got, "answer").count() == 1
    cache = spark.createDataFrame([("x", "y")], "cache_key string, answer string")
    known, todo = services.cached_answers(df, cache, ["id", "text"])
    assert known.count() == 0 and todo.count() == 2
    cells = services.tile_cells(spark, {"a": lambda r, c: r * 10 + c}, 5, 6)
    assert cells.count() == 30 and services.window(cells, 2, 2, 3).count() == 9


def test_stream_resumes(spark, tmp_path):
    folder, out, mark = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/mark"
    folder.mkdir()
    (folder / "1.json").write_text('{"id":1,"answer":"{\\"claims\\":[{\\"cause\\":\\"a\\",\\"effect\\":\\"b\\",\\"confidence\\":0.9}]}"}\n')
    args = (spark, str(folder), "id int, answer string", lambda b: docs.parse_claims(b, "answer"), out, mark)
    ingest.stream_claims(*args)
    (folder / "2.json").write_text('{"id":2,"answer":"{\\"claims\\":[{\\"cause\\":\\"c\\",\\"effect\\":\\"d\\",\\"confidence\\":0.1}]}"}\n')
    ingest.stream_claims(*args, 0.5)
    assert [(r.id, r.cause) for r in spark.read.parquet(out).collect()] == [(1, "a")]
    done = spark.createDataFrame([(1,)], "id int")
    assert [r.id for r in ingest.resume(spark.createDataFrame([(1,), (2,)], "id int"), done, "id").collect()] == [2]


def test_bundle_and_requests(spark, tmp_path):
    df = spark.createDataFrame(ROWS, files.CLAIMS)
    files.release(df, df.select(F.col("cause").alias("value")), {"title": "t"}, f"{tmp_path}/r")
    sums = files.bundle(f"{tmp_path}/r", f"{tmp_path}/r.zip")
    import zipfile

    with zipfile.ZipFile(f"{tmp_path}/r.zip") as z:
        assert set(z.namelist()) == {*sums, "README.md"} and len(sums) >= 3
    asked = services.paged_request("soil", first_year=2001, last_year=2003, contact="a@b.org")
    assert asked["filter"] == "from_publication_date:2001-01-01,to_publication_date:2003-12-31" and asked["cursor"] == "*"
    with pytest.raises(services.NotImplementedSource):
        services.unavailable("modis")("aoi")
    assert 'lcase("organic carbon")' in services.vocabulary_request("organic_carbon")


def test_streams_with_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("".join(f'{{"k":"{k}","v":{v}}}\n' for k, v in (("a", 10.0), ("a", 11.0), ("b", -3.0)) for _ in range(20)))
    events = spark.readStream.schema("k string, v double").json(str(folder))
    for name, made in (("mean", ingest.sequential_mean(events, "k", "v")), ("ensemble", ingest.sequential_ensemble(events, "k", "v"))):
        q = made.writeStream.format("memory").queryName(f"seen_{name}").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        got = {r.k: r["mean"] for r in spark.table(f"seen_{name}").collect()}
        assert abs(got["a"] - 10.5) < 1 and abs(got["b"] + 3) < 0.5
