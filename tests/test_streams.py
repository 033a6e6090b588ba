"""Streams with state against the same computed at once."""

import datetime
import http.server
import json
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.sources import literature
from loamwork.streaming import assimilation, ingest

OBS = "tile string, t timestamp, row int, col int, observed double, sd double"
NOON = datetime.datetime(2024, 1, 1, 12)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", assimilation.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def ensemble(spark, tiles=("a", "b"), members=6, side=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(t, m, r, c, float(v)) for t in tiles for m in range(members) for r in range(side) for c, v in enumerate(10 + rng.normal(size=side))]
    return spark.createDataFrame(rows, "tile string, member int, row int, col int, value double")


def at(minutes):
    return NOON + datetime.timedelta(minutes=minutes)


def run(spark, folder, first, files, checkpoint, out, **more):
    """Feeds files of observations one after the other, each as a run of its own from the checkpoint."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(OBS).parquet(folder)
        steps = assimilation.stream_tiles(stream, first, "30 minutes", **more)
        query = steps.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return {(r.tile, r.t, r.row, r.col): (r["mean"], r.sd, r.n_obs) for r in spark.read.parquet(out).collect()}


def test_stream_of_tiles_equals_batch(rocks, tmp_path):
    """Late observations take part in their step, restarts go on, too late ones are dropped: at every step the stream is
    what the batch is."""
    first = ensemble(rocks)
    one = [("a", at(0), 0, 0, 12.0, 0.5), ("b", at(0), 1, 1, 8.0, 0.5), ("a", at(20), 2, 2, 9.0, 0.3)]
    two = [("a", at(0), 1, 2, 11.0, 0.4), ("a", at(10), 0, 1, 10.5, 0.4), ("b", at(45), 2, 0, 13.0, 0.5), ("c", at(5), 0, 0, 1.0, 1.0), ("a", at(10), 9, 9, 50.0, 0.1)]
    three = [("a", at(90), 0, 0, None, None), ("b", at(50), 0, 0, 9.0, 0.2)]
    late = [("a", at(1), 0, 0, 99.0, 0.1), ("a", at(200), 0, 0, None, None)]
    got = run(rocks, f"{tmp_path}/in", first, [one, two, three, late], f"{tmp_path}/check", f"{tmp_path}/out", radius=2.0)
    every = rocks.createDataFrame(one + two + three, OBS)
    want = {(r.tile, r.t, r.row, r.col): (r["mean"], r.sd, r.n_obs) for r in assimilation.batch_tiles(every, first, 2.0).collect()}
    assert {(k[0], k[1]) for k in got} == {("a", at(m)) for m in (0, 10, 20, 90)} | {("b", at(m)) for m in (0, 45, 50)}
    assert set(want) == set(got)
    for k, (mean, sd, n) in want.items():
        assert got[k][2] == n and abs(got[k][0] - mean) < 1e-12 and abs(got[k][1] - sd) < 1e-12
    assert got["a", at(0), 0, 0][2] == 2 and got["a", at(10), 0, 0][2] == 1


def test_a_tile_moves_to_what_is_observed(spark):
    cells = np.array([[0, 0], [0, 1], [5, 5]])
    values = np.random.default_rng(2).normal(size=(400, 1)) + np.array([[0.0, 0.0, 0.0]])
    sure = assimilation.moved(values, cells, np.array([0]), np.array([3.0]), np.array([1e-6]), 1.0, np.zeros((400, 1)))
    assert np.allclose(sure[:, 0], 3) and np.allclose(sure[:, 2], values[:, 2])  # out of reach
    assert 0 < sure[:, 1].mean() - values[:, 1].mean() < 3
    exact = assimilation.moved(values, cells, np.array([0]), np.array([3.0]), np.array([1.0]), None, np.zeros((400, 1)))
    var = values[:, 0].var(ddof=1)
    assert np.allclose(exact[:, 0], values[:, 0] + var / (var + 1) * (3 - values[:, 0]))


def test_sessions_with_late_events(spark, tmp_path):
    """Late events extend a session, and make two of them one; those behind the watermark don't count."""
    folder, schema = f"{tmp_path}/in", "k string, ts timestamp, value double"
    one = [("a", at(0), 1.0), ("a", at(40), 2.0), ("b", at(5), 1.0)]
    two = [("a", at(20), 4.0), ("b", at(70), 8.0)]  # between a's two sessions
    three = [("b", at(60), 16.0), ("z", at(400), 0.0)]
    late = [("a", at(10), 99.0), ("z", at(800), 0.0)]
    for rows in (one, two, three, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(schema).parquet(folder)
        totals = ingest.session_totals(events, "ts", "30 minutes", "1 hour", ["k"])
        query = totals.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").filter("k <> 'z'").collect()))
    batch = ingest.session_totals(spark.createDataFrame(one + two + three, schema), "ts", "30 minutes", by=["k"])
    assert got == sorted(map(tuple, batch.filter("k <> 'z'").collect()))
    assert got == sorted([(at(0), at(70), "a", 3, 7.0), (at(5), at(35), "b", 1, 1.0), (at(60), at(100), "b", 2, 24.0)])


# literature service


class Service(http.server.BaseHTTPRequestHandler):
    """23 works of "soil", 4 of "clay", none of others, five a page; cursors are opaque. It breaks when asked to."""

    sizes, broken, asked = {"soil": 23, "clay": 4}, set(), []

    def do_GET(self):  # noqa: N802
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
        q, begin = asked["search"], 0 if asked["cursor"] == "*" else int(asked["cursor"].removeprefix("c-"))
        Service.asked.append((q, begin))
        if (q, begin) in Service.broken:
            self.send_error(503)
            return
        n = Service.sizes.get(q, 0)
        works = [{"id": f"https://w/{q}/{i}", "title": f"{q} {i}", "publication_year": 2000 + i, "doi": f"https://doi.org/10.1/{q.upper()}{i}", "abstract_inverted_index": {"of": [1], q: [0, 2]}} for i in range(begin, min(n, begin + 5))]
        body = json.dumps({"results": works, "meta": {"next_cursor": f"c-{begin + 5}" if begin + 5 <= n else None}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_args):
        pass


@pytest.fixture
def service(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.broken, Service.asked = set(), []
    literature.register(spark)
    yield f"http://127.0.0.1:{server.server_port}/works"
    server.shutdown()


def options(url, *queries, **more):
    return {"queries": json.dumps(queries), "url": url, "wait": "0", **more}


def test_literature_table(spark, service):
    table = spark.read.format("literature").options(**options(service, "soil", "clay", "none", "soil")).load()
    rows = table.collect()
    assert table.rdd.getNumPartitions() == 3  # a task for each query
    assert sorted(r.url for r in rows) == sorted([f"https://w/soil/{i}" for i in range(23)] + [f"https://w/clay/{i}" for i in range(4)])
    one = next(r for r in rows if r.title == "soil 7")
    assert (one.query, one.source, one.abstract, one.year, one.doi) == ("soil", "https://w/soil/7", "soil of soil", 2007, "10.1/soil7")
    few = spark.read.format("literature").options(**options(service, "soil", "clay", maxResults="7")).load()
    assert {r.query: r["count"] for r in few.groupBy("query").count().collect()} == {"soil": 7, "clay": 4}
    Service.asked.clear()
    assert spark.read.format("literature").options(**options(service, "soil", "clay")).load().filter("query = 'clay'").count() == 4
    assert {q for q, _ in Service.asked} == {"clay"}
    with pytest.raises(Exception, match="503"):
        Service.broken = {("soil", 10)}
        spark.read.format("literature").options(**options(service, "soil", tries="2")).load().count()


def test_literature_with_a_client(spark):
    pages = {"*": (["a", "b"], "x"), "x": (["c"], None)}
    literature.register(spark, lambda q, cursor: {"results": [{"title": t} for t in pages[cursor][0]], "meta": {"next_cursor": pages[cursor][1]}})
    got = spark.read.format("literature").option("queries", '["q"]').load().collect()
    assert [(r.source, r.title, r.abstract, r.year, r.doi, r.url) for r in got] == [(t, t, None, None, None, None) for t in "abc"]


def test_literature_stream_goes_on_where_it_was_killed(spark, service, tmp_path):
    """The service breaks twice, in the middle of a query; the stream is started again from its checkpoint, once with a
    query more. Every record is there once, and pages that were read aren't asked for again."""

    def start(*queries):
        stream = spark.readStream.format("literature").options(**options(service, *queries, tries="1")).load()
        return stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(processingTime="0 seconds").start()

    def done():
        return spark.read.parquet(f"{tmp_path}/out").count()

    for broken in (("soil", 10), ("soil", 20)):
        Service.broken = {broken}
        query = start("soil")
        with pytest.raises(Exception, match="503"):
            query.awaitTermination(120)
        assert done() == broken[1]
    Service.broken, Service.asked = set(), []
    query = start("soil", "clay")
    query.processAllAvailable()
    query.stop()
    got = [r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted([f"https://w/soil/{i}" for i in range(23)] + [f"https://w/clay/{i}" for i in range(4)])
    assert {a for a in Service.asked if a[0] == "soil"} <= {("soil", 15), ("soil", 20)}
