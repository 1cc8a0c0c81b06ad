import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import images
from tidegauge.sources import connectors, files
from tidegauge.streaming import links


def test_text_and_csv(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text('x,index,incidentBeginDate,incidentEndDate,incidentType,lat,lon\n1,5,2020-01-01,,"Fire, big",1.5,bad\n')
    r = files.read_declarations(spark, str(p)).first()
    assert (r["index"], r["incidentEndDate"], r["incidentType"], r["lat"], r["lon"]) == (5, None, "Fire, big", 1.5, None)
    df = spark.createDataFrame([(1, "http://a/x"), (2, "http://b,c")], "event_id int, url string")
    files.append_links(df, str(tmp_path / "links"))
    files.append_links(df.limit(1), str(tmp_path / "links"))
    assert sorted(tuple(r) for r in files.read_links(spark, str(tmp_path / "links")).collect()) == [(1, "http://a/x"), (1, "http://a/x"), (2, "http://b")]
    rows = spark.createDataFrame([(1, "u", "1, 2", "{}", "[a:\n b]")], "id int, url string, coordinates string, locations string, data string")
    files.write_packed(rows, str(tmp_path / "packed"))
    assert [r["line"] for r in files.read_lines(spark, str(tmp_path / "packed")).collect()] == ["1,u,(1, 2),{},[a:  b]"]


def test_json(spark, tmp_path):
    record = {"folder_id": 1, "video": ["a"], "dataset": "D", "lat_lon": [[1.0, 2.0]], "timestamp": ["t"], "sensor": ["s"], "task": "q", "conversations": [{"from": "human", "value": "x"}], "id": 3}
    (tmp_path / "a.json").write_text(json.dumps([record, {**record, "id": 4, "metadata": {"correct_answer": "A", "all_options": [{"letter": "A", "text": "t"}]}}], indent=2))
    df = files.read_records(spark, str(tmp_path / "a.json"), array=True)
    files.write_records(df, str(tmp_path / "out"))
    back = {r["id"]: r for r in files.read_records(spark, str(tmp_path / "out")).collect()}
    assert back[3]["metadata"] is None and back[4]["metadata"]["all_options"][0]["text"] == "t" and back[3]["lat_lon"] == [[1.0, 2.0]]
    (tmp_path / "m.json").write_text(json.dumps({"0_": {"predicted": "A", "ground_truth": "a", "task": "t"}, "1_": {"predicted": ""}}))
    with pytest.warns(UserWarning, match="nowhere"):
        got = files.read_models(spark, {"m": str(tmp_path / "m.json"), "n": str(tmp_path / "nowhere.json")})
    assert sorted((r["model_name"], r["qid"], r["predicted"], r["task"]) for r in got.collect()) == [("m", "0_", "A", "t"), ("m", "1_", "", None)]


def test_scores_and_reports(spark, tmp_path):
    files.write_scores(spark.createDataFrame([(1, "0_")], "overall_score int, qid string"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["overall_score", "qid"]
    files.write_report("a\nb\n", str(tmp_path / "r"), spark)
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()][:2] == ["a", "b"]


def test_images(spark, tmp_path):
    def save(folder, name, pixels):
        (tmp_path / folder).mkdir(exist_ok=True)
        np.save(tmp_path / folder / name, pixels)

    good = np.random.default_rng(1).integers(60, 200, (32, 32, 3), dtype=np.uint8)
    save("1", "1_2020-01-01.npy", good)
    save("1", "1_2020-01-02.npy", np.zeros((32, 32, 3), np.uint8))
    save("1", "1_cloud_2020-01-01.npy", np.zeros((4, 4), np.uint8))
    save("1", "1_before_2020-01-03.npy", good)
    (tmp_path / "1" / "broken.jpg").write_bytes(b"xx")
    save("2", "2_2020-01-01.npy", good)
    (tmp_path / "1" / "p.ppm").write_bytes(b"P6 2 2 255\n" + bytes(range(60, 72)))
    listed = files.list_files(spark, str(tmp_path), content=True)
    assert sorted(r["event"] for r in files.event_folders(listed).collect()) == [1, 2]
    keep = {r["name"]: r["keep"] for r in images.kept_images(images.image_statistics(listed)).collect()}
    assert keep == {"1_2020-01-01.npy": True, "1_2020-01-02.npy": False, "1_cloud_2020-01-01.npy": True, "1_before_2020-01-03.npy": False, "broken.jpg": False, "2_2020-01-01.npy": False, "p.ppm": True}
    df = spark.createDataFrame([(10.0,), (100.0,), (250.0,)], "m double")
    assert [tuple(r) for r in df.select(images.download_choice(F.col("m")), images.download_choice(F.col("m"), True)).collect()] == [("retry", "keep"), ("keep", "keep"), ("drop", "drop")]


def test_services(spark):
    class Fails:
        def call(self, key):
            if key == "bad":
                raise OSError("down")
            return "no" if key == "none" else key.upper()

    df = spark.createDataFrame([("a",), ("a",), ("bad",), ("none",), (None,)], "k string")
    got = sorted(((r["k"], r["response"]) for r in connectors.ask(df, "k", Fails, wait=0.0).collect()), key=str)
    assert got == sorted([("a", "A"), ("a", "A"), ("bad", None), ("none", ""), (None, None)], key=str)
    table = spark.createDataFrame([("a", '[{"lat": "1.5", "lon": "2"}, {"lat": "9", "lon": "9"}]'), ("bad", "[]")], "key string, response string")
    got = connectors.geocoded(connectors.look_up(df, "k", table)).collect()
    assert [(r["k"], r["lat"], r["lon"]) for r in got] == [("a", 1.5, 2.0)] * 2
    assert df.select(connectors.prompted("ask {text}!", text=F.col("k"))).first()[0] == "ask a!"
    assert connectors.Lookup({"a": "b"}).call("a") == "b"


def test_links_as_a_stream(spark, tmp_path):
    schema = "idx int, declaration_title string, incident_type string, designated_area string, state string, incident_begin_date string"
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    find = lambda q: q.select("event_id", F.concat(F.lit("http://x/"), F.col("event_id").cast("string")).alias("url"))
    for batch in ([(1, "a", None, "b", "c", "d")], [(1, "a", None, "b", "c", "d"), (2, "e", "f", "g", "h", "i")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        links.gather_links(spark, source, schema, find, sink, checkpoint).awaitTermination()
    got = sorted((r["event_id"], r["url"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "http://x/1"), (2, "http://x/2")]
    assert links.search_queries(spark.createDataFrame([(1, "a", None, "b", "c", "d")], schema)).first()["query"] == "a nan b c d"


def test_late_events(spark):
    df = spark.sql("select timestamp'2020-01-01 00:01:00' as ts, 'a' as k union all select timestamp'2020-01-01 00:04:00', 'a' union all select timestamp'2020-01-01 00:06:00', 'a'")
    assert sorted(r["n"] for r in links.late_counts(df, "ts", "k").collect()) == [1, 2]


def test_services_over_http(spark):
    import http.server
    import json
    import threading

    from tidegauge.operators import parsing

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, text, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def do_GET(self):
            if self.path.startswith("/page"):
                self.answer("<title>T</title><p>caf\u00e9 &amp; bar")
            elif self.path.startswith("/search"):
                self.answer(json.dumps([{"url": f"http://x/{k}"} for k in range(9)]))
            elif self.path.startswith("/place/Elm%20Fork"):
                self.answer('[{"lat": "1.5", "lon": "2"}]')
            else:
                self.answer("no such page", 404)

        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer(json.dumps({"out": [{"text": said["prompt"].upper() + said["model"]}]}))

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        pages = connectors.ask(spark.createDataFrame([(f"{base}/page",), (f"{base}/none",)], "k string"), "k", connectors.Pages, wait=0.0)
        assert {r["k"][-4:]: r["h"] and r["h"]["content"] for r in pages.select("k", parsing.html_parts(F.col("response")).alias("h")).collect()} == {"page": "caf\u00e9 & bar", "none": None}
        assert json.loads(connectors.Search(base + "/search?q={query}").call("a b")) == [f"http://x/{k}" for k in range(5)]
        places = connectors.ask(spark.createDataFrame([("Elm Fork",), ("Oak",)], "k string"), "k", lambda: connectors.Geocoder(base + "/place/{query}"), wait=0.0)
        assert [(r["k"], r["lat"]) for r in connectors.geocoded(places).collect()] == [("Elm Fork", 1.5)]
        assert connectors.Model(base, {"model": "!"}, ("out", 0, "text")).call("hi") == "HI!"
    finally:
        server.shutdown()
