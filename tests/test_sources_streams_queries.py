import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire.plans import catalogue
from tidewire.sources import feeds
from tidewire.streaming import jobs

#: Queries without SQL that find nothing in the smallest tables.
MAY_BE_EMPTY = {"alert_enrichment", "country_mentions", "province_mentions", "all_mentions", "event_source_places"}

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One</title><link>https://a.example/1</link><description>d1</description><pubDate>Tue, 01 Jul 2025 18:22:46 GMT</pubDate></item>
<item><title>No link</title></item>
<item><title>Two</title><guid>https://a.example/2</guid><category>x</category></item></channel></rss>"""
RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<item rdf:about="https://a.example/3"><title>Three</title><link>https://a.example/3</link><description>d</description><dc:date>2025-07-01T10:00:00Z</dc:date></item></rdf:RDF>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>tag:1</id><title>V1</title><link rel="alternate" href="https://a.example/v1"/><link rel="self" href="https://a.example/self"/><published>2025-01-01T00:00:00Z</published></entry>
<entry><id>https://a.example/v2</id><title>V2</title><updated>2025-01-02T00:00:00Z</updated></entry></feed>"""
QUAKES = {"type": "FeatureCollection", "features": [{"id": "q1", "properties": {"title": "M 4.6", "place": "12 km N of X, CA", "time": 1755268308492, "updated": 1755268309000, "mag": 4.6, "url": "https://q/1"}, "geometry": {"type": "Point", "coordinates": [10.5, -3.25, 7]}}]}
OPEN = {"events": [{"id": "E1", "title": "Fire", "closed": None, "categories": [{"id": "wildfires", "title": "Wildfires"}], "geometry": [{"date": "2025-01-01", "type": "Point", "coordinates": [1, 2]}, {"date": "2025-01-05", "type": "Point", "coordinates": [3, 4]}]}]}
LEADS = 'call({"articles": [{"title": "A", "url": "https://a/1", "domain": "a", "sourcecountry": "X", "seendate": "20250101T000000Z"}, {"title": "", "url": "https://a/2"}, {"title": "B", "url": "https://a/1"}]});'


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(p)


def test_feeds(spark, tmp_path):
    rss = feeds.read_rss(spark, write(tmp_path, "a.xml", RSS)).orderBy(F.desc("heat")).collect()
    assert [(r.title, r.url, r.heat) for r in rss] == [("One", "https://a.example/1", 50), ("Two", "https://a.example/2", 49)]
    rdf = feeds.read_rss(spark, write(tmp_path, "b.xml", RDF)).collect()
    assert [(r.title, r.published) for r in rdf] == [("Three", "2025-07-01T10:00:00Z")]
    atom = {r.title: (r.url, r.published) for r in feeds.read_atom(spark, write(tmp_path, "c.xml", ATOM)).collect()}
    assert atom == {"V1": ("https://a.example/v1", "2025-01-01T00:00:00Z"), "V2": ("https://a.example/v2", "2025-01-02T00:00:00Z")}
    leads = feeds.read_json_items(spark, write(tmp_path, "d.json", LEADS)).collect()
    assert [(r.url, r.summary) for r in leads] == [("https://a/1", "a | X")]
    q = feeds.read_quakes(spark, write(tmp_path, "e.json", QUAKES)).first()
    assert (q.external_id, q.magnitude, q.lat, q.lng, q.event_time.microsecond) == ("q1", 4.6, -3.25, 10.5, 492000)
    o = feeds.read_open_events(spark, write(tmp_path, "f.json", OPEN)).first()
    assert (o.external_id, o.category, o.lat, o.lng, o.at) == ("E1", "Wildfires", 4.0, 3.0, "2025-01-05")


def test_dictionaries_and_pages(spark, tmp_path):
    line = "\t".join(["7", "Big", "Big", "", "1.5", "2.5", "P", "PPLA", "XA", "", "01", "", "", "", "900", "", "", "UTC", "2020-01-01"])
    cities = feeds.read_cities(spark, write(tmp_path, "c.txt", line + "\n" + line.replace("7\tBig", "8\tSmall", 1).replace("\t900\t", "\t90\t").replace("1.5", "9.5")))
    assert [(r.lat, r.lng) for r in feeds.region_centres(cities).collect()] == [(1.5, 2.5)]
    d = {"country_code": "XA", "country_name": "X", "admin1_regions": {"01": {"country_code": "XA", "admin1_code": "01", "admin1_name": "N", "aliases": ["n"], "geojson_key": "XA.01", "lat": 1.0, "lng": 2.0}}}
    assert feeds.read_region_dictionary(spark, write(tmp_path, "d.json", d)).first().geojson_key == "XA.01"
    pages = spark.createDataFrame([('<a class="x" href="https://a/1">A long enough text</a><a href="/rel">another long text</a><a href="https://a/2">short</a>',), (None,)], "html string")
    assert [(r.url, r.text) for r in feeds.page_links(pages).collect()] == [("https://a/1", "A long enough text")]
    feeds.split_features(spark, write(tmp_path, "q.json", QUAKES), str(tmp_path / "out"), "place")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stream_counters_and_upsert(spark, data, tmp_path):
    stream = jobs.event_stream(spark, data)
    base = str(tmp_path / "ck")
    rows = []
    q = jobs.reset_counters(stream.select("user_id", "event_id", "event_type", "at"), "user_id").writeStream.outputMode("update").option("checkpointLocation", base).foreachBatch(lambda df, i: rows.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r.user_id: r for r in spark.read.parquet(f"{data}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r.user_id for r in rows} == set(batch) and all(1 <= r.attempts <= batch[r.user_id].n and r.failures <= r.attempts for r in rows)
    jobs.upsert_batches(stream.select("event_id", "user_id", "event_type", "at"), str(tmp_path / "t"), "user_id", "event_id")
    latest = jobs.current_version(spark, str(tmp_path / "t"))
    want = {r.user_id: r.e for r in spark.read.parquet(f"{data}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    assert {r.user_id: r.event_id for r in latest.collect()} == want
    assert jobs.session_counts(stream, "user_id").isStreaming


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    target, source = str(tmp_path / "table"), str(tmp_path / "in")
    schema = "k string, n long, at long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: jobs.upsert_batches(spark.readStream.schema(schema).parquet(source), target, "k", "at")
    seen = lambda: {r.k: r.n for r in jobs.current_version(spark, target).collect()}
    put([("a", 1, 1), ("b", 1, 1), (None, 9, 9)])
    run()
    assert seen() == {"a": 1, "b": 1}
    put([("b", 2, 2), ("c", 1, 1)])
    run()  # as after a stop: what is stored stays, what is new is merged
    run()  # nothing new: nothing changes
    assert seen() == {"a": 1, "b": 2, "c": 1}
    put([("a", 0, 0)])
    run()
    assert seen() == {"a": 1, "b": 2, "c": 1}
    import shutil

    shutil.rmtree(tmp_path / "table" / "_state")  # state lost: all is read again on top of what is stored
    run()
    assert seen() == {"a": 1, "b": 2, "c": 1}


def _plain(value):
    """A value in a form both engines share."""
    if value is None or value != value:
        return "null"
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6))
    return str(list(value)) if isinstance(value, list | tuple) else str(value)


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_every_query(spark, data, duck, name):
    """Equal to its SQL row by row; without SQL, stable columns and rows."""
    df = catalogue.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    rows = [tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows or name in MAY_BE_EMPTY
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert sorted(rows) == sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())


def test_entry_stands_without_llm():
    import importlib
    import sys

    blocked = {k: v for k, v in sys.modules.items() if k.startswith("tidewire.llm")}
    for k in blocked:
        del sys.modules[k]
    sys.modules["tidewire.llm"] = None
    try:
        sys.modules.pop("__spark_entry__", None)
        entry = importlib.import_module("__spark_entry__")
        assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        del sys.modules["tidewire.llm"]
        sys.modules.update(blocked)
        sys.modules.pop("__spark_entry__", None)
