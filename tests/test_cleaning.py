import re

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions import values as V
from tidewire.operators import places as P
from tidewire.plans import cleaning as C


def _scores(content):
    text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", content)).strip()
    parts = [s.strip() for s in re.split(r"(?<=[。！？!?\.])\s+", text[:4500]) if s.strip()]
    out = []
    for i, s in enumerate(parts):
        tenths = 22 if i < 2 else 10 if i < 5 else 0
        tenths += 20 * bool(re.search(r"^(?:[A-Z][A-Z .'\-]{2,}|[一-鿿]{2,20})(?:,\s*(?:[A-Z][A-Za-z .'\-]{2,}|[一-鿿]{2,20})){0,2}\s*[-—]", s))
        tenths += 11 * bool(re.search(r"(?i)\b(in|at|from|near|across|throughout|outside|around|into|toward|inside)\b", s) or re.search(r"[在于从赴至位省州市县郡区]", s))
        tenths += 7 * (len(re.findall(r"\b[A-Z][a-z]+(?:[\-'][A-Z][a-z]+)*\b", s)) >= 2) + 5 * bool(re.search(r"[一-鿿]{2,}", s))
        if len(s) >= 20:
            out.append((-tenths, i))
    return sorted(out)[:8]


def test_sentence_ranks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = {(r.article_id, k, i, -t) for r in spark.read.parquet(f"{sf}/news_articles.parquet").filter("content is not null").collect() for k, (t, i) in enumerate(_scores(r.content))}
    got = {(r.article_id, r.rank, r.sentence_no, r.tenths) for r in C.sentence_ranks(spark, sf).collect()}
    assert len(want) > 5000 and len(want ^ got) <= len(want) * 0.002  # blanks that Java and Python tell apart


def test_geo_text(spark):
    rows = [("Flood in Dunholm", "Short.", "<p>Flood in Dunholm</p> Water rose in Dunholm near the bridge on Monday. It fell again in Ashcombe later that day."), (None, None, None), ("", " ", "<b></b>"), ("t" * 400, None, "x" * 9000)]
    got = [r.geo_text for r in P.with_geo_text(spark.createDataFrame(rows, "t string, s string, c string"), "t", "s", "c").collect()]
    assert got[0].startswith("Flood in Dunholm Short. ") and got[0].count("It fell again") == 1 and got[1] == got[2] == "" and len(got[3]) == 300 + 1 + 500 + 1 + 420


def test_conversions(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(T.clean_title(F.lit("<b>Storm</b> hits - Reuters")), T.clean_title(F.lit("Storm_12")), T.clean_title(F.lit(" - BBC"))) == ("Storm hits", "Storm", None)
    assert one(T.region_stem(F.lit("Vale County")), T.region_stem(F.lit("临江省")), T.region_stem(F.lit("省")), T.region_stem(F.lit(None).cast("string"))) == ("Vale", "临江", "省", None)
    assert one(V.web_address(F.lit("//a.b/c"), F.lit(None).cast("string")), V.web_address(F.lit("/c"), F.lit("https://a.b/d?e")), V.web_address(F.lit("/c"), F.lit("x")), V.web_address(F.lit("http://a/b#c"), F.lit("x")), V.web_address(F.lit("ftp://a"), F.lit("x"))) == ("https://a.b/c", "https://a.b/c", "", "http://a/b", "")
    assert V.query_tags(" AI,ai , b,,") == ["ai", "b"] and V.query_tags(None) == []
    r = one(V.extent(F.lit('{"coordinates":[[[170,1],[-170,2.5]]]}')), V.extent_centre(V.extent(F.lit('[[170, 1],[-170, 3]]'))), V.extent(F.lit("{}")))
    assert r[0] == [-170, 1, 170, 2.5] and (r[1].lng, r[1].lat) == (180, 2) and r[2] is None
    assert one(V.event_status(F.lit("Ongoing"), F.lit("event")), V.event_status(F.lit("open"), F.lit("news")), V.event_status(F.lit(None).cast("string"), F.lit("event"))) == ("open", "closed", "closed")
    assert one(V.quake_severity(F.lit("red"), F.lit(1.0), F.lit(1.0)), V.quake_severity(F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")), V.alert_severity(F.lit(None).cast("string"), F.lit(2.0)), V.open_event_severity(F.lit(None).cast("string"), F.lit(None).cast("double"))) == (95, 40, 96, 65)
