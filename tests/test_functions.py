import difflib
import hashlib
import random
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions import topics as K
from tidewire.functions import values as V
from tidewire.operators import matching as M


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_text_cleaning(spark):
    assert one(spark, " <b>A</b>  b<br> ", T.strip_tags) == "A b"
    assert one(spark, "<p></p>", T.strip_tags) is None and one(spark, None, T.strip_tags) is None
    assert one(spark, "&lt;b&gt;A &amp; B&lt;/b&gt;&nbsp;x", T.clean_html) == "A & B x"
    assert one(spark, "see https://a.b/c?d now me@x.org", lambda c: T.remove_emails(T.remove_urls(c))) == "see  now "
    assert one(spark, "abcdefghij klm", lambda c: T.truncate(c, 10)) == "abcdefg..." and one(spark, "abc", lambda c: T.truncate(c, 10)) == "abc"
    assert one(spark, "<p>Short. This is a longer sentence. End.</p>", T.first_paragraph) == "Short. This is a longer sentence. End."
    assert one(spark, "This is a longer sentence. End.", T.first_paragraph) == "This is a longer sentence"
    assert one(spark, "A  Big-Deal! - BBC News", T.normal_title) == "a big deal"
    assert one(spark, "Bézier's", T.normal_title) == "bézier s"
    assert one(spark, "The new AI report says 5 GPUs 新医院动工", T.title_tokens) == ["ai", "gpus", "新医院动工"]
    assert one(spark, "b a!", T.sorted_words_hash) == hashlib.md5(b"a b").hexdigest()
    assert one(spark, "Ab--c d!", T.slug) == "ab_c_d" and one(spark, "ca. 1200 views", T.leading_number) == 1200


def test_title_similarity_equals_model(spark):
    rng = random.Random(5)
    words = "quake hits north city port talks resume after storm power grid fails again".split()
    rows = [(" ".join(rng.sample(words, rng.randint(1, 6))), " ".join(rng.sample(words, rng.randint(1, 6)))) for _ in range(60)] + [("", "a"), ("same title", "Same Title!"), ("long enough title here", "x long enough title here y"), (None, "a")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(T.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()]

    def model(a, b):
        import re

        n = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t or "")).strip().lower()
        x, y = n(a), n(b)
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        tok = lambda t: {w for w in re.findall("[a-z0-9]+", t) if len(w) > 1 and w not in T.TITLE_STOPWORDS}
        i, j = x.replace(" ", ""), y.replace(" ", "")
        s, l = sorted((i, j), key=len)
        jac = len(tok(x) & tok(y)) / len(tok(x) | tok(y)) if tok(x) | tok(y) else 0
        return max(0.96 if len(s) >= 12 and s in l else 0, 0.72 * difflib.SequenceMatcher(None, i, j).ratio() + 0.28 * jac)

    assert all(abs(g - model(a, b)) < 1e-9 for g, (a, b) in zip(got, rows))


def test_urls_equal_the_library(spark):
    urls = ["HTTPS://A.Example/x/?b=2&utm_source=q&a=1#f", "http://a.example", "https://a.example/p//", "https://a.example/?ref=1", "https://a.example/x?k=&z=3", "https://a.example/x?from=a&q=7", "no url", None]

    def model(u):
        p = urlparse(u)
        q = sorted((k, v) for k, v in parse_qsl(p.query) if k.lower() not in V.TRACKING)
        return urlunparse((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", p.params, urlencode(q), ""))

    for u in urls:
        assert one(spark, u, V.normal_url) == (model(u) if u and "://" in u else u)


def test_values(spark):
    assert one(spark, [" A", "a", "", "B "], V.normal_tags, "array<string>") == ["a", "b"]
    assert one(spark, 0.85, V.percent_scale, "double") == 85 and one(spark, 60.0, V.percent_scale, "double") == 60 and one(spark, 1.0, V.percent_scale, "double") == 100
    assert abs(one(spark, 1, lambda c: V.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), "int") - 111.194927) < 1e-5
    heat = lambda *a: one(spark, 1, lambda c: V.event_heat(*[F.lit(x) for x in a]), "int")
    assert heat(68, 68.0, 1, 1, 4, 18, "country", 1.0, 0) == 68 + 6 + 9 + 14 + 18 + 18
    keys = lambda a, b: one(spark, 1, lambda c: V.geo_overlap(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))), "int")
    assert keys(["JP:13"], ["JP:13"]) == 0.14 and keys(["JP:13"], ["JP:1"]) == 0.08 and keys(["JP:13"], ["JP:27"]) == -0.24 and keys(["JP:13"], ["US:CA"]) == 0.0


def test_topics(spark):
    texts = ["Iran warns of floods", "The port talks on ai, hospital vaccine treaty", "storms 山火", None, "brail portrait"]
    df = K.with_signals(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    rows = df.select(K.topic_tags().alias("tags"), K.topic_category(F.lit("base")).alias("c"), K.priority_score().alias("s")).collect()
    assert [r.tags for r in rows] == [["other"], ["ai", "health", "diplomacy", "transport"], ["disaster"], ["other"], ["other"]]
    assert [r.c for r in rows] == ["base", "science", "disaster", "base", "base"] or rows[1].c in ("science", "policy")
    assert rows[2].s == 3 and rows[0].s == 0
    own = {"a": ("x", ["port", "port  authority".replace("  ", " "), "authority of"]), "b": ("y", ["港口", "港口局"]), "c": ("z", [])}
    df = K.with_signals(spark.createDataFrame([("The PORT\nauthority of 港口局",), ("airport",)], "t string"), "t", own)
    assert [(r.hits_a, r.hits_b, r.hits_c) for r in df.collect()] == [(3, 2, 0), (0, 0, 0)]


def test_matching(spark):
    items = spark.createDataFrame([(1, "JP", "2026-01-03 00:00:00", "Port talks resume in Tokyo", "policy", ["ai"], "official", ["JP:13"]), (2, "JP", "2026-01-09 00:00:00", "Port talks resume in Tokyo", "policy", None, None, None)], "item_id long, country string, at string, title string, category string, tags array<string>, tier string, keys array<string>").withColumn("at", F.col("at").cast("timestamp"))
    events = spark.createDataFrame([(10, "JP", "2026-01-02 00:00:00", "Port talks resume in Osaka", "policy", ["ai"], "official", ["JP:27"]), (11, "JP", "2026-01-02 12:00:00", "Port talks to resume in Tokyo", "policy", ["ai"], "official", ["JP:13"]), (12, "US", "2026-01-02 12:00:00", "Port talks resume in Tokyo", None, None, None, None), (13, "JP", "2025-12-20 00:00:00", "Port talks resume in Tokyo", None, None, None, None)], "event_id long, country string, seen_at string, e_title string, e_category string, e_tags array<string>, e_tier string, e_keys array<string>").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    near = M.window_candidates(M.title_forms(items, "title"), M.title_forms(events, "e_title", "e_"))
    assert {(r.item_id, r.event_id) for r in near.collect()} == {(1, 10), (1, 11)}
    assert [(r.item_id, r.event_id) for r in M.match_events(near).collect()] == [(1, 11)]


def test_folds_and_merge(spark):
    rows = [("g", 1, "2026-01-01 00:00:00", "port talks resume again"), ("g", 2, "2026-01-01 05:00:00", "port talks resume again now"), ("g", 3, "2026-01-03 00:00:00", "port talks resume again"), ("h", 4, "2026-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "group string, item_id long, at string, title string").withColumn("at", F.col("at").cast("timestamp"))
    assert {(r.item_id, r.cluster_id) for r in M.fold_clusters(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    near = M.near_duplicate_fold(spark.createDataFrame([("b", 1, "Port talks resume"), ("b", 2, "port talks resume!"), ("b", 3, "other"), ("c", 4, "Port talks resume")], "block string, item_id long, title string"))
    assert {(r.item_id, r.kept_id) for r in near.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    old = spark.createDataFrame([("a", "x", 1, ["t"]), ("b", None, 5, None)], "k string, s string, n int, tags array<string>")
    new = spark.createDataFrame([("b", "longer", 3, ["u"]), ("c", "new", None, ["v"]), ("c", "new", 7, ["v"])], "k string, s string, n int, tags array<string>")
    rules = {"s": "longest", "n": "greatest", "tags": "union"}
    merged = {r.k: (r.s, r.n, r.tags) for r in M.merge_by_key(old, new, "k", rules).collect()}
    assert merged == {"a": ("x", 1, ["t"]), "b": ("longer", 5, ["u"]), "c": ("new", 7, ["v"])}
    again = M.merge_by_key(M.merge_by_key(old, new, "k", rules), new, "k", rules)
    assert {r.k: (r.s, r.n, r.tags) for r in again.collect()} == merged
