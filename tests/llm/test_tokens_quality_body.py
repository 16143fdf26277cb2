import random
import re

import numpy as np
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import encode as E
from tidewire.llm import main_body as B
from tidewire.llm import mixture as M
from tidewire.llm import text_quality as Q
from tidewire.llm.labelled_pages import BODY, FURNITURE, lines_of, pages
from tidewire.llm.quality_examples import examples

TEXTS = [
    "Hello world, it's 2026!", "  two  blanks\n\nand\tlines \n", "<|endoftext|> is text", "", None, "   ", "das Straßenfest – ‘quoted’", "大桥的维修工程，时间在冬季之前。", "a b　c d​e", "emoji 🙂🏽 ͸ ￿ new", "I'LL we'll don't'", "x" * 30_000,
    "Ⅳ ½ ² ١٢٣", "\r\n\x00\x1f control", "é é " * 50, "end  ",
]


def test_encoding_is_the_tokenizers_and_decodes_back(spark):
    t = Tokenizer.from_file(str(path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    rows = [(i, x, "n", 3) for i, x in enumerate(TEXTS)] + [(0, TEXTS[0], "n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    for hot in (E.HOT_WORDS, 5, 0):
        got = E.encode_texts(df, hot_words=hot).collect()
        assert len(got) == len(rows)
        for r in got:
            assert list(r.ids) == (t.encode(TEXTS[r.doc_id], add_special_tokens=False).ids if TEXTS[r.doc_id] else []), (hot, r.doc_id)
        sizes = {r.doc_id: r.n_tokens for r in E.token_counts(df, ["doc_id", "word"], hot_words=hot).collect()}
        assert sizes == {r.doc_id: len(r.ids) for r in got}
    assert [list(r.ids) for r in E.encode_texts(df, hot_bytes=60).orderBy("doc_id").collect()] == [list(r.ids) for r in E.encode_texts(df).orderBy("doc_id").collect()]
    assert E.token_counts(df.limit(0), ["doc_id"]).count() == 0
    back = E.decode_ids(E.encode_texts(df)).collect()
    assert len(back) == len(rows) and all(r.text == (TEXTS[r.doc_id] or "") for r in back)
    assert E.encode_texts(df.limit(0)).count() == 0


def test_mixture_shares_caps_and_nesting(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", s, rng.randint(1, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["tiny"] * 40 + ["other"] * 50)] + [("n", None, 5), ("z", "mid", 0)]
    df = spark.createDataFrame(rows, "doc_id string, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    picked, report = M.mix_sources(df, targets)
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"big", "mid", "tiny", "absent"} and shares["absent"].mixed_tokens == 0
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert abs(shares[s].actual_share - share) < 0.01 and shares[s].most_copies <= shares[s].max_repeats
    some = {r.doc_id: r.copies for r in M.mix_sources(df, targets, 20_000)[0].collect()}
    more = {r.doc_id: r.copies for r in M.mix_sources(df, targets, 60_000)[0].collect()}
    assert all(more.get(d, 0) >= c for d, c in some.items())
    far = {r.source: r for r in M.mix_sources(df, targets, 10**9)[1].collect()}
    assert far["tiny"].mixed_tokens == 4 * far["tiny"].available_tokens and far["big"].most_copies == 2
    assert M.mix_sources(df.limit(0), targets)[0].count() == 0


WORDS = [("en", w) for w in "the of and to in a is for on was with after before had".split()] + [("de", w) for w in "der die das den und in von mit für nach vor".split()] + [("fr", "le"), ("es", "el"), ("zh", "的"), ("zh", "了"), ("zh", "但是"), ("zh", "虽然"), (None, "x"), ("en", None)]


def test_kinds_of_held_out_texts(spark):
    words = spark.createDataFrame(WORDS, "lang string, word string")
    seen = examples()
    rows = [(i, lang, text, "c") for i, (_, _, lang, text) in enumerate(seen)] * 2
    rows += [(9001, "en", None, "c"), (9002, None, "", "c"), (9003, "en", "​ \n", "c"), (9004, None, "The mayor of the town said that the bridge was closed for repairs. " * 40, "c"), (9005, "en", "word " * 100_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, low string")
    got = {}
    for r in Q.text_kinds(docs, words).collect():
        got[r.doc_id] = r.kind
    assert not {9001, 9002, 9003} & set(got) and got[9005] == "junk"
    assert np.mean([got[i] == kind for i, (kind, *_) in enumerate(seen)]) > 0.95
    assert Q.text_kinds(docs.limit(0), words).count() == 0
    s = {r.doc_id: r for r in Q.text_statistics(docs, words).collect()}
    assert s[9001].n_words == s[9003].n_visible == 0 and s[9004].n_words == 40 * 13 and s[9004].line_end_share == 1.0 and s[9004].common_share > 0.3


def _right(model, held):
    made = [B.Page(x["title"], x["source_name"], x["lines"], model["common"]) for x in held]
    want = [x["labels"][no] for x, p in zip(held, made) for no in p.numbers]
    return np.mean([(share >= 0.5) == v for share, v in zip(B.marginals(made, model), want) if v is not None])


def test_main_body_on_held_out_pages(spark):
    held = pages(150, seed=99)
    rows = [(i, x["title"], x["source_name"], "\n".join(x["lines"]), 5) for i, x in enumerate(held)]
    rows += [(1000, None, None, None, 5), (1001, "t", "s", "", 5), (1002, None, None, "\n \n", 5), (1003, None, None, "One line.", 5), (1004, "t", "s", "word " * 60_000, 5), (1005, "t", "s", "<div>\n" * 500 + "deep", 5), rows[0]]
    df = spark.createDataFrame(rows, "article_id long, title string, source_name string, content string, line_no int")
    share = {(r.article_id, r.line_no): r.content_share for r in B.line_marginals(df).collect()}
    want = {(i, k): x["labels"][k] for i, x in enumerate(held) for k, line in enumerate(x["lines"]) if line.strip()}
    assert set(want) == {k for k in share if k[0] < 1000}
    assert np.mean([(share[k] >= 0.5) == v for k, v in want.items() if v is not None]) > 0.96
    bodies = {r.article_id: r.body for r in B.main_bodies(df).collect()}
    assert bodies[1000] is None and len(bodies) == len(held) + 6
    assert B.line_marginals(df.limit(0)).count() == 0


def test_main_body_on_lines_never_met():
    """Pages none of whose lines is in the training pages."""
    for part in (0, 1):
        assert _right(B.train(written=pages(900, part=part)), pages(200, seed=77, part=1 - part)) > 0.8


def test_written_pages_are_not_from_the_corpus(spark):
    text = "\n".join(r.content for r in spark.read.parquet("/root/testdata/sf0.01/news_articles.parquet").select("content").dropna().collect())
    fragments = {f.strip(" .,:|") for x in lines_of(BODY) + lines_of(FURNITURE) for y in x.split("|") for f in re.split(r"\{\w+\}", y)}
    assert not [f for f in fragments if len(f) >= 12 and " " in f and f in text]


def test_main_body_of_other_sources(spark):
    """Trained with the marked pages of half of the sources, tested on those of the others."""
    rows = spark.read.parquet("/root/testdata/sf0.1/news_articles.parquet").filter("content like '%<p%' and source_code is not null").select("article_id", "title", "source_name", "content", F.expr("abs(hash(lower(source_code))) % 2").alias("half"))
    parts = [B.marked_pages(rows.filter(f"half = {k}"), "article_id", "content", "title", "source_name", 400) for k in (0, 1)]
    assert _right(B.train(marked=parts[0]), parts[1]) > 0.95


def test_messages_equal_enumeration():
    model = B.train(300)
    x = next(p for p in pages(40, seed=3) if "<div>" in p["lines"] or "<article>" in p["lines"])
    page = B.Page(x["title"], x["source_name"], x["lines"][:6], model["common"])
    got = B.marginals([page], model)
    forms, line_at, word_at, value = B._matrix([page], model["vocabulary"])
    own = B.own_potentials(forms, line_at, word_at, value, B.Forest([page]), model)
    n, total, content = len(page.kinds), 0.0, np.zeros(len(page.leaf))
    assert max(page.depths) >= 4
    text_of = {node: k for k, node in enumerate(page.leaf)}
    for bits in range(2**n):
        s = [bits >> k & 1 for k in range(n)]
        p = model["root"][s[0]] + sum(model["psi"][page.kinds[k], s[page.parents[k]], s[k]] for k in range(1, n)) + sum(own[t, s[node]] for node, t in text_of.items())
        total += np.exp(p)
        content += np.exp(p) * np.array([s[node] for node in page.leaf])
    assert np.allclose(got, content / total, atol=1e-6)


def test_labels_of_markup():
    lines = ["<nav>Menu</nav>", "<p>Text</p>", '<li><a href="/">Other</a></li>', "<li>Item</li>", "plain", "<div>Share</div>", '<p>With a <a href="/">link</a>.</p>', "<div>", ""]
    assert B.markup_labels(lines) == [False, True, False, True, None, False, True, None, None]
