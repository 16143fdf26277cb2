import random
import unicodedata

from tidewire.llm import lookalike as L
from tidewire.llm import repeated_lines as R


def line_key(line):
    import re
    import unicodedata

    line = "".join(c for c in line if unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line)).strip().upper().lower()


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    stock = ["Share (12 shares)", "share  (9 shares) ", "SHARE (7 sha​res)", "© 2026 Post", "Read also: X", "straße 5", "STRASSE 77", "", "   ", "<p>Tags</p>"]
    rows = [(i, rng.choice(["post", "Post", "wire", None]), "\n".join(rng.choice([*stock, f"own line {i}-{k} {chr(97 + i % 26)}{chr(97 + k)}"]) for k in range(rng.randint(1, 9)))) for i in range(80)]
    rows += [(3, *rows[3][1:]), (500, "post", None), (501, "post", ""), (502, "post", "x" * 200_000), (503, None, "Share (1 shares)")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "article_id long, source_code string, content string, h1 int, line int")
    seen, at = {}, set()
    for i, s, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line_key(line):
                key = ((s or "").lower(), line_key(line))
                seen.setdefault(key, set()).add(i)
                at.add((i, k, key))
    want = {(i, k) for i, k, key in at if len(seen[key]) >= 6}
    got = {(r.article_id, r.line_no) for r in R.repeated_lines(df).collect()}
    assert got == want and want
    clean = R.without_repeated_lines(df).collect()
    assert len(clean) == len(rows)
    for r in clean:
        original = next(t for i, _, t in rows if i == r.article_id)
        lines = None if original is None else "\n".join(x for k, x in enumerate(original.split("\n")) if (r.article_id, k) not in want)
        assert r.text == lines
    assert R.repeated_lines(df.limit(0)).count() == 0


SAME = [
    ("coöperative", "cöoperative".replace("cöo", "coö")), ("flood plan", "ﬂood plan"), ("Chapter IV", "Chapter Ⅳ"), ("open", "ｏｐｅｎ"), ("traders", "traԁers"), ("Совет", "Cовет"), ("Совет", "СовеΤ".replace("Τ", "т")),
    ("山火 12", "⼭⽕  12"), ("a b", " a ​b "), ("Kelvin", "Kelvin"), ("étude", "étude"), ("Fähre", "ꓝähre"), ("里", "里"), ("office", "oﬃce"), ("a​b", "ab"), ("cop", "сор"), ("ѷ", "ѷ"), ("γᾳ", "γᾳ"), ("ПОРТ", "ΠΟΡΤ"), ("a‐b", "a-b"), ("a‑b", "a-b"), ("ở", "ở"),
]
DIFFERENT = [("km²", "km2"), ("café", "cafe"), ("Plan", "plan"), ("plan…", "plan..."), ("l’eau", "l'eau"), ("hits", "hit"), ("ab", "a b"), ("I", "l"), ("0", "O")]


def test_same_look_pairs(spark):
    rows, want = [], set()
    for k, (a, b) in enumerate(SAME):
        rows += [(2 * k, "t", f"{a} case{k}x"), (2 * k + 1, "t", f"{b} case{k}x")]
        if f"{a} case{k}x" != f"{b} case{k}x":
            want.add(("t", 2 * k, 2 * k + 1))
    for k, (a, b) in enumerate(DIFFERENT):
        rows += [(1000 + 2 * k, "t", f"{a} other{k}y"), (1001 + 2 * k, "t", f"{b} other{k}y")]
    rows += [(5000, "t", None), (5001, "t", ""), (5002, "t", " "), (5003, "s", "flood plan case1x"), (5004, "t", "w" * 100_000)]
    want.add(("t", 5001, 5002))
    df = spark.createDataFrame([(*r, 0, "n") for r in rows], "id long, field string, text string, c1 int, _t string")
    got = {(r.field, r.id_a, r.id_b) for r in L.same_look_pairs(df, "id", "field", "text").collect()}
    assert got == want
    assert L.same_look_pairs(df.limit(0), "id", "field", "text").count() == 0
    forms = {r.id: r.canonical for r in L.canonical_texts(df, "text").collect()}
    assert forms[5000] is None and forms[5001] == forms[5002] == ""
    assert all(forms[2 * k] == forms[2 * k + 1] for k in range(len(SAME)))


def test_trie_and_table_agree():
    """The automaton walks tokens as they stand; the table is another way to the same classes."""
    rng = random.Random(4)
    twins = {c: others for c, others in L.LOOKALIKES.items()}
    words = ["port", "office", "flood", "Chapter", "IV", "coöperative", "Straße", "ở", "ТОРГ", "ποτε", "x"]
    def disguise(w):
        out = []
        for c in w:
            r = rng.random()
            out.append(rng.choice(twins[c]) if c in twins and r < 0.4 else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and r < 0.5 else unicodedata.normalize("NFD", c) if r < 0.7 else c)
            if rng.random() < 0.1:
                out.append(rng.choice(["\u200b", "\u00ad", "\ufeff"]))
        return "".join(out).replace("fi", "ﬁ")
    trie = L.LookalikeTrie({w: k for k, w in enumerate(words)})
    forms = {L.table_form(w): w for w in words}
    for w in words:
        for _ in range(60):
            t = disguise(w)
            assert [m[2] for m in trie.matches(t)] == [forms[L.table_form(t)]] == [w], (w, t)
    for t in ("ports", "por", "Port", "km²", "cafe"):
        assert trie.matches(t) == []
    for w in ("ѷ", "γᾳ"):
        assert L.LookalikeTrie({w: 5}).matches(w) == [(0, -5, w)]


def test_hot_value_and_hot_beginning(spark):
    rows = [(i, "t", "same text") for i in range(3000)] + [(5000, "t", "ｓame text")] + [(6000 + i, "t", f"https{i}x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, field string, text string")
    got = {(r.id_a, r.id_b) for r in L.same_look_pairs(df, "id", "field", "text").collect()}
    assert got == {(i, 5000) for i in range(3000)}
    classes = {r.id: (r.look_class, r.n_spellings, r.n_links) for r in L.same_look_classes(df, "id", "field", "text").collect()}
    assert classes[0] == (0, 2, 1) and classes[5000] == (0, 2, 3000) and classes[6001] == (6001, 1, 0) and len(classes) == len(rows)


def test_trie_prefers_frequent_spelling_and_honours_budget():
    trie = L.LookalikeTrie({"port": 5, "роrt".replace("о", "о"): 1, "post": 9, "sport": 2})
    assert trie.matches("роrt")[0] == (0, -5, "port")
    assert trie.matches("xyz") == []
    assert {w for _, _, w in trie.matches("port", 1)} >= {"port", "post", "sport"}
    assert L.LookalikeTrie({}).matches("a", 2) == []


def test_table_form_is_idempotent():
    for a, b in SAME:
        assert L.table_form(L.table_form(b)) == L.table_form(b) == L.table_form(b)
        assert a.split() and b.split()
