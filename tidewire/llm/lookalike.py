"""One form for text that looks the same but is made of different characters.

Texts are split at blanks of any kind and the *distinct* tokens are counted.
Tokens whose letters belong to one script and that hold no odd forms are
spellings a writer would use: they are the vocabulary. Per shard of the token
table a trie of the vocabulary's characters is built and every distinct token
is run through it as it stands, character by character, with a weighted edit
automaton: an edge of the same character or of a look-alike costs nothing
(Cyrillic for Latin, full-width for ordinary), a character that stands for
several crosses as many edges (a ligature, a Roman numeral, an accented letter
against a letter and its mark), an ignorable character stays where it is for
nothing; anything else costs one. At the default budget of zero only spellings
that look the same are met; the most frequent one is canonical. Tokens that
meet none are normalised by table.

A shard is a hash of a token's whole table form, which tokens that look the
same share and others do not, so neither a frequent beginning nor a frequent
token fills a shard; the number of shards follows the number of distinct
tokens and a trie stays bounded. Changed tokens are joined back by broadcast
when few and short, else by shuffle.

Edge cases: null stays null; empty and blank texts become the empty text;
ignorable-only tokens vanish; letter case, accents, raised digits and
punctuation of another shape are kept apart; repeated rows give repeated rows;
empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import differing_pairs
from ..session import cut, small_side

#: Distinct tokens one shard (one trie) holds on average.
SHARD_TOKENS = 20_000
#: Changed tokens up to which they are broadcast.
BROADCAST_TOKENS = 300_000

# Characters that have the look of another; letters of Latin first, then those of Greek
# that Cyrillic repeats, and hyphens.
LOOKALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝϜ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀꓲ", "J": "ЈᎫꓙ",
    "K": "ΚКᏦꓗ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ", "U": "Սꓴ",
    "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑα", "b": "Ьᖯ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іɩ", "j": "јϳ", "l": "ӏǀ", "n": "ո", "o": "оοօᴏ",
    "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "սʋᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хᕁ", "y": "уү", "z": "ᴢ",
    "Γ": "Г", "Π": "П", "Φ": "Ф", "κ": "к", "φ": "ф", "-": "‐‑",
}
_PROTO = {c: latin for latin, others in LOOKALIKES.items() for c in others}

# Blocks whose compatibility forms look like the ordinary characters:
# Roman numerals, CJK radicals, ligatures, half- and full-width forms.
_COMPAT_BLOCKS = [(0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0xFF01, 0xFFEE)]
_JOINERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0xE0100, 0xE01F0))


def ignorable(c: str) -> bool:
    """A character without a form of its own."""
    return ord(c) in _JOINERS or unicodedata.category(c) == "Cf"


_EXPANDED: dict[str, str] = {}


def expand(c: str) -> str:
    """What a single character looks like, as ordinary characters, decomposed."""
    if (known := _EXPANDED.get(c)) is None:
        if ignorable(c):
            known = ""
        else:
            n = ord(c)
            known = unicodedata.normalize("NFKC", c) if any(a <= n <= b for a, b in _COMPAT_BLOCKS) else c
            known = "".join(_PROTO.get(x, x) for x in unicodedata.normalize("NFD", known))
        _EXPANDED[c] = known
    return known


def table_form(token: str) -> str:
    """The token normalised by table: one string for all tokens that look the same."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFC", "".join(map(expand, token)))


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return name.split(" ")[0] if name else "?"


def plain_spelling(token: str) -> bool:
    """Could be typed as it is: no odd forms, composed accents, letters of one script."""
    if token.isascii():
        return True
    if unicodedata.normalize("NFC", token) != token or any(ignorable(c) or any(a <= ord(c) <= b for a, b in _COMPAT_BLOCKS) for c in token):
        return False
    alphabets = {s for c in token if c.isalpha() and (s := _script(c)) in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU")}
    return len(alphabets) <= 1 and not any(c in _PROTO and _script(c) not in ("CYRILLIC", "GREEK", "ARMENIAN") for c in token)


class LookalikeTrie:
    """Trie of spellings with a weighted edit automaton over it.

    Spellings and tokens are taken apart into letters and marks in canonical
    order, which Unicode holds for the same text. Costs: 0 for an edge whose
    character is or looks like the token's, 0 for an ignorable of the token, 1
    for any other substitution, insertion or deletion.
    """

    __slots__ = ("root",)
    _END = ""

    def __init__(self, spellings: dict[str, int]) -> None:
        """Nodes lead by the look of an edge to its characters, by the character to the next node."""
        self.root: dict = {}
        for word, n in spellings.items():
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                for look in expand(c):
                    node = node.setdefault(look, {}).setdefault(c, {})
            node.setdefault(self._END, []).append((n, word))

    def matches(self, token: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -count, spelling) of each spelling within ``budget``, best first."""
        states = self._insertions({id(self.root): (0, self.root)}, budget)
        for c in unicodedata.normalize("NFD", token):
            for look in expand(c):  # none for an ignorable, several for a character that stands for several
                after: dict[int, tuple[int, dict]] = {}
                for cost, node in states.values():
                    for child in node.get(look, {}).values():
                        self._put(after, cost, child)
                    if cost < budget:
                        self._put(after, cost + 1, node)  # the token has one character more
                        for other, children in node.items():
                            if other and other != look:
                                for child in children.values():
                                    self._put(after, cost + 1, child)
                states = self._insertions(after, budget)
            if not states:
                return []
        return sorted((cost, -n, word) for cost, node in states.values() for n, word in node.get(self._END, ()))

    def _insertions(self, states: dict, budget: int) -> dict:
        if budget == 0:
            return states
        todo = list(states.values())
        while todo:
            cost, node = todo.pop()
            if cost < budget:
                for other, children in node.items():
                    if other:
                        for child in children.values():
                            if self._put(states, cost + 1, child):
                                todo.append((cost + 1, child))
        return states

    @staticmethod
    def _put(states: dict, cost: int, node: dict) -> bool:
        if (old := states.get(id(node))) is None or cost < old[0]:
            states[id(node)] = (cost, node)
            return True
        return False


def _shard_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["looks"] = [t if t.isascii() else table_form(t) for t in pdf["token"]]
        yield pdf


def _canonical_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(pdf["token"], pdf["n"]))
    trie = LookalikeTrie({t: n for t, n in counts.items() if plain_spelling(t)})
    met = {token: found[0][2] for token in counts if (found := trie.matches(token))}
    # Tokens that met no spelling go by table, to the spelling of their look where the table has one.
    by_look = {table_form(token): canonical for token, canonical in sorted(met.items())}
    out = []
    for token in counts:
        canonical = met.get(token) or by_look.get(looks := table_form(token), looks)
        if canonical != token:
            out.append((token, canonical))
    return pd.DataFrame(out, columns=["token", "canonical"])


# Java's blanks, Unicode's space separators and the ASCII separators.
BLANKS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]+"


def canonical_spellings(texts: DataFrame, text_col: str) -> DataFrame:
    """(token, canonical) of each distinct token whose canonical spelling is another."""
    tokens = texts.filter(F.col(text_col).isNotNull()).select(F.explode(F.split(F.col(text_col), BLANKS)).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    tokens = cut(tokens.mapInPandas(_shard_keys, "token string, n bigint, looks string").withColumn("look_hash", F.xxhash64("looks")).drop("looks"))
    shards = max(8, -(-tokens.count() // SHARD_TOKENS))
    return tokens.withColumn("shard", F.expr(f"pmod(look_hash, {shards})")).select("shard", "token", "n").groupBy("shard").applyInPandas(_canonical_tokens, "token string, canonical string")


def canonical_texts(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with ``canonical``: the text in canonical spellings, single blanks between, none at the ends."""
    changed = small_side(cut(canonical_spellings(texts, text_col)), BROADCAST_TOKENS)
    distinct = texts.select(F.col(text_col).alias("_t")).filter("_t is not null").distinct()
    words = distinct.withColumn("_w", F.split("_t", BLANKS))
    fixes = (
        words.select("_t", F.posexplode("_w").alias("pos", "token")).join(changed, "token")
        .groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("pos", "canonical"))).alias("fix"))
    )
    rebuilt = fixes.withColumn("_w", F.expr(f"transform(split(_t, r'{BLANKS}'), (w, i) -> coalesce(fix[i], w))"))
    rebuilt = rebuilt.select("_t", F.expr("array_join(filter(_w, w -> w <> ''), ' ')").alias("_fixed"))
    # Whatever columns the texts bring, these two names are not among them.
    rebuilt = rebuilt.select(F.col("_t").alias("__same_look_text"), F.col("_fixed").alias("__same_look_form"))
    blanks = F.trim(F.regexp_replace(F.col(text_col), BLANKS, " "))
    joined = texts.join(rebuilt, F.col(text_col) == F.col("__same_look_text"), "left")
    return joined.withColumn("canonical", F.coalesce("__same_look_form", blanks)).drop("__same_look_text", "__same_look_form")


def _look_keys(texts: DataFrame, id_col: str, field_col: str, text_col: str) -> DataFrame:
    """(id, field, c1, c2, v1, v2): 128-bit keys of the canonical form and of the text itself."""
    forms = canonical_texts(texts.filter(F.col(text_col).isNotNull()), text_col)
    return cut(forms.select(id_col, field_col, F.xxhash64("canonical").alias("c1"), F.xxhash64(F.lit("second"), "canonical").alias("c2"), F.xxhash64(text_col).alias("v1"), F.xxhash64(F.lit("second"), text_col).alias("v2")))


def same_look_pairs(texts: DataFrame, id_col: str, field_col: str, text_col: str) -> DataFrame:
    """(field, id_a, id_b) of texts of one field that look the same but differ."""
    return differing_pairs(_look_keys(texts, id_col, field_col, text_col), [field_col, "c1", "c2"], id_col, ["v1", "v2"]).select(field_col, "id_a", "id_b")


def same_look_classes(texts: DataFrame, id_col: str, field_col: str, text_col: str) -> DataFrame:
    """(id, field, look_class, n_spellings, n_links): one row per text with the class of its look.

    ``look_class`` is the smallest id of the class, ``n_spellings`` the number
    of different strings in it, ``n_links`` the number of rows of the class that
    are another string. Linear in the rows, whatever the size of a class.
    """
    keys = _look_keys(texts, id_col, field_col, text_col)
    values = keys.groupBy(field_col, "c1", "c2", "v1", "v2").agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    classes = values.groupBy(field_col, "c1", "c2").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_spellings"), F.min("first").alias("look_class"))
    sized = values.select(field_col, "c1", "c2", "v1", "v2", "n").join(classes, [field_col, "c1", "c2"])
    joined = keys.join(sized, [field_col, "c1", "c2", "v1", "v2"])
    return joined.select(id_col, field_col, "look_class", "n_spellings", (F.col("n_all") - F.col("n")).alias("n_links"))
