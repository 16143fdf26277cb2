"""Per-document text statistics, and the kinds prose, list, table and junk.

Statistics are taken from the whole text in one pass: Arrow batches of texts are
looked at as arrays of code points, whose classes come from a table. A Gaussian
mixture with diagonal covariances is fitted to the standardized statistics of
*all* documents by expectation-maximisation: each step is one pass that returns
only the sums of the sufficient statistics (components by statistics, whatever
the corpus), until a step gains next to nothing. Components start at inspected examples and are mapped to a kind by
the examples they answer for after the fit; a document's kind is the one with
the largest sum of responsibilities.

Edge cases: null, empty and invisible texts have zero statistics and no kind;
an unknown or null language uses the common words of all languages; repeated
rows give repeated rows; empty tables give empty results; very long texts are
read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .quality_examples import examples

ITERATIONS = 12
#: Least variance of a standardized statistic within a component.
FLOOR = 0.05
#: Gain of log likelihood per document below which the fit ends.
LEAST_GAIN = 1e-3
#: Characters of texts that are looked at together (what a core's cache holds); a longer text is looked at alone, whole.
CHARS = 100_000

# Bits of a character's classes.
_WORD, _SPACE, _CJK, _DIGIT, _LETTER, _PLAIN, _ENDER, _WIDE_ENDER, _CLOSER, _UPPER, _ALNUM, _SEPARATOR, _CONSONANT, _LEAD, _TRAIL, _CODE, _BLANK, _DULL, _TRIM = (1 << k for k in range(19))


def _set(*ranges: str) -> set[int]:
    """Code points of single characters and of ranges written as two characters with a dash between."""
    out: set[int] = set()
    for r in ranges:
        out |= set(range(ord(r[0]), ord(r[2]) + 1)) if len(r) == 3 and r[1] == "-" else set(map(ord, r))
    return out


# Characters by what they tell of a text.
_CLASSES = {
    _CJK: _set("\u3040-\u30ff", "\u3400-\u9fff"),
    _PLAIN: _set(".,;:!?'\"()-", "\u2010-\u2026", "\u3000-\u303f", "\uff01-\uff1f", "\u00ab\u00bb\u00b7"),
    _ENDER: _set(".!?\u2026"), _WIDE_ENDER: _set("\u3002\uff01\uff1f"), _CLOSER: _set("\"'\u201d\u2019\u00bb\u300d)\uff09"),
    _SEPARATOR: _set("\t|;>/\u00b7\u2022,\uff0c\u3001"), _CONSONANT: _set("bcdfghjklmnpqrstvwxz"),
    _LEAD: _set("\u00c2\u00c3\u00e2\u00e3\u00c5", "\u00e4-\u00ef"),
    _TRAIL: _set("\u0080-\u00bf", "\u0152-\u0192", "\u02c6-\u02dc", "\u2013-\u203a", "\u20ac\u2122"),
    _CODE: _set("{}<>$=_%[]\\^~#&*@+"), _BLANK: _set(" \t\n\x0b\f\r"),
}
# Words that programs and their output hold.
_CODE_WORDS = ["null", "undefined", "NaN", "function"]
_BULLET = re.compile(r"[ \t\n\x0b\f\r]*(?:[-*\u2022\u00b7\u2013+]|\d{1,3}[.)\u3001])[ \t\n\x0b\f\r]")
_ROW_SHAPE = re.compile(r"^(?:[^\t|;,]*[\t|;,]){3}|[^ \t\n\x0b\f\r] {2,}[^ \t\n\x0b\f\r].* {2,}[^ \t\n\x0b\f\r]|[^ \t\n\x0b\f\r] {2,}\d+ ?: ?\d+ {2,}[^ \t\n\x0b\f\r]")
_ROW_CELLS = re.compile(r"(?:\d.*){2}|^(?:[^\t|;,]*[\t|]){3}")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Classes of every code point as bits; a table of fixed size."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for n in range(0x110000):
        c = chr(n)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        bits = 0
        if kind[0] in "LMN":
            bits |= _WORD
        if kind[0] == "L" or kind[0] == "M":
            bits |= _LETTER
        if kind[0] in "LN":
            bits |= _ALNUM
        if kind == "Nd":
            bits |= _DIGIT
        if kind == "Lu":
            bits |= _UPPER
        if kind[0] == "Z":
            bits |= _DULL | _SPACE | _TRIM
        if kind in ("Cf", "Cc"):
            bits |= _SPACE
        if kind == "Cf":
            bits |= _DULL
        table[n] = bits
    for bit, members in _CLASSES.items():
        table[sorted(members)] |= bit
    table[sorted(_CLASSES[_BLANK])] |= _SPACE | _DULL | _TRIM
    return table


#: Statistics the mixture is fitted to.
FEATURES = [
    "common_share", "cjk_share", "sentence_rate", "line_end_share", "table_share", "bullet_share", "separator_rate", "digit_ratio", "symbol_ratio",
    "capital_share", "repetition", "vowelless_share", "long_token_share", "mojibake_share", "code_share", "word_length", "entry_share",
]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return change[::2], change[1::2]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


class _Counts:
    """Counts of character classes by part of a string of code points."""

    def __init__(self, classes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        self.classes, self.begins, self.ends = classes, begins, ends

    def of(self, flags: np.ndarray) -> np.ndarray:
        """True values within each part."""
        upto = np.zeros(len(flags) + 1, dtype=np.int32)
        np.cumsum(flags, out=upto[1:], dtype=np.int32)
        return upto[self.ends] - upto[self.begins]

    def has(self, bits: int) -> np.ndarray:
        """Which characters are of a class."""
        return (self.classes & bits) != 0


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a noncharacter after each, and where each begins and ends."""
    joined = np.frombuffer("\uffff".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    return joined, ends - sizes, ends


def measure(texts: list[str], langs: list[str | None], common: dict[str, frozenset[str]], common_cjk: re.Pattern | None, table: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text: counts by class of character over all texts at once, words and shapes of lines by text.

    ``common``: words by language, those of all languages under the empty name.
    """
    points, begins, ends = _code_points(texts)
    c = _Counts(table[points], begins, ends)
    size = len(points)
    at = np.arange(size, dtype=np.int32 if size < 2**31 else np.int64)
    after = lambda flags: np.concatenate([flags[1:], [False]])
    before = lambda flags: np.concatenate([[False], flags[:-1]])
    blank, closer, cjk, ender, wide = c.has(_BLANK), c.has(_CLOSER), c.has(_CJK), c.has(_ENDER), c.has(_WIDE_ENDER)
    stop = points == 0xFFFF
    n_chars = (ends - begins).astype(float)
    n_visible = n_chars - c.of(c.has(_SPACE))
    n_cjk, n_digits, n_letters = c.of(cjk).astype(float), c.of(c.has(_DIGIT)), c.of(c.has(_LETTER))
    n_plain = c.of(c.has(_PLAIN))
    # A sentence's end: a mark, closing signs, then a blank or the end of the text.
    follows = np.minimum.accumulate(np.where(closer, size - 1, at)[::-1])[::-1]
    follows = np.concatenate([follows[1:], [size - 1]])
    n_ends = c.of(wide | (ender & (blank | stop)[follows]))
    n_capitals = c.of(c.has(_UPPER) & ~before(c.has(_ALNUM)))
    one = points == 32
    n_separators = c.of(c.has(_SEPARATOR) | (one & after(one) & ~before(one)))
    n_odd = c.of((c.has(_LEAD) & after(c.has(_TRAIL))) | (points == 0xFFFD))
    n_code = c.of(c.has(_CODE)) + np.array([sum(t.count(w) for w in _CODE_WORDS) for t in texts], dtype=np.int64)
    a, b = _runs(~(blank | cjk | stop))
    long = b - a >= 30
    n_long = _sum_by(begins, a[long], (b - a)[long])
    # Lines; those without a visible character do not count.
    newline = (points == 10) | stop
    line_end = np.flatnonzero(newline)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    lines = _Counts(c.classes, line_begin, line_end)
    shown = lines.of(~c.has(_DULL)) > 0
    owner = np.searchsorted(begins, line_begin, side="right") - 1
    by_text = lambda flags, w=None: np.bincount(owner[flags], weights=None if w is None else w[flags], minlength=len(texts)).astype(float)
    trim = c.has(_TRIM)
    # A line's end: its last character that is no blank, and before it the last that is no closing sign.
    last = np.maximum.accumulate(np.where(trim | newline, -1, at))
    solid = np.maximum.accumulate(np.where(closer, -1, at))
    any_end = ender | wide
    final = np.where(line_end > 0, last[np.maximum(line_end - 1, 0)], -1)
    found = np.where(final >= line_begin, solid[np.maximum(final, 0)], -1)
    ended = shown & (found >= line_begin) & any_end[np.maximum(found, 0)]
    width = line_end - line_begin
    n_lines = by_text(shown)
    entry = shown & (lines.of(any_end) == 0) & (width < 58)
    # Only lines that could be bullets or rows are looked at by pattern.
    first = np.minimum.accumulate(np.where(blank & ~newline, size - 1, at)[::-1])[::-1][line_begin]
    signs = np.isin(points[first], sorted(_set("-*\u2022\u00b7\u2013+"))) | c.has(_DIGIT)[first]
    cells = (lines.of(np.isin(points, sorted(_set("\t|;,")))) >= 3) | (lines.of(one & after(one)) > 0)
    bullets, rows = np.zeros(len(texts)), np.zeros(len(texts))
    offset = begins[owner]
    for i in np.flatnonzero(shown & (signs | (cells & ~ended))):
        line = texts[owner[i]][line_begin[i] - offset[i] : line_end[i] - offset[i]]
        bullets[owner[i]] += signs[i] and _BULLET.match(line) is not None
        rows[owner[i]] += cells[i] and not ended[i] and _ROW_SHAPE.search(line) is not None and _ROW_CELLS.search(line) is not None
    # Words of the lower-case texts.
    lows = [t.lower() for t in texts]
    points, low_begin, low_end = _code_points(lows)
    w = _Counts(table[points], low_begin, low_end)
    word = w.has(_WORD)
    a, b = _runs(word)
    upto = np.concatenate([[0], np.cumsum(w.has(_CJK), dtype=np.int32)])
    spaced = upto[a] == upto[b]
    n_words = _sum_by(low_begin, a, np.ones(len(a)))
    n_spaced = _sum_by(low_begin, a[spaced], np.ones(int(spaced.sum())))
    a, b = _runs(w.has(_ALNUM))
    upto = np.concatenate([[0], np.cumsum(w.has(_CONSONANT), dtype=np.int32)])
    bare = (b - a >= 3) & (upto[b] - upto[a] == b - a)
    n_vowelless = _sum_by(low_begin, a[bare], np.ones(int(bare.sum())))
    parted = np.where(word, points, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    n_common, n_distinct, n_common_cjk = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    every = common[""]
    for i, lang in enumerate(langs):
        words = parted[low_begin[i] : low_end[i]].split()
        n_distinct[i] = len(set(words))
        n_common[i] = sum(map(common.get(lang, every).__contains__, words))
        if n_cjk[i] and common_cjk:
            n_common_cjk[i] = sum(1 for _ in common_cjk.finditer(texts[i]))
    units = n_spaced + n_cjk
    features = {
        "common_share": np.where(n_cjk > n_spaced, np.minimum(1, 4 * _ratio(n_common_cjk, n_cjk)), _ratio(n_common, n_spaced)),
        "cjk_share": _ratio(n_cjk, n_visible), "sentence_rate": np.minimum(2, _ratio(15.0 * n_ends, n_spaced + n_cjk / 2)),
        "line_end_share": _ratio(by_text(ended), n_lines), "table_share": _ratio(rows, n_lines), "bullet_share": _ratio(bullets, n_lines),
        "separator_rate": np.minimum(2, _ratio(n_separators, n_spaced + n_cjk / 3)), "digit_ratio": _ratio(n_digits, n_visible),
        "symbol_ratio": np.maximum(0, _ratio(n_visible - n_letters - n_digits - n_plain, n_visible)), "capital_share": _ratio(n_capitals, units),
        "repetition": np.where(n_words >= 8, 1 - _ratio(n_distinct, n_words), 0), "vowelless_share": _ratio(n_vowelless, n_spaced),
        "long_token_share": _ratio(n_long, n_visible), "mojibake_share": np.minimum(1, 4 * _ratio(n_odd, n_visible)),
        "code_share": np.minimum(1, 2 * _ratio(n_code, n_visible)), "word_length": np.minimum(20, _ratio(n_letters - n_cjk, n_spaced)),
        "entry_share": np.minimum(1, _ratio(by_text(entry, width), n_chars)),
    }
    return features | {"n_visible": n_visible, "n_words": units, "n_lines": n_lines}


def _sum_by(begins: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of weights by the text that the place ``at`` lies in."""
    return np.bincount(np.searchsorted(begins, at, side="right") - 1, weights=weight, minlength=len(begins)).astype(float)


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_visible, n_words, mean_word_length, symbol_ratio, ..., features) of every row.

    ``common_words`` is a short list of frequent words by language; it and the
    table of characters (of fixed size) are broadcast.
    """
    by_lang: dict[str, set[str]] = {"": set()}
    for lang, word in common_words.select(F.lower("lang"), F.lower("word")).dropna().distinct().collect():
        by_lang[""].add(word)
        by_lang.setdefault(lang[:2], set()).add(word)
    cjk = sorted((w for w in by_lang[""] if _is_cjk(w)), key=lambda w: (-len(w), w))
    common = {lang: frozenset(w for w in ws if not _is_cjk(w)) for lang, ws in by_lang.items()}
    common = {lang: ws for lang, ws in common.items() if ws or not lang}
    shared = docs.sparkSession.sparkContext.broadcast((common, "|".join(map(re.escape, cjk)), class_table()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cjk_words, table = shared.value
        pattern = re.compile(cjk_words) if cjk_words else None
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars + len(texts[end]) <= CHARS):
                    chars += len(texts[end])
                    end += 1
                m = measure(texts[begin:end], langs[begin:end], common, pattern, table)
                stacked = np.stack([m[f] for f in FEATURES], 1)
                features = pa.ListArray.from_arrays(pa.array(np.arange(end - begin + 1, dtype=np.int32) * len(FEATURES)), pa.array(stacked.ravel()))
                counts = [pa.array(m[x].astype(np.int64)) for x in ("n_visible", "n_words", "n_lines")]
                means = [pa.array(m[x].astype(float)) for x in ("word_length", "symbol_ratio", "line_end_share", "common_share")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *counts, *means, features], names=names)
                begin = end

    names = [id_col, "n_visible", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "line_end_share", "common_share", "features"]
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("t"), F.lower(F.substring(F.trim(lang_col), 1, 2)).alias("lang"))
    return rows.mapInArrow(run, f"{id_col} {kind}, n_visible bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, line_end_share double, common_share double, features array<double>")


def _is_cjk(word: str) -> bool:
    return any("぀" <= c <= "鿿" for c in word)


def _log_density(x: np.ndarray, model: dict) -> np.ndarray:
    """Log of weight times density, rows by components."""
    out = np.empty((len(x), len(model["weight"])))
    for k, (w, m, v) in enumerate(zip(model["weight"], model["mean"], model["var"])):
        out[:, k] = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(1))
    return out


def responsibilities(x: np.ndarray, model: dict) -> np.ndarray:
    """Share of each component in each row."""
    d = _log_density(x, model)
    d = np.exp(d - d.max(1, keepdims=True))
    return d / d.sum(1, keepdims=True)


def example_statistics(spark: SparkSession, common_words: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Kinds, groups and statistics of the inspected examples."""
    rows = examples()
    df = spark.createDataFrame([(i, lang, text) for i, (_, _, lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    got = {r["doc_id"]: list(r["features"]) for r in text_statistics(df, common_words).collect()}
    return [r[0] for r in rows], [r[1] for r in rows], np.array([got[i] for i in range(len(rows))])


def fit_mixture(stats: DataFrame, kinds: list[str], groups: list[str], seen: np.ndarray, iterations: int = ITERATIONS) -> dict:
    """Mixture fitted to the ``features`` of all rows, components mapped to kinds.

    ``seen``: statistics of inspected examples; each of their groups starts a component.
    """
    n = len(FEATURES)
    moments = stats.select(*[f(F.get("features", F.lit(i))).alias(f"{a}{i}") for i in range(n) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments["m0"] is None:
        centre, scale = seen.mean(0), seen.std(0) + 1e-9
    else:
        centre = np.array([moments[f"m{i}"] for i in range(n)])
        scale = np.maximum(np.array([moments[f"s{i}"] for i in range(n)]), 0.02)
    z = (seen - centre) / scale
    names = sorted(set(groups))
    member = np.array([names.index(g) for g in groups])
    model = {
        "centre": centre, "scale": scale, "weight": np.full(len(names), 1 / len(names)),
        "mean": np.array([z[member == k].mean(0) for k in range(len(names))]), "var": np.full((len(names), n), 0.5),
    }
    reached = -np.inf
    for _ in range(iterations):
        sums = _sums(stats, model)
        if sums is None:
            break
        mass, first, second, likelihood = sums
        total = mass.sum()
        keep = mass > 1e-6
        mean = np.where(keep[:, None], first / np.maximum(mass, 1e-9)[:, None], model["mean"])
        var = np.where(keep[:, None], second / np.maximum(mass, 1e-9)[:, None] - mean**2, model["var"])
        model |= {"weight": np.maximum(mass / total, 1e-6), "mean": mean, "var": np.maximum(var, FLOOR)}
        if likelihood / total - reached < LEAST_GAIN:
            break
        reached = likelihood / total
    # A component is of the kind whose examples it answers for; one that answers for none keeps the kind of its start.
    share = responsibilities(z, model)
    order = sorted(set(kinds))
    votes = np.array([[share[[i for i, x in enumerate(kinds) if x == kind], k].sum() for kind in order] for k in range(len(names))])
    start = {g: k for g, k in zip(groups, kinds)}
    model["kinds"] = [order[int(v.argmax())] if v.sum() > 0.5 else start[names[k]] for k, v in enumerate(votes)]
    return model


def _standard(batch: pa.RecordBatch, name: str, model: dict) -> np.ndarray:
    """Standardized statistics of a batch, rows by statistics."""
    return (batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) - model["centre"]) / model["scale"]


def _sums(stats: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Mass, sums and sums of squares by component over all rows, and the log likelihood."""
    k, n = model["mean"].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, likelihood = np.zeros((k, 1 + 2 * n)), 0.0
        for batch in batches:
            if batch.num_rows:
                x = _standard(batch, "features", model)
                d = _log_density(x, model)
                most = d.max(1, keepdims=True)
                r = np.exp(d - most)
                total = r.sum(1, keepdims=True)
                likelihood += float((np.log(total) + most).sum())
                r /= total
                acc += np.hstack([r.sum(0)[:, None], r.T @ x, r.T @ (x * x)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.size + 1, dtype=np.int32)), pa.array(np.append(acc.ravel(), likelihood))], names=["cell", "v"])

    rows = stats.select("features").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return None
    out = np.zeros(k * (1 + 2 * n) + 1)
    for r in rows:
        out[r["cell"]] = r["v"]
    cells = out[:-1].reshape(k, 1 + 2 * n)
    return (cells[:, 0], cells[:, 1 : n + 1], cells[:, n + 1 :], out[-1]) if cells[:, 0].sum() > 0 else None


def classify(stats: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, share) of each row by the kind with the largest responsibility."""
    order = sorted(set(model["kinds"]))
    kind_of = np.array([order.index(k) for k in model["kinds"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = responsibilities(_standard(batch, "features", model), model)
                by = np.stack([r[:, kind_of == j].sum(1) for j in range(len(order))], 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([order[j] for j in by.argmax(1)]), pa.array(by.max(1))], names=[id_col, "kind", "share"])

    return stats.select(id_col, "features").mapInArrow(run, f"{id_col} {stats.schema[id_col].dataType.simpleString()}, kind string, share double")


def text_kinds(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, share) of each document with a visible character."""
    stats = cut(text_statistics(docs, common_words, id_col).filter("n_visible > 0").select(id_col, "features"))
    kinds, groups, seen = example_statistics(docs.sparkSession, common_words)
    return classify(stats, fit_mixture(stats, kinds, groups, seen), id_col)
