"""Main body of pages that mix it with navigation, notices, teasers and footers.

A page is a tree of nodes that are content or furniture: the page, its parts
before, in and after the running story, the elements that span lines (nested as
the markup nests them), blocks of neighbouring lines, lines, and the elements
inside a line down to its text. A text's own potential comes from a logistic
model over its form, element, words, place on the page and the terms it shares
with the story. Every node has a parent-child potential of its kind. All but
the texts are latent: the potentials are learned by expectation-maximisation,
whose expectations are the pairwise beliefs of the same sum-product messages
that score pages: up from the texts, and down again to each child without what
the child itself sent. All pages of a batch pass their messages level by level.

Labelled pages are of two kinds. ``labelled_pages.PAGES`` pages are put
together from lines written for the purpose, none from the corpus. Up to
``MARKED_PAGES`` pages (a bounded sample, lowest hash of the id, none longer
than ``MARKED_CHARS``) are taken from the corpus where it has semantic markup,
which labels its own lines: paragraphs, headings, quotations and items without
a link are content; nav, footer, aside, time, small headings, links and texts
in bare divisions are not. Such labels err (a line of tags may stand in a
paragraph): those a model of the written pages alone holds for almost surely
wrong are dropped, the others are learned with and without their markup. A
corpus without such pages is scored by the written pages alone.

Training runs once per query on the driver; pages are then scored row by row,
so nothing shuffles and a page's size is the only unit of memory.

Edge cases: null, empty and blank contents have no lines; a page without prose
is judged line by line; null titles and source names only switch their
features off; repeated rows give repeated rows; pages are read whole; elements
nested deeper than ``DEEPEST`` hang on the one at that depth.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import PAGES, pages
from .lookalike import expand

#: Pages of the corpus that label themselves by their markup, at most.
MARKED_PAGES = 700
#: Characters of such a page, at most; longer ones are scored but not learned from.
MARKED_CHARS = 20_000
#: Labels from markup to which the written pages give a smaller probability are dropped.
LEAST_TRUST = 0.2
#: Words that occur in fewer labelled lines have no weight of their own.
LEAST_LINES = 2
STEPS = 300
RIDGE = 3e-5
ROUNDS = 6
DEEPEST = 64

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CJK = re.compile(r"[぀-鿿]")
_ENDS = re.compile(r"[.!?。！？…][\"'”’“»」）)]*$")
_INNER_END = re.compile(r"[.!?][\"'”’“»]* +(?=[^\W\d_a-z])|[。！？]")
_SEPARATOR = re.compile(r"[|·>»/•]| {2,}")
_CLOCK = re.compile(r"\d{1,2}:\d{2}")
_TAG_GROUP = {
    "p": "p", "article": "p", "main": "p", "h1": "h1", "h2": "h2", "h3": "h2", "li": "li", "ul": "li", "ol": "li", "blockquote": "quote", "q": "quote", "div": "div", "section": "div", "span": "span", "nav": "nav", "footer": "footer",
    "aside": "aside", "header": "nav", "form": "aside", "button": "aside", "h4": "small", "h5": "small", "h6": "small", "time": "small", "a": "link",
}
_TAGS = ["none", "p", "h1", "h2", "li", "quote", "div", "span", "nav", "footer", "aside", "small", "link", "other"]
_TAG_AT = {t: k for k, t in enumerate(_TAGS)}
_BODY_TAGS, _OTHER_TAGS = {"p", "h1", "h2", "li", "quote"}, {"nav", "footer", "aside", "small", "link", "div", "span"}
_FORMS = [
    "bias", "sentence_end", "inner_ends", "length", "long", "prose", "caps", "separators", "clock", "number", "colon", "quote", "copyright", "short", "has_term", "term_share", "term_and_end", "foreign",
    "source", "is_title", "title_part", "before", "after", "between", "near_prose", "item_comma", "before_title", "after_title_like", "between_end", "after_not_end", "markup",
]
_N_FORMS = len(_FORMS)
_ONE_HOT = [tuple(float(t == x) for x in _TAGS) for t in _TAGS]
# Kinds of nodes: the page, parts (3), blocks and lines (prose or not, by part: 6 each), elements by tag group.
_PART, _BLOCK, _LINE, _ELEMENT = 1, 4, 10, 16
_KINDS = _ELEMENT + len(_TAGS)


class _Looks(dict):
    """Character by character table of looks, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = look = expand(chr(code))
        return look


_LOOKS = _Looks()
# Characters that are in one composed form already.
_USUAL = re.compile(r"[ -~¡-¬®-ÿŒœ–-„•…、-】ぁ-ゖァ-ー一-鿿（），：；？！]*")


def _clean(line: str) -> str:
    if not line.isascii() and not _USUAL.fullmatch(line):
        line = unicodedata.normalize("NFC", line.translate(_LOOKS))
    return " ".join(line.split())


def _lexical(text: str, cjk: bool) -> list[str]:
    """Words of a line; pairs of characters where words are not set apart."""
    low = text.casefold()
    if cjk:
        return [low[k : k + 2] for k in range(len(low) - 1)]
    return ["0" if w.isdigit() else w for w in _WORD.findall(low)]


class Page:
    """Lines of one page with their features, and the page's tree.

    ``kinds``, ``parents``, ``depths``: the nodes, the page first; ``leaf[i]``: the node of text ``i``, which is line ``numbers[i]``.
    """

    __slots__ = ("depths", "kinds", "leaf", "numbers", "parents", "rows", "words")

    def __init__(self, title: str | None, source: str | None, lines: list[str], common: frozenset[str] = frozenset()) -> None:
        """``common``: words that do not tell one story from another."""
        self.numbers: list[int] = []
        texts: list[str] = []
        inner: list[list[str]] = []
        raw_wide: list[bool] = []
        moves: list[list[str | None]] = []  # elements opened (group) or closed (None) before each text
        pending: list[str | None] = []
        has_markup = False
        for no, line in enumerate(lines):
            if not line or line.isspace():
                continue
            tags: list[str] = []
            text = line
            if "<" in line and (marks := _TAG.findall(line)):
                has_markup = True
                text = _TAG.sub(" ", line)
                if not text.strip():  # elements that span lines open or close
                    pending += [None if close else _TAG_GROUP.get(tag.lower(), "other") for close, tag in marks]
                else:
                    tags = [_TAG_GROUP.get(tag.lower(), "other") for close, tag in marks if not close][:3]
            wide = "  " in text.strip()
            self.numbers.append(no)
            texts.append(_clean(text))
            inner.append(tags)
            raw_wide.append(wide)
            moves.append(pending)
            pending = []
        n = len(texts)
        title_text = _clean(title).casefold() if title else ""
        title_words = set(_lexical(title_text, _CJK.search(title_text) is not None))
        source_text = _clean(source).casefold() if source else ""
        low = [t.casefold() for t in texts]
        cjk = [not t.isascii() and _CJK.search(t) is not None for t in texts]
        caps = [t.isupper() for t in texts]
        ends = [_ENDS.search(t) is not None for t in texts]
        has_source = [source_text != "" and source_text in x for x in low]
        words = [_lexical(t, z) for t, z in zip(texts, cjk)]
        telling = [{w for w in ws if w not in common and w != "0" and (z or len(w) > 2)} for ws, z in zip(words, cjk)]
        # Terms of the story: telling words of the title, and those of several long sentences.
        whole = [e and not s and not u for e, s, u in zip(ends, has_source, caps)]
        counts: dict[str, int] = {}
        for t, w, z, ws in zip(texts, whole, cjk, telling):
            if w and len(t) >= (27 if z else 70):
                for x in ws:
                    counts[x] = counts.get(x, 0) + 1
        terms = {w for w in title_words if w not in common and w != "0"} | {x for x, c in counts.items() if c >= 2}
        has_term = [not terms.isdisjoint(ws) for ws in telling]
        prose = [w and len(t) >= ((14 if z else 36) if h else (27 if z else 70)) for w, t, z, h in zip(whole, texts, cjk, has_term)]
        real = [i for i in range(n) if prose[i] and has_term[i]] or [i for i in range(n) if prose[i]]
        first, last = (real[0], real[-1]) if real else (n, -1)
        near = [9.0] * n
        gap = 9.0
        for i in range(n):
            gap = 0.0 if prose[i] else gap + 1
            near[i] = min(9.0, gap)
        gap = 9.0
        for i in range(n - 1, -1, -1):
            gap = 0.0 if prose[i] else gap + 1
            near[i] = min(near[i], gap)
        self.rows: list[tuple] = []
        self.words: list[list[str]] = []
        self.kinds, self.parents, self.depths, self.leaf = [0], [-1], [0], []
        part_node = [0, 0, 0]
        stack: list[int] = []
        block = holder = -1
        title_end = title_text.rstrip(" .…?!")
        for i, t in enumerate(texts):
            size = len(t) * (2.6 if cjk[i] else 1)
            before, after = i < first, i > last
            between = not before and not after
            story = prose[i] and has_term[i]
            tag = inner[i][0] if inner[i] else "none"
            if story:  # running text of the story: its form says enough
                is_title, part, foreign, seps, clock, number, share = False, 0.0, 0.0, 0, False, False, 0.3
            else:
                is_title = title_text != "" and (low[i] == title_text or low[i].rstrip(" .…?!") == title_end)
                part = sum(w in title_words for w in words[i]) / max(1, len(words[i]))
                own = telling[i]
                share = len(own & terms) / max(1, len(words[i]))
                foreign = len(own - terms) / max(1, len(words[i]))
                seps = min(4, len(_SEPARATOR.findall(t)) + raw_wide[i])
                clock = _CLOCK.search(t) is not None
                number = "0" in words[i] or any(c.isdigit() for c in t)
            h = has_term[i]
            self.rows.append((
                1, ends[i], min(3, len(_INNER_END.findall(t))), min(3, size / 60), size > 130, prose[i], caps[i], seps, clock, number,
                t[-1:] in ":：" or ": " in t or "：" in t, t[:1] in "“„«\"「'‘", "©" in t, size < 30, h, share, h and ends[i], foreign,
                has_source[i], is_title, part, before, after, between, 1 / (1 + near[i]), "," in t or "，" in t, before and is_title, after and part > 0.3 and not h, between and ends[i], after and not ends[i], has_markup,
                *_ONE_HOT[_TAG_AT[tag]],
            ))
            self.words.append([] if story else words[i])
            # The tree: part, elements that span lines, block, line, elements inside the line.
            at = 0 if before else 1 if between else 2
            if not part_node[at]:
                part_node[at] = self._node(_PART + at, 0)
            for move in moves[i]:
                if move is None:
                    if stack:
                        stack.pop()
                else:
                    stack.append(self._node(_ELEMENT + _TAG_AT[move], stack[-1] if stack else part_node[at]))
            above = stack[-1] if stack else part_node[at]
            k = 3 * (not prose[i]) + at
            if block < 0 or prose[i] or prose[i - 1] or above != holder:
                block, holder = self._node(_BLOCK + k, above), above
            node = self._node(_LINE + k, block)
            for x in inner[i]:
                node = self._node(_ELEMENT + _TAG_AT[x], node)
            self.leaf.append(node)

    def _node(self, kind: int, parent: int) -> int:
        if self.depths[parent] >= DEEPEST:
            parent = self.parents[parent]
        self.kinds.append(kind)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        return len(self.kinds) - 1


def _matrix(made: list[Page], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Form features of all lines, and (line, word, value) of their known words."""
    rows = [r for p in made for r in p.rows]
    forms = np.array(rows, dtype=np.float32).reshape(len(rows), _N_FORMS + len(_TAGS))
    line_at, word_at, value = [], [], []
    at = 0
    for p in made:
        for words in p.words:
            known = [k for w in words if (k := vocabulary.get(w)) is not None]
            if known:
                line_at += [at] * len(known)
                word_at += known
                value += [1 / (len(words) ** 0.5)] * len(known)
            at += 1
    return forms, np.array(line_at, dtype=np.int64), np.array(word_at, dtype=np.int64), np.array(value, dtype=np.float32)


def _logits(forms: np.ndarray, line_at: np.ndarray, word_at: np.ndarray, value: np.ndarray, model: dict) -> np.ndarray:
    return forms @ model["forms"] + np.bincount(line_at, weights=model["words"][word_at] * value, minlength=len(forms))


class Forest:
    """The trees of a batch of pages, their nodes sorted into levels."""

    def __init__(self, made: list[Page]) -> None:
        base = np.cumsum([0] + [len(p.kinds) for p in made])
        join = lambda name: np.concatenate([np.array(getattr(p, name), dtype=np.int64) for p in made]) if made else np.zeros(0, np.int64)
        start = np.repeat(base[:-1], [len(p.kinds) for p in made])
        self.size = int(base[-1])
        self.kind, depth = join("kinds"), join("depths")
        self.parent = join("parents") + start
        self.leaf = join("leaf") + np.repeat(base[:-1], [len(p.leaf) for p in made])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []

    def beliefs(self, own: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of all nodes, and of each node with its parent (node, parent's state, own state), unnormalised.

        ``own``: log potentials of the texts in both states.
        """
        gathered = np.zeros((self.size, 2))
        gathered[self.leaf] = own
        psi = model["psi"][self.kind]
        up = np.zeros((self.size, 2))
        for level in self.levels[:0:-1]:  # up: summed over the child's states
            x = psi[level] + gathered[level][:, None, :]
            up[level] = m = np.logaddexp(x[:, :, 0], x[:, :, 1])
            for s in (0, 1):
                gathered[:, s] += np.bincount(self.parent[level], weights=m[:, s], minlength=self.size)
        down = np.zeros((self.size, 2))
        pair = np.zeros((self.size, 2, 2))
        if self.levels:
            down[self.levels[0]] = model["root"]
        for level in self.levels[1:]:  # down: all the parent knows but from this child, summed over the parent's states
            at = self.parent[level]
            rest = gathered[at] + down[at] - up[level]
            rest -= rest.max(1, keepdims=True)
            x = rest[:, :, None] + psi[level]
            down[level] = np.logaddexp(x[:, 0, :], x[:, 1, :])
            pair[level] = x + gathered[level][:, None, :]
        return gathered + down, pair


def _share(belief: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))


def markup_labels(lines: list[str]) -> list[bool | None]:
    """What semantic markup says of each line: content, furniture, or nothing."""
    out: list[bool | None] = []
    for line in lines:
        groups = [_TAG_GROUP.get(t.lower(), "other") for close, t in _TAG.findall(line) if not close]
        text = _TAG.sub("", line).strip()
        if not groups or not text:
            out.append(None)
        elif _OTHER_TAGS & set(groups) and not ("p" in groups and not {"nav", "footer", "aside"} & set(groups)):
            out.append(False)
        else:
            out.append(True if _BODY_TAGS & set(groups) else None)
    return out


def marked_pages(docs: DataFrame, id_col: str, text_col: str, title_col: str, source_col: str, count: int = MARKED_PAGES, chars: int = MARKED_CHARS) -> list[dict]:
    """At most ``count`` pages of the corpus with the labels of their own markup, each with and without it."""
    fit = docs.filter(F.col(text_col).contains("<p") & (F.length(text_col) <= chars)).withColumn("_share", F.shiftrightunsigned(F.xxhash64(id_col), 11))
    # Only a count and then the sampled pages reach the driver, however many tasks read the corpus.
    n = fit.count()
    fit = fit.filter(F.col("_share") < F.lit(int(2**53 * min(1.0, 1.2 * count / max(1, n)))))
    fit = fit.groupBy("_share").agg(F.min(F.struct(F.col(text_col).alias("x"), F.col(title_col).alias("t"), F.col(source_col).alias("s"))).alias("page")).orderBy("_share").limit(count)
    out, seen = [], set()
    for r in fit.select("page.*").collect():
        lines = r.x.split("\n")
        labels = markup_labels(lines)
        if r.x in seen or len(set(labels) - {None}) < 2:
            continue
        seen.add(r.x)
        out.append({"title": r.t, "source_name": r.s, "lines": lines, "labels": labels})
        out.append({"title": r.t, "source_name": r.s, "lines": [_TAG.sub(" ", x) for x in lines], "labels": labels})
    return out


def train(count: int = PAGES, marked: list[dict] | None = None, written: list[dict] | None = None) -> dict:
    """Line model and parent-child potentials from ``count`` written pages (or ``written``) and the ``marked`` ones."""
    first, model = _written(count) if written is None else (written, _fit(written))
    if not marked:
        return model
    made = [Page(x["title"], x["source_name"], x["lines"], model["common"]) for x in marked]
    share, at, kept = marginals(made, model), 0, []
    for x, p in zip(marked, made):
        labels = list(x["labels"])
        for k, no in enumerate(p.numbers):
            if labels[no] is not None and (share[at + k] if labels[no] else 1 - share[at + k]) < LEAST_TRUST:
                labels[no] = None
        at += len(p.numbers)
        kept.append(x | {"labels": labels})
    return _fit(first + kept)


@lru_cache(maxsize=2)
def _written(count: int) -> tuple[list[dict], dict]:
    """The written pages and the model of these alone; the same in every query of a session."""
    made = pages(count)
    return made, _fit(made)


def _fit(labelled: list[dict]) -> dict:
    seen: dict[str, int] = {}
    stories: dict[str, set] = {}
    for no, x in enumerate(labelled):
        for line in x["lines"]:
            clean = _clean(_TAG.sub(" ", line))
            for w in set(_lexical(clean, _CJK.search(clean) is not None)):
                seen[w] = seen.get(w, 0) + 1
                stories.setdefault(w, set()).add(x["title"] or no)
    # Words of few stories, names for the most part, have no weight of their own and tell stories apart.
    least = max(LEAST_LINES, len(labelled) // 400)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c >= LEAST_LINES and len(stories[w]) >= least))}
    common = frozenset(w for w in vocabulary if len(stories[w]) >= 2 * least)
    made = [Page(x["title"], x["source_name"], x["lines"], common) for x in labelled]
    labels = [x["labels"][no] for x, p in zip(labelled, made) for no in p.numbers]
    known = np.array([v is not None for v in labels])
    y = np.array([float(bool(v)) for v in labels])
    forms, line_at, word_at, value = _matrix(made, vocabulary)
    w_forms, w_words = np.zeros(forms.shape[1]), np.zeros(len(vocabulary))
    m = [np.zeros_like(w_forms), np.zeros_like(w_words)]
    v = [np.zeros_like(w_forms), np.zeros_like(w_words)]
    for step in range(1, STEPS + 1):
        z = _logits(forms, line_at, word_at, value, {"forms": w_forms, "words": w_words})
        error = known * (1 / (1 + np.exp(-z)) - y) / known.sum()
        grads = [forms.T @ error + RIDGE * w_forms, np.bincount(word_at, weights=error[line_at] * value, minlength=len(vocabulary)) + RIDGE * w_words]
        for k, (w, g) in enumerate(zip((w_forms, w_words), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w -= 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    forest = Forest(made)
    # What a text's kind alone says is taken out of the line model: the tree brings it again.
    leaf_kind = forest.kind[forest.leaf]
    counts = np.ones((_KINDS, 2)) + np.stack([np.bincount(leaf_kind, weights=known * (y == s), minlength=_KINDS) for s in (0, 1)], 1)
    model = {
        "forms": w_forms, "words": w_words, "vocabulary": vocabulary, "common": common, "prior": np.log(counts / counts.sum(1, keepdims=True)),
        "psi": np.log(np.tile([[0.8, 0.2], [0.2, 0.8]], (_KINDS, 1, 1))), "root": np.log([0.5, 0.5]),
    }
    clamped = np.where(known[:, None], np.where(np.stack([y == 0, y == 1], 1), 0.0, -30.0), 0.0)
    for _ in range(ROUNDS):
        belief, pair = forest.beliefs(clamped, model)
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        pair /= pair.sum((1, 2), keepdims=True)
        expected = np.full((_KINDS, 2, 2), 2.0) + np.eye(2) * 3
        for a in (0, 1):
            for b in (0, 1):
                w = pair[:, a, b].copy()
                w[forest.levels[0]] = 0
                expected[:, a, b] += np.bincount(forest.kind, weights=w, minlength=_KINDS)
        model["psi"] = np.log(expected / expected.sum(2, keepdims=True))
        share = _share(belief[forest.levels[0]]).mean()
        model["root"] = np.log(np.clip([1 - share, share], 0.05, 0.95))
    return model


def marginals(made: list[Page], model: dict) -> np.ndarray:
    """Probability of being content of every line of the pages, one after the other."""
    forms, line_at, word_at, value = _matrix(made, model["vocabulary"])
    if not len(forms):
        return np.zeros(0)
    forest = Forest(made)
    return _share(forest.beliefs(own_potentials(forms, line_at, word_at, value, forest, model), model)[0][forest.leaf])


def own_potentials(forms: np.ndarray, line_at: np.ndarray, word_at: np.ndarray, value: np.ndarray, forest: Forest, model: dict) -> np.ndarray:
    """Log potentials of the texts in both states, without what their kind says alone."""
    z = np.clip(_logits(forms, line_at, word_at, value, model), -30, 30)
    return np.stack([-np.logaddexp(0, z), -np.logaddexp(0, -z)], 1) - model["prior"][forest.kind[forest.leaf]]


#: Pages whose messages are passed together.
BATCH = 256


def _model_of(docs: DataFrame, id_col: str, text_col: str, title_col: str, source_col: str, written: int, marked: int) -> dict:
    return train(written, marked_pages(docs, id_col, text_col, title_col, source_col, marked) if marked else None)


def line_marginals(docs: DataFrame, id_col: str = "article_id", text_col: str = "content", title_col: str = "title", source_col: str = "source_name", written: int = PAGES, marked: int = MARKED_PAGES) -> DataFrame:
    """(id, line_no, content_share) of every non-blank line."""
    known = docs.sparkSession.sparkContext.broadcast(_model_of(docs, id_col, text_col, title_col, source_col, written, marked))  # bounded by the labelled pages
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, line_no int, content_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                ids, titles, sources, texts = (c.to_pylist() for c in batch.slice(start, BATCH).columns)
                made = [Page(t, s, x.split("\n"), m["common"]) for t, s, x in zip(titles, sources, texts)]
                p = marginals(made, m)
                counts = [len(x.numbers) for x in made]
                yield pa.RecordBatch.from_pydict({
                    id_col: pa.array(np.repeat(np.array(ids, dtype=object), counts), batch.schema.field(0).type),
                    "line_no": pa.array(np.array([no for x in made for no in x.numbers], dtype=np.int32)),
                    "content_share": pa.array(p, pa.float64()),
                })

    cols = docs.select(F.col(id_col), F.col(title_col), F.col(source_col), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    return cols.mapInArrow(run, schema)


def furniture_lines(docs: DataFrame, threshold: float = 0.5, **columns: str) -> DataFrame:
    """(id, line_no) of each non-blank line outside the main body."""
    lines = line_marginals(docs, **columns)
    return lines.filter(F.col("content_share") < threshold).drop("content_share")


def main_bodies(docs: DataFrame, threshold: float = 0.5, id_col: str = "article_id", text_col: str = "content", title_col: str = "title", source_col: str = "source_name", written: int = PAGES, marked: int = MARKED_PAGES) -> DataFrame:
    """(id, body): the lines of the main body of each page, in order; null where there is no content."""
    known = docs.sparkSession.sparkContext.broadcast(_model_of(docs, id_col, text_col, title_col, source_col, written, marked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        for pdf in batches:
            bodies = []
            for start in range(0, len(pdf), BATCH):
                part = pdf.iloc[start : start + BATCH]
                split = [x.split("\n") if isinstance(x, str) else [] for x in part["text"]]
                made = [Page(t, s, x, m["common"]) for t, s, x in zip(part["t"], part["s"], split)]
                p, at = marginals(made, m), 0
                for text, lines, page in zip(part["text"], split, made):
                    n = len(page.numbers)
                    keep = [_TAG.sub(" ", lines[no]).strip() for no, share in zip(page.numbers, p[at : at + n]) if share >= threshold]
                    bodies.append("\n".join(x for x in keep if x) if isinstance(text, str) else None)
                    at += n
            yield pd.DataFrame({id_col: pdf[id_col], "body": bodies})

    cols = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(title_col).alias("t"), F.col(source_col).alias("s"))
    return cols.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, body string")
