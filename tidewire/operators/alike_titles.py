"""Near duplicates over a whole batch: every title against every kept one, without blocks.

The order decides, so titles are taken in chunks: a chunk meets the titles kept
before it in parallel, what is left of it is folded in one task. Bounds that
can not lose a pair (characters, then longest common subsequence) stand before
the gestalt ratio.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .matching import SPLIT_BLANKS

#: Distinct titles of a chunk; what is left of one is folded in one task.
CHUNK = 20_000
#: Buckets of characters, and how often one is counted in bits.
BUCKETS, TIMES = 80, 4
#: Longest title the subsequence bound can hold in one machine word.
WORD = 64


class Kept:
    """Kept titles in order; ``first`` finds the earliest one that is alike."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.n, self.ids, self.titles = threshold, 0, [], []
        self.codes: dict[str, int] = {}
        self.bits, self.size, self.rest, self.text = np.zeros((5, 1024), np.uint64), np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros((WORD, 1024), np.uint16)

    def _bag(self, t: str) -> tuple[list[int], int]:
        counts = Counter(ord(c) % BUCKETS for c in t)
        bits = 0
        for k, n in counts.items():
            bits |= ((1 << min(n, TIMES)) - 1) << (TIMES * k)
        return [(bits >> (64 * i)) & (2**64 - 1) for i in range(5)], sum(max(n - TIMES, 0) for n in counts.values())

    def _code(self, c: str) -> int:
        return self.codes.setdefault(c, len(self.codes) + 1)

    def add(self, item: int, t: str) -> None:
        if self.n == len(self.size):
            grow = lambda a: np.concatenate([a, np.zeros_like(a)], axis=-1)
            self.bits, self.size, self.rest, self.text = grow(self.bits), grow(self.size), grow(self.rest), grow(self.text)
        i = self.n
        self.bits[:, i], self.rest[i] = self._bag(t)
        self.size[i] = len(t)
        for j, c in enumerate(t[:WORD]):
            self.text[j, i] = self._code(c)
        self.ids.append(item)
        self.titles.append(t)
        self.n += 1

    def first(self, t: str) -> int | None:
        if not t or not self.n:
            return None
        n, size = self.n, self.size[: self.n]
        words, rest = self._bag(t)
        both = np.minimum(self.rest[:n], rest).astype(np.int32)
        for i, w in enumerate(words):
            if w:
                both += np.bitwise_count(self.bits[i, :n] & np.uint64(w))
        least = (self.threshold - 1e-9) * (size + len(t)) / 2
        near = np.flatnonzero((both >= least) & (np.minimum(size, len(t)) >= least))
        for at in range(0, len(near), 512):  # the first one is wanted, so not all at once
            part = near[at : at + 512]
            if len(t) <= WORD:
                part = part[(self._common(t, part) >= least[part]) | (size[part] > WORD)]
            for i in part:
                other = self.titles[i]
                if t == other or difflib.SequenceMatcher(None, t, other).ratio() >= self.threshold:
                    return self.ids[i]
        return None

    def _common(self, t: str, part: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of ``t`` and each kept title, by bits."""
        masks = np.zeros(len(self.codes) + 1, np.uint64)
        for j, c in enumerate(t):
            if k := self.codes.get(c, 0):
                masks[k] |= np.uint64(1 << j)
        full = np.uint64((1 << len(t)) - 1)
        v = np.full(len(part), full, np.uint64)
        for row in self.text[: min(WORD, int(self.size[part].max())), part]:
            m = masks[row]
            u = v & m
            v = (v + u) | (v & ~m)
        return len(t) - np.bitwise_count(v & full).astype(np.int32)


def near_duplicates(items: DataFrame, threshold: float = 0.85, chunk: int = CHUNK) -> DataFrame:
    """(item_id, kept_id): items in order of id; one is dropped for the first kept one of the whole batch that is alike.

    items: (item_id, title). Equal titles are one row first: a copy goes where
    its first item went. A blank title is like no other. Kept titles go to
    every task, so they must fit its memory.
    """
    ends = rf"^{SPLIT_BLANKS}|{SPLIT_BLANKS}$"
    rows = cut(items.select("item_id", F.regexp_replace(F.lower("title"), ends, "").alias("t")))
    titles = cut(rows.filter("t <> ''").groupBy("t").agg(F.min("item_id").alias("first")))
    parts = titles.sparkSession.sparkContext.defaultParallelism
    n = titles.count()
    bounds = titles.approxQuantile("first", [i * chunk / n for i in range(1, -(-n // chunk))], 0.001) if n > chunk else []
    bounds = [None, *sorted({int(b) for b in bounds}), None]
    kept, done = Kept(threshold), None
    for lo, hi in zip(bounds, bounds[1:]):
        now = titles.filter(F.lit(True) if lo is None else F.col("first") > lo).filter(F.lit(True) if hi is None else F.col("first") <= hi)
        if kept.n:
            now = cut(now.repartition(parts).mapInPandas(_against(kept), "t string, first long, kept_id long"))
        else:
            now = now.withColumn("kept_id", F.lit(None).cast("long"))
        left = cut(now.filter("kept_id is null").groupBy().applyInPandas(_fold(threshold), "t string, first long, kept_id long"))
        for item, t in left.filter("first = kept_id").select("first", "t").sort("first").toPandas().itertuples(index=False):
            kept.add(int(item), t)
        part = now.filter("kept_id is not null").unionByName(left).select("t", "kept_id")
        done = part if done is None else done.unionByName(part)
    return rows.join(done, "t", "left").select("item_id", F.coalesce("kept_id", "item_id").alias("kept_id"))


def _against(kept: Kept):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(kept_id=pd.array([kept.first(t) for t in pdf["t"]], dtype="Int64"))

    return run


def _fold(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index, out = Kept(threshold), []
        pdf = pdf.sort_values("first")
        for item, t in zip(pdf["first"], pdf["t"]):
            found = index.first(t)
            if found is None:
                index.add(item, t)
            out.append(item if found is None else found)
        return pdf.assign(kept_id=out)

    return run
