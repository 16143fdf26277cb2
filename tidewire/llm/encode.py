"""Encoding of a corpus with a public tokenizer, and decoding.

Words are split in Spark by the tokenizer's own pattern, each *distinct* word
is encoded once, and the ids are joined back by position. The most frequent
words go to every task as a dictionary bounded in words and bytes
(``HOT_WORDS``, ``HOT_BYTES``): a batch's words become one array of numbers and
the ids are gathered from it, so no hot word moves through a shuffle. Rows whose
words are all in it are done; the words of the others (rare ones, and those
longer than ``HOT_LENGTH`` bytes) are joined by word and put into their gaps by
position. The dictionary is chosen by a histogram of frequencies, and neither
driver nor tasks ever hold more of the word table. Token counts are sums of
counts by word; no ids are made for them.

Edge cases: null and empty texts give an empty list; a text that looks like a
special token is plain text; blank texts have the ids of their blanks; texts
with characters newer than the JVM's Unicode tables are encoded as one word
(the tokenizer splits them itself); repeated rows give repeated rows; empty
tables give empty results.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Words of the broadcast dictionary, their bytes with those of their ids, and the bytes of one word, at most; other words are joined.
HOT_WORDS = 800_000
HOT_BYTES = 80 << 20
HOT_LENGTH = 200
TOKENIZER = "byte_bpe_50k.json"

# Unicode's White_Space, spelled out because Java's \s is ASCII only.
_WS = r"\t-\r \x85" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Fixed value: the split pattern of the byte-level vocabulary.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{_WS}\p{{L}}\p{{N}}]++|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: A noncharacter (class Cn), so it never stands in a text that is split.
_MARK = chr(0xFFFF)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file; a name with a slash is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=2)
def _single_pieces(path: str):
    """Encoder of words that are one piece whatever the Unicode version, from the rank file beside a tokenizer's; None where there is none."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks):
        return None
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={}).encode_ordinary


#: Letters that every Unicode version in use knows, with at most one blank before them.
_PLAIN_WORD = re.compile(r" ?(?:[A-Za-z]+|[0-9]+|[\u4e00-\u9fa5]+|[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[\u0400-\u0481\u048a-\u04ff]+)")


def _marked(text: Column) -> Column:
    """The text with a mark after each word; with one before it where it is one word."""
    return F.when(text.rlike(r"\p{Cn}"), F.concat(F.lit(_MARK), text)).otherwise(F.regexp_replace(text, WORDS, "$0" + _MARK))


def _pieces(marked: str | None) -> list[str]:
    """Words of a marked text; an empty one at the end."""
    if not marked:
        return [""]
    return [marked[1:], ""] if marked[0] == _MARK else marked.split(_MARK)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of the distinct words of all texts, counted by batch before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(_pieces(text))
            seen.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(text_col).alias("t")).filter("t is not null and t <> ''")
    return texts.select(_marked(F.col("t")).alias("t")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``words`` (word, n) with the ids of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, piece = _tokenizer(path), _single_pieces(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if piece is None:
                ids = [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
            else:  # the same merges without the tokenizer's own splitting and offsets
                ids = [piece(w) if _PLAIN_WORD.fullmatch(w) else None for w in words]
                others = [k for k, x in enumerate(ids) if x is None]
                for k, e in zip(others, t.encode_batch_fast([words[k] for k in others], add_special_tokens=False)):
                    ids[k] = e.ids
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n bigint, ids array<int>")


class _Known(dict):
    """Number of a word; -1 for others."""

    def __missing__(self, word: str) -> int:
        return -1


def _hot_words(table: DataFrame, most: int, most_bytes: int) -> tuple[tuple[_Known, np.ndarray, np.ndarray], bool]:
    """(numbers of words, begin of each word's ids, ids) of the most frequent words, and whether these are all."""
    sized = table.select("word", "ids", F.floor(8 * F.log2("n")).cast("int").alias("grade"), (F.octet_length("word") + 4 * F.size("ids")).alias("bytes"), (F.octet_length("word") <= HOT_LENGTH).alias("short"))
    grades = sized.groupBy("grade", "short").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 8 grades for each doubling of frequency
    words = size = 0
    least, every = None, True
    for g in sorted(grades, key=lambda g: -g["grade"]):
        if not g["short"]:
            every = False
        elif every is not None and words + g["n"] <= most and size + g["bytes"] <= most_bytes and (least is None or least > g["grade"]):
            words, size, least = words + g["n"], size + g["bytes"], g["grade"]
        else:
            every = False
            break
    if least is None:
        return (_Known({"": 0}), np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int32)), not grades
    hot = sized.filter(f"short and grade >= {least}").select("word", "ids").toArrow().combine_chunks()
    ids = hot["ids"].combine_chunks()
    begins = np.concatenate([[0], ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()])
    return (_Known({"": 0} | {w: i for i, w in enumerate(hot["word"].to_pylist(), 1)}), begins, ids.flatten().to_numpy()), every


def _word_table(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    return cut(encode_words(word_counts(docs, text_col), tokenizer_path(tokenizer)))


def _numbers(texts: list[str | None], known: _Known) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of all texts, the number of each, and where each text's words end."""
    words: list[str] = []
    ends = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words += _pieces(t)
        ends[i] = len(words)
    return words, np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)), ends


def _gap_lists(words: list[str], missing: np.ndarray, ends: np.ndarray, at: np.ndarray | None) -> list[pa.Array]:
    """Per text, the words that are not known, and the place in its ids each belongs to."""
    offsets = np.concatenate([[0], np.searchsorted(missing, ends)]).astype(np.int32)
    out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array([words[i] for i in missing], pa.string()))]
    return out if at is None else [*out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))]


def _upto(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, hot_words: int = HOT_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id, ids) of every row: token ids without special tokens."""
    table = _word_table(docs, text_col, tokenizer)
    hot, every = _hot_words(table, hot_words, hot_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, missing array<string>, at array<int>"

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begins, flat = shared.value
        for batch in batches:
            words, number, ends = _numbers(batch.column(1).to_pylist(), known)
            missing = np.flatnonzero(number < 0)
            number[missing] = 0
            start = begins[number]
            lengths = begins[number + 1] - start
            upto = _upto(lengths)
            ids = flat[np.arange(upto[-1]) + np.repeat(start - upto[:-1], lengths)]
            borders = np.concatenate([[0], upto[ends]])
            owner = np.searchsorted(ends, missing, side="right")
            gaps = _gap_lists(words, missing, ends, upto[missing] - borders[owner])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids)), *gaps], names=[id_col, "ids", "missing", "at"])

    looked = docs.select(F.col(id_col), _marked(F.col(text_col)).alias("marked")).mapInArrow(lookup, schema)
    if every:
        return looked.select(id_col, "ids")
    looked = cut(looked.withColumn("row_key", F.monotonically_increasing_id()))
    done = looked.filter("size(missing) = 0").select(id_col, "ids")
    open_rows = looked.filter("size(missing) > 0")
    gaps = open_rows.select("row_key", F.posexplode("missing").alias("pos", "word"))
    # A gap's ids by its position; a word that stands in very many gaps is not rare, and AQE splits its partition.
    filled = gaps.join(table.select("word", F.col("ids").alias("found")), "word").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("pos", "found"))).alias("found"))
    pieces = "flatten(concat(transform(found, (f, i) -> concat(slice(ids, if(i = 0, 0, at[i - 1]) + 1, at[i] - if(i = 0, 0, at[i - 1])), f.found)), array(slice(ids, at[size(at) - 1] + 1, size(ids)))))"
    return done.unionByName(open_rows.join(filled, "row_key").select(id_col, F.expr(pieces).alias("ids")))


def token_counts(docs: DataFrame, id_cols: list[str], text_col: str = "text", tokenizer: str = TOKENIZER, hot_words: int = HOT_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id columns, n_tokens) of every row: tokens without special ones."""
    table = _word_table(docs, text_col, tokenizer)
    hot, every = _hot_words(table, hot_words, hot_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((hot[0], np.diff(hot[1])))
    kept = docs.select(F.struct(*id_cols).alias("row"), _marked(F.col(text_col)).alias("marked"))
    schema = f"row {kept.schema['row'].dataType.simpleString()}, n_tokens bigint, missing array<string>"

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        for batch in batches:
            words, number, ends = _numbers(batch.column(1).to_pylist(), known)
            missing = np.flatnonzero(number < 0)
            number[missing] = 0
            upto = _upto(sizes[number])[ends]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(upto, prepend=0)), *_gap_lists(words, missing, ends, None)], names=["row", "n_tokens", "missing"])

    looked = kept.mapInArrow(lookup, schema)
    if every:
        return looked.select("row.*", "n_tokens")
    looked = cut(looked.withColumn("row_key", F.monotonically_increasing_id()))
    gaps = looked.select("row_key", F.explode("missing").alias("word")).groupBy("row_key", "word").agg(F.count("*").alias("times"))
    more = gaps.join(table.select("word", F.size("ids").alias("size")), "word").groupBy("row_key").agg(F.sum(F.col("times") * F.col("size")).alias("more"))
    return looked.join(more, "row_key", "left").select("row.*", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


@lru_cache(maxsize=2)
def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as a printable character; this is the way back."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_table(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, hex) of each piece; one row per vocabulary entry, whatever the corpus."""
    back = _byte_of_char()
    vocabulary = _tokenizer(tokenizer_path(tokenizer)).get_vocab(with_added_tokens=False)
    rows = [(i, bytes(back[c] for c in piece).hex()) for piece, i in vocabulary.items() if all(c in back for c in piece)]
    return docs.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["id", "hex"]), "id int, hex string")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """(row_key, id, text) of each row: pieces joined by id, put together by position."""
    rows = cut(encoded.select(F.col(id_col), F.col(ids_col).alias("ids")).withColumn("row_key", F.monotonically_increasing_id()))
    pieces = F.broadcast(piece_table(encoded, tokenizer))  # bounded by the vocabulary
    each = rows.select("row_key", F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    texts = each.groupBy("row_key").agg(F.expr("decode(unhex(array_join(transform(array_sort(collect_list(struct(pos, hex))), x -> x.hex), '')), 'UTF-8')").alias("text"))
    return rows.join(texts, "row_key", "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))
