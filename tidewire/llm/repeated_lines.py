"""Lines repeated across the documents of one source.

Every line is brought to a comparison key (no letter case, no invisible
characters, one kind of blank, every run of digits the same sign) and hashed
to 128 bits. Documents are counted per source and hash, lines at or above the
threshold are joined back and taken out of each document.

Skew: a line's count is pre-aggregated before it moves, so a source or a line
that holds a third of all rows reaches the shuffle as one partial count per
map task. A document counts once however often it repeats a line; ids that
occur in several rows (none in a clean table) are counted through a distinct
of their own. The frequent lines are broadcast when they are few, else joined
by shuffle.

Edge cases: null, empty and blank contents have no lines; a null source is a
source of its own; repeated rows of one id count as one document; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_side, staged

#: Documents of one source from which on a line is taken out.
MIN_DOCUMENTS = 6
#: Frequent lines up to which they are broadcast.
BROADCAST_LINES = 300_000

# Characters without a visible form, beside Unicode's format class (Cf).
INVISIBLE = r"[\p{Cf}" + "".join(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180E), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0])) + "]"


def comparison_text(text: Column) -> Column:
    """The text with every line in comparison form; line breaks stay where they are."""
    t = F.when(text.rlike(r"[^\x00-\x7E]"), F.regexp_replace(text, INVISIBLE, "")).otherwise(text)
    t = F.regexp_replace(t, r"\p{Nd}+", "0")
    t = F.regexp_replace(t, r"[\t\x0B\f\r\x1C-\x1F\x85\p{Z}]+", " ")
    return F.lower(F.upper(t))


def _lines(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, src, ls): per document the trimmed comparison lines, blank ones empty."""
    df = docs.select(F.col(id_col), F.lower(F.trim(source_col)).alias("src"), F.col(text_col).alias("_text")).filter("_text is not null")
    return staged(df, ls=F.transform(F.split(comparison_text(F.col("_text")), "\n"), lambda x: F.trim(x))).drop("_text")


def line_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, src, keys): per document the 128-bit keys of its comparison lines in order, null for blank ones; written once, so texts are normalised once."""
    key = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")))
    return cut(_lines(docs, id_col, text_col, source_col).select(id_col, F.coalesce("src", F.lit("")).alias("src"), F.transform("ls", key).alias("keys")))


def frequent_lines(keyed: DataFrame, id_col: str, min_documents: int = MIN_DOCUMENTS, min_share: float = 0.0) -> DataFrame:
    """(src, h1, h2, n_documents) of each line in at least ``min_documents`` documents of its source, and in at least ``min_share`` of them.

    ``keyed``: as made by ``line_keys``.
    """
    repeated_ids = cut(keyed.groupBy(F.col(id_col)).count().filter("count > 1").select(id_col))
    flat = lambda df: df.select(id_col, "src", F.explode(F.array_distinct("keys")).alias("k")).filter("k is not null").select(id_col, "src", "k.h1", "k.h2")
    if repeated_ids.isEmpty():
        each = flat(keyed).select("src", "h1", "h2")
    else:
        ids = small_side(repeated_ids)
        once = flat(keyed.join(ids, id_col, "left_anti")).select("src", "h1", "h2")
        again = flat(keyed.join(ids, id_col, "left_semi")).distinct().select("src", "h1", "h2")
        each = once.unionByName(again)
    counts = each.groupBy("src", "h1", "h2").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= min_documents)
    if min_share <= 0:
        return counts
    sizes = keyed.groupBy("src").agg(F.count_distinct(id_col).alias("_all"))  # one row a source
    return counts.join(sizes, "src").filter(F.col("n_documents") >= min_share * F.col("_all")).drop("_all")


def repeated_lines(docs: DataFrame, id_col: str = "article_id", text_col: str = "content", source_col: str = "source_code", min_documents: int = MIN_DOCUMENTS, min_share: float = 0.0) -> DataFrame:
    """(id, line_no, n_documents) of each line to take out; lines are numbered from 0, blank ones counted."""
    keyed = line_keys(docs, id_col, text_col, source_col)
    frequent = small_side(cut(frequent_lines(keyed, id_col, min_documents, min_share)), BROADCAST_LINES)
    occurrences = keyed.select(id_col, "src", F.posexplode("keys").alias("line_no", "k")).filter("k is not null").select(id_col, "line_no", "src", "k.h1", "k.h2")
    return occurrences.join(frequent, ["src", "h1", "h2"]).select(id_col, "line_no", "n_documents")


def without_repeated_lines(docs: DataFrame, id_col: str = "article_id", text_col: str = "content", source_col: str = "source_code", min_documents: int = MIN_DOCUMENTS, min_share: float = 0.0) -> DataFrame:
    """(id, text, n_removed): each document rebuilt without its frequent lines.

    A null text stays null. Rows of a repeated id are rebuilt from their own
    lines: a row is known by 128 bits of its id, text and source.
    """
    keyed = line_keys(docs, id_col, text_col, source_col)
    frequent = small_side(cut(frequent_lines(keyed, id_col, min_documents, min_share)), BROADCAST_LINES)
    row = lambda *c: [F.xxhash64(*c).alias("r1"), F.xxhash64(F.lit("second"), *c).alias("r2")]
    hits = (
        keyed.select(*row(id_col, "src", "keys"), "src", F.posexplode("keys").alias("line_no", "k")).filter("k is not null")
        .select("r1", "r2", "line_no", "src", "k.h1", "k.h2").join(frequent, ["src", "h1", "h2"])
        .groupBy("r1", "r2").agg(F.collect_set("line_no").alias("gone"))
    )
    # Rows of equal id, source and line keys have the same frequent lines, so they share one entry.
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.lower(F.trim(source_col)).alias("src"))
    lines = staged(texts, ls=F.when(F.col("text").isNotNull(), F.transform(F.split(comparison_text(F.col("text")), "\n"), lambda x: F.trim(x))))
    key = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")))
    rows = lines.select(id_col, "text", F.coalesce("src", F.lit("")).alias("src"), F.transform("ls", key).alias("keys")).select(id_col, "text", *row(id_col, "src", "keys"))
    joined = rows.join(hits, ["r1", "r2"], "left")
    kept = F.expr("case when gone is null then text else array_join(filter(split(text, '\n'), (x, i) -> not array_contains(gone, i)), '\n') end")
    return joined.select(id_col, kept.alias("text"), F.expr("coalesce(size(gone), 0)").alias("n_removed"))
