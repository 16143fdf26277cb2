"""Text expressions: cleaning, hashes, tokens, similarity. Column in, column out."""

from __future__ import annotations

import difflib
import html

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Words that say nothing about a title.
TITLE_STOPWORDS = [
    "the", "a", "an", "and", "or", "for", "with", "from", "into", "after", "amid", "over", "under", "new", "latest",
    "says", "say", "said", "report", "reports", "update", "updates", "breaking", "live",
]
# Publishers whose name may end a title.
TITLE_SUFFIX = r"(?i)\s*[-|–—]\s*(?:bbc|reuters|ap|cnn|guardian|aljazeera|nhk|dw|france\s*24|ndtv|scmp|cna|xinhua|global\s*times|afp|nyt|wsj|ft)\s*(?:news|world)?\s*$"

#: Blanks of any kind; Java's \s knows the ASCII ones only.
BLANKS = r"[\s\p{Z}]+"
#: What is neither letter, number, underscore nor blank; Java's \w knows ASCII only.
NO_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"


def strip_tags(text: Column) -> Column:
    """Without tags, blanks collapsed, trimmed; null where nothing is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), BLANKS, " "))
    return F.nullif(t, F.lit(""))


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """Character references as characters; Spark has no table of their names."""
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def clean_html(text: Column) -> Column:
    """Entities first, then tags as blanks, blanks collapsed; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(unescape_entities(text), r"<[^>]+>", " "), BLANKS, " ")
    return F.nullif(F.trim(t), F.lit(""))


def remove_urls(text: Column) -> Column:
    """Without web addresses."""
    return F.regexp_replace(text, r"https?://\S+", "")


def remove_emails(text: Column) -> Column:
    """Without mail addresses."""
    return F.regexp_replace(text, r"\S+@\S+\.\S+", "")


def truncate(text: Column, size: int, suffix: str = "...") -> Column:
    """At most ``size`` characters, a cut text ending in ``suffix``."""
    cut = F.concat(F.rtrim(F.substring(text, 1, size - len(suffix))), F.lit(suffix))
    return F.when(F.length(text) > size, cut).otherwise(text)


def first_paragraph(text: Column, size: int = 600) -> Column:
    """Lede: up to the first sentence mark (tried in a fixed order) whose head is longer than 15 characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), BLANKS, " "))
    heads = []
    for mark in ["。", "！", "？", ". ", "! ", "? "]:
        head = F.trim(F.substring_index(t, mark, 1))
        heads.append(F.when((F.instr(t, mark) > 0) & (F.length(head) > 15), F.substring(head, 1, size)))
    return F.coalesce(*heads, F.substring(t, 1, size))


def normal_title(title: Column) -> Column:
    """Without publisher and punctuation, lower case, single blanks."""
    t = F.regexp_replace(F.trim(title), TITLE_SUFFIX, "")
    t = F.regexp_replace(t, NO_WORD, " ")
    return F.lower(F.trim(F.regexp_replace(t, BLANKS, " ")))


def title_hash(title: Column) -> Column:
    """Hash of the normal title."""
    return F.md5(normal_title(title))


def sorted_words_hash(title: Column) -> Column:
    """Hash of a title's words in order of the alphabet."""
    t = F.regexp_replace(F.lower(title), NO_WORD, "")
    return F.md5(F.array_join(F.array_sort(F.filter(F.split(t, BLANKS), lambda w: w != "")), " "))


def title_tokens(title: Column) -> Column:
    """Telling tokens of a title in order."""
    return tokens_of(normal_title(title))


def tokens_of(normal: Column) -> Column:
    """Telling tokens of a title in its normal form."""
    found = F.regexp_extract_all(normal, F.lit(r"[\x{4e00}-\x{9fff}]{2,}|[a-z0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token lists; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt ratio of two strings; Spark has no equal, so pairs are pruned before."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def title_similarity(a: Column, b: Column) -> Column:
    """0.72 gestalt ratio + 0.28 token overlap, at least 0.96 where the shorter title stands in the longer."""
    x, y = F.regexp_replace(normal_title(a), " ", ""), F.regexp_replace(normal_title(b), " ", "")
    mixed = F.greatest(held_within(x, y), sequence_ratio(x, y) * 0.72 + jaccard(title_tokens(a), title_tokens(b)) * 0.28)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(mixed)


def held_within(x: Column, y: Column) -> Column:
    """0.96 where the shorter of two squeezed titles has twelve characters and stands in the longer, else 0."""
    shorter, longer = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return F.when((F.length(shorter) >= 12) & F.contains(longer, shorter), 0.96).otherwise(0.0)


#: Buckets of letters, how often one is counted in bits, and the buckets that one number holds.
BAG_BUCKETS, BAG_TIMES, BAG_WIDTH = 80, 4, 16


@F.pandas_udf(StructType([*(StructField(f"b{i}", LongType()) for i in range(BAG_BUCKETS // BAG_WIDTH)), StructField("rest", IntegerType())]))
def letter_bag(text: pd.Series) -> pd.DataFrame:
    """Letters of a text as bits, by bucket as many as it occurs, and how many there were beyond; one pass over a batch's code points."""
    text = text.fillna("")
    codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(text)), np.fromiter(map(len, text), np.int64, len(text)))
    counts = np.bincount(rows * BAG_BUCKETS + codes % BAG_BUCKETS, minlength=len(text) * BAG_BUCKETS).reshape(len(text), BAG_BUCKETS)
    bits = ((1 << np.minimum(counts, BAG_TIMES)) - 1).astype(np.uint64).reshape(len(text), -1, BAG_WIDTH) << (np.arange(BAG_WIDTH) * BAG_TIMES).astype(np.uint64)
    words = np.bitwise_or.reduce(bits, axis=2).view(np.int64)
    return pd.DataFrame({f"b{i}": words[:, i] for i in range(words.shape[1])} | {"rest": np.maximum(counts - BAG_TIMES, 0).sum(axis=1).astype(np.int32)})


def most_letters(a: Column, b: Column) -> Column:
    """At least as many letters as two texts share, from their bags."""
    return sum((F.bit_count(a[f"b{i}"].bitwiseAND(b[f"b{i}"])) for i in range(BAG_BUCKETS // BAG_WIDTH)), F.least(a["rest"], b["rest"]))


def word_bits(words: Column) -> Column:
    """Distinct words of a list as two numbers with a bit for each, their count, and how many found their bit taken."""
    bits = lambda half: F.aggregate(words, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.when(F.xxhash64(w).bitwiseAND(64) == half * 64, F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(63).cast("int"))).otherwise(0)))
    n = F.size(F.array_distinct(words))
    return F.struct(bits(0).alias("low"), bits(1).alias("high"), n.alias("n"), (n - F.bit_count(bits(0)) - F.bit_count(bits(1))).alias("more"))


def most_words(a: Column, b: Column) -> Column:
    """At least as many words as two lists share, from their bits."""
    common = F.bit_count(a["low"].bitwiseAND(b["low"])) + F.bit_count(a["high"].bitwiseAND(b["high"]))
    return F.least(common + F.least(a["more"], b["more"]), a["n"], b["n"])


def item_hash(url: Column, title: Column) -> Column:
    """Identity of an item."""
    return F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))), 256)


def slug(text: Column) -> Column:
    """Letters and digits in lower case, anything else one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def leading_number(text: Column) -> Column:
    """First run of digits as a number, 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"\d+", 0).try_cast("long"), F.lit(0))


# Site names and numbers that may end a title.
SITE_SUFFIX = r"[-_—|]\s*(新浪|腾讯|网易|搜狐|微博|知乎|BBC|CNN|Reuters)$"
# Endings of names of first-level regions, in the order they are tried.
REGION_ENDINGS_ZH = ["自治区", "特别行政区", "壮族自治区", "维吾尔自治区", "回族自治区", "藏族自治区", "省", "市", "区", "县", "都", "道", "府", "州"]
REGION_ENDINGS_EN = [" province", " state", " prefecture", " county", " region", " territory", " district"]
# Other spellings of source names and of country codes.
SOURCE_NAMES = {"新浪": "新浪新闻", "新浪网": "新浪新闻", "reuters": "Reuters"}
COUNTRY_CODES = {"PRC": "CN", "MAINLAND": "CN", "UK": "GB", "AMERICA": "US", "USA": "US"}


def plain_html(text: Column) -> Column:
    """Tags as blanks, blanks collapsed, trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), BLANKS, " ")), F.lit(""))


def clean_title(title: Column) -> Column:
    """Without tags, a site's name or a number behind a dash at the end; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(plain_html(title), SITE_SUFFIX, ""), r"[-_—|]\s*\d+$", "")
    return F.nullif(F.trim(t), F.lit(""))


def summary_of(content: Column, size: int = 200) -> Column:
    """Beginning of the text without markup; the whole text counts as one paragraph."""
    return F.coalesce(truncate(plain_html(content), size), F.lit(""))


def without_scripts(page: Column) -> Column:
    """Markup without scripts, styles and comments; null where nothing is left."""
    t = page
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        t = F.regexp_replace(t, pattern, "")
    return F.nullif(F.trim(t), F.lit(""))


def normal_content(text: Column) -> Column:
    """At most one empty line in a row, single blanks, lines trimmed."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n"), " {2,}", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, rf"^{BLANKS}|{BLANKS}$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), rf"^{BLANKS}|{BLANKS}$", "")


def listed(text: Column) -> Column:
    """Parts of a text between commas, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def content_hash(title: Column, content: Column) -> Column:
    """Hash of the title and the beginning of the content."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.substring(F.coalesce(content, F.lit("")), 1, 500)), 256)


def dedup_hash(title: Column, source: Column, url: Column) -> Column:
    """Hash of title, source and address, letter case and outer blanks aside."""
    return F.sha2(F.concat_ws("|", *[F.trim(F.lower(F.coalesce(c, F.lit("")))) for c in (title, source, url)]), 256)


def joined_hash(*columns: Column) -> Column:
    """Hash of the columns that are neither null nor empty."""
    return F.sha2(F.concat_ws("|", *[F.nullif(c, F.lit("")) for c in columns]), 256)


def by_table(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The table's entry for a value, else ``otherwise``."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(names, value), otherwise)


def normal_source(name: Column) -> Column:
    """Usual spelling of a source's name; 'Unknown' for none."""
    n = F.nullif(F.trim(name), F.lit(""))
    return F.coalesce(by_table(n, SOURCE_NAMES, n), F.lit("Unknown"))


def normal_country(code: Column, known: list[str]) -> Column:
    """Two-letter code of a country; null unless it is one of the known."""
    c = F.upper(F.trim(code))
    return by_table(c, COUNTRY_CODES, F.when(c.isin(known), c))


def region_stem(name: Column) -> Column:
    """A region's name without the first ending that fits, Chinese ones before English ones."""
    out = name
    for end in reversed(REGION_ENDINGS_EN):
        out = F.when(F.endswith(F.lower(name), F.lit(end)) & (F.length(name) > len(end)), F.substring(name, F.lit(1), F.length(name) - len(end))).otherwise(out)
    for end in reversed(REGION_ENDINGS_ZH):
        out = F.when(F.endswith(name, F.lit(end)) & (F.length(name) > len(end)), F.substring(name, F.lit(1), F.length(name) - len(end))).otherwise(out)
    return out


def name_variants(name: Column) -> Column:
    """A name trimmed, with single blanks, and without its ending, each once."""
    t = F.trim(name)
    return F.array_distinct(F.filter(F.array(t, F.regexp_replace(t, BLANKS, " "), F.trim(region_stem(t))), lambda x: x.isNotNull() & (x != "")))


def meta_content(page: Column, key: str) -> Column:
    """Content of a page's meta element by property, else by name."""
    found = [F.nullif(F.regexp_extract(page, rf"(?i)<meta[^>]+{kind}=[\"']{key}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1), F.lit("")) for kind in ("property", "name")]
    return F.trim(F.coalesce(*found))


def sentences(text: Column) -> Column:
    """Sentences of a text, each with its mark."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?\.])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def sentence_scores(parts: Column) -> Column:
    """How likely each sentence names a place, in tenths: position, dateline, words of place, capitals, Chinese runs; (rank, at, text)."""
    before, after = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    dateline = r"^(?:[A-Z][A-Z .'\-]{2,}|[\x{4e00}-\x{9fff}]{2,20})(?:,\s*(?:[A-Z][A-Za-z .'\-]{2,}|[\x{4e00}-\x{9fff}]{2,20})){0,2}\s*[-—]"
    context = rf"(?i){before}(in|at|from|near|across|throughout|outside|around|into|toward|inside){after}|[在于从赴至位省州市县郡区]"
    capitals = rf"{before}[A-Z][a-z]+(?:[\-'][A-Z][a-z]+)*{after}"

    def score(s: Column, i: Column) -> Column:
        found = F.when(s.rlike(dateline), 20).otherwise(0) + F.when(s.rlike(context), 11).otherwise(0) + F.when(F.regexp_count(s, F.lit(capitals)) >= 2, 7).otherwise(0)
        return F.when(i < 2, 22).when(i < 5, 10).otherwise(0) + found + F.when(s.rlike(r"[\x{4e00}-\x{9fff}]{2,}"), 5).otherwise(0)

    return F.transform(parts, lambda s, i: F.struct((-score(s, i)).alias("rank"), i.alias("at"), s.alias("text")))
