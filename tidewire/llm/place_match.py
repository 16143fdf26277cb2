"""Free-typed place names to the entries of a reference list.

Distinct names are read as one or more token lists ("readings"): words without
type words, the words run together, each side of a slash, Cyrillic spelled in
Latin. Each *distinct* token is joined to the tokens of the reference list by
edit distance, in which two neighbouring letters that change places are one
edit: an equi-join on deletion keys finds the candidates, the exact distance
verifies them; abbreviations and Chinese names behind a country's name are
repairs of their own. The repaired tokens of a reading are combined with soft
TF-IDF (weights from the reference list) against the spellings of the entries
within the stated country. A spelling is proposed by its rarest tokens, as many
as it takes that the others alone cannot reach the threshold; no token is left
out for being common. The best entry at or above the threshold wins; a tie
between entries and anything below is reported as unmatched.

Work grows with the number of distinct names; the reference list is the small
side and is broadcast only up to a checked size. A name that fills a third of
all rows is matched once.

Edge cases: null, empty and letterless names are unmatched; null or empty
aliases are skipped; a name of two countries needs the country; repeated rows
give repeated rows; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, small_side
from .lookalike import table_form

#: Soft TF-IDF score from which on an entry counts as meant.
THRESHOLD = 0.78
#: Similarity of a repair to the token, and edits, at most.
ALIKE = 0.66
EDITS = 2
#: Of a spelling's squared weight, what tokens that propose nothing may hold, as a share of the squared threshold.
SLACK = 0.8
UNMATCHED = "UNMATCHED"

# Words that say what kind of place a name is of.
TYPE_WORDS = set(
    "province provinces prov provincia provinz state states estado staat region regions région región area the of de du des la le el del"
    " departement département department departamento dept bezirk land district territory territoire county oblast край область район".split()
)
# Chinese endings of the same kind, longest first.
TYPE_ENDINGS = ["自治区", "地区", "大区", "一带", "行政区", "省", "州", "县", "區", "区"]
#: Endings that make a name a town's; they stay a token of their own.
TOWN_ENDINGS = ["市", "镇", "鎮"]
# Short forms of the words that first-level names begin with.
SHORT_FORMS = {
    "st": ["saint"], "ste": ["saint"], "sankt": ["saint"], "san": ["saint"], "santa": ["saint"],
    "n": ["north", "new"], "nth": ["north"], "no": ["north"], "s": ["south"], "sth": ["south"], "so": ["south"],
    "e": ["east"], "w": ["west"], "nw": ["new"], "nouveau": ["new"], "nouvelle": ["new"], "nuevo": ["new"], "nueva": ["new"], "neu": ["new"],
    "nord": ["north"], "norte": ["north"], "sud": ["south"], "sur": ["south"], "süd": ["south"],
}
# Traditional characters common in transcribed names, each with its simplified form.
_SIMPLER = "內内 蓋盖 齊齐 納纳 蘇苏 圖图 達达 貝贝 濟济 魯鲁 蘭兰 維维 羅罗 諾诺 佈布 馬马 爾尔 萊莱 倫伦 賓宾 費费 門门 剛刚 烏乌 歐欧 亞亚 東东 島岛 聖圣 漢汉 塗涂 鐵铁 灣湾 廣广 華华 盧卢 頓顿 倉仓 陽阳 陰阴 遼辽 寧宁 龍龙 鳳凤 薩萨 賽赛 賴赖 贊赞 傑杰 喬乔 聶聂 賀贺 賈贾 錫锡 銀银 鎮镇 馮冯 駱骆 鮑鲍 黃黄 瓊琼 澤泽 庫库 裡里 裏里 瑪玛 麗丽 紐纽 約约 綠绿 緬缅 絲丝 紹绍 蓮莲 萬万 葉叶 衛卫 觀观 許许 譚谭 豐丰 貢贡 邁迈 鄧邓 鄭郑 長长 開开 關关 陳陈 雙双 雲云 順顺 顏颜 顧顾 飛飞 魚鱼 鳥鸟 麥麦 龐庞 國国 園园 團团 壩坝 奧奥 寶宝 岡冈 嶺岭 帶带 廈厦 彌弥 恆恒 愛爱 慶庆 樂乐 樹树 橋桥 溫温 滬沪 滿满 潔洁 濱滨 瀾澜 熱热 爭争 獅狮 畢毕 發发 盤盘 碼码 禮礼 種种 窩窝 節节 籃篮 級级 細细 經经 綱纲 網网 縣县 總总 臺台 舊旧 莊庄 藍蓝 藝艺 趙赵 軍军 輪轮 農农 連连 遠远 邊边 鋼钢 錢钱 鍾钟 間间 閣阁 陸陆 電电 靈灵 靜静 韋韦 韓韩 頭头 願愿 風风 馳驰 騎骑 鮮鲜 鯨鲸 鹽盐 黨党 齡龄 詩诗 單单 喚唤 戶户 過过 彎弯 絡络 結结 給给 統统"
_TO_SIMPLE = str.maketrans({p[0]: p[1] for p in _SIMPLER.split()})
# Cyrillic letters in Latin.
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f h ts ch sh sch  y  e yu ya".split(" ")))

_CJK = r"㐀-鿿"
_WORD = re.compile(rf"[{_CJK}]+|(?:(?![{_CJK}])[^\W_])+")


def _fold_word(word: str) -> str:
    latin = any("a" <= c.lower() <= "z" for c in unicodedata.normalize("NFKC", word))
    w = table_form(word).casefold() if latin else table_form(word.casefold())
    w = unicodedata.normalize("NFD", w)
    w = "".join(c for c in w if not (unicodedata.combining(c) and c not in "゙゚"))
    return unicodedata.normalize("NFC", w).translate(_TO_SIMPLE)


def _cyrillic_to_latin(text: str) -> str | None:
    low = text.casefold()
    if not re.search("[а-яё]", low) or re.search("[a-z]", low):
        return None
    return "".join(_CYRILLIC.get(c, c) for c in low.replace("ё", "е"))


def _words(part: str) -> list[str]:
    part = re.sub(rf"(?<=[{_CJK}])\s+(?=[{_CJK}])", "", part)
    part = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ])", " ", part)  # words run together
    out = []
    for w in _WORD.findall(part):
        w = _fold_word(w)
        if re.match(rf"[{_CJK}]", w):
            for end in TOWN_ENDINGS:
                if w.endswith(end) and len(w) > 2:
                    out.append(end)
                    w = w[:-1]
            for end in TYPE_ENDINGS:
                if w.endswith(end) and len(w) > len(end) + 1:
                    w = w[: -len(end)]
                    break
        if w.isdigit():
            w = w.lstrip("0") or "0"
        if w:
            out.append(w)
    return out


_TYPES = {_fold_word(w) for w in TYPE_WORDS}


def readings(name: str | None, drop: frozenset[str] = frozenset()) -> list[list[str]]:
    """Token lists a name may stand for; ``drop``: words of countries."""
    if not name:
        return []
    name = "".join(c for c in unicodedata.normalize("NFC", name) if unicodedata.category(c) != "Cf")
    out: list[list[str]] = []
    parts = [name] if "/" not in name else [*name.split("/")]
    for part in parts:
        spelled = [part] + ([t] if (t := _cyrillic_to_latin(part)) else [])
        for text in spelled:
            words = _words(text)
            kept = [w for w in words if w not in _TYPES and w not in TYPE_ENDINGS] or words
            named = [w for w in kept if w not in drop] or kept
            for tokens in (named, kept, ["".join(named)], ["".join(kept)], ["".join(words)]):
                if tokens and tokens != [""] and tokens not in out:
                    out.append(tokens)
    return out


def allowed_edits(n: int) -> int:
    """Edits a token of ``n`` characters may have and still be alike."""
    return min(EDITS, int(n * (1 - ALIKE) + 1e-9))


def deletion_keys(token: str) -> list[str]:
    """The token and what is left of it without one or two characters, as its length allows.

    Tokens with digits are codes and compared as they stand.
    """
    keys, layer = {token}, {token}
    for _ in range(0 if any(c.isdigit() for c in token) else allowed_edits(len(token))):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        keys |= layer
    return sorted(keys)


def edit_distance(a: str, b: str) -> int:
    """Edits between two tokens; neighbours that change places are one edit."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def _country_words(reference: DataFrame) -> frozenset[str]:
    rows = reference.select("country_code", "country_name").distinct().collect()  # at most one row a country
    return frozenset(_fold_word(w) for r in rows for c in r if c for w in _WORD.findall(c))


def reference_spellings(reference: DataFrame) -> DataFrame:
    """(vid, key, country_code, token, idf, norm): tokens of every spelling of every entry."""
    schema = "vid string, key string, country_code string, tokens array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                names = [r.admin1_name, r.admin1_name_ascii, r.admin1_name_zh, *(r.aliases if r.aliases is not None else [])]
                seen: list[list[str]] = []
                for n in names:
                    for tokens in readings(n):
                        if tokens not in seen:
                            seen.append(tokens)
                if r.admin1_code and r.country_code:
                    code = "".join(_words(str(r.admin1_code)))
                    seen += [[_fold_word(r.country_code) + code]] + ([[code]] if code.isdigit() else [])
                for i, tokens in enumerate(seen):
                    out.append((f"{r.geojson_key}#{i}", r.geojson_key, r.country_code, tokens))
            yield pd.DataFrame(out, columns=["vid", "key", "country_code", "tokens"])

    rows = reference.filter("geojson_key is not null").select("country_code", "admin1_code", "admin1_name", "admin1_name_ascii", "admin1_name_zh", "aliases", "geojson_key")
    spelled = cut(rows.mapInPandas(run, schema).dropDuplicates(["vid"]))
    each = spelled.select("vid", "key", "country_code", F.explode(F.array_distinct("tokens")).alias("token"))
    df = each.groupBy("token").agg(F.count_distinct("key").alias("df"))
    total = max(1, spelled.select("key").distinct().count())
    weighted = each.join(df, "token").withColumn("idf", F.log(1 + F.lit(float(total)) / F.col("df")))
    norm = weighted.groupBy("vid").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return cut(weighted.join(norm, "vid"))


def token_repairs(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, vtok, sim): reference tokens that a token may be a spelling of.

    ``tokens``: (token); ``vocabulary``: (vtok), distinct. Similarity is
    1 - distance / length; deletion keys make the join an equi-join.
    """
    keys = F.pandas_udf(lambda s: s.map(deletion_keys), T.ArrayType(T.StringType()), F.PandasUDFType.SCALAR)
    # A token that is longer than any of the vocabulary by more than two characters is near none of it.
    longest = vocabulary.agg(F.max(F.length("vtok"))).first()[0] or 0
    left = tokens.filter(F.length("token") <= longest + 2).select("token", F.explode(keys("token")).alias("dk"))
    right = vocabulary.select("vtok", F.explode(keys("vtok")).alias("dk"))
    near = left.join(small_side(right), "dk").select("token", "vtok").distinct()
    # A change of places is one edit here and two in the plain distance, which therefore only says what is far.
    near = near.withColumn("far", F.levenshtein("token", "vtok")).filter(f"far <= {2 * EDITS}")
    swaps = F.pandas_udf(lambda a, b: pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32"), T.IntegerType(), F.PandasUDFType.SCALAR)
    near = near.filter("far < 2").unionByName(near.filter("far >= 2").withColumn("far", swaps("token", "vtok")))
    near = near.filter(f"far <= {EDITS}").withColumn("sim", 1 - F.col("far") / F.greatest(F.length("token"), F.length("vtok"))).filter(f"sim >= {ALIKE}").drop("far")
    short = tokens.sparkSession.createDataFrame([(_fold_word(a), b, 0.98) for a, bs in SHORT_FORMS.items() for b in bs], "token string, vtok string, sim double")
    short = tokens.join(F.broadcast(short), "token").join(small_side(vocabulary), "vtok").select("token", "vtok", "sim")
    # A Chinese name behind the country's name: the entry's token is the end of the run.
    tails = tokens.filter(F.col("token").rlike(rf"^[{_CJK}]{{4,}}$")).select("token", F.explode(F.expr(f"transform(sequence(greatest(3, length(token) - {max(longest, 2)} + 1), length(token) - 1), i -> substring(token, i, length(token)))")).alias("vtok")).filter("length(vtok) >= 2")
    behind = tails.join(small_side(vocabulary), "vtok").select("token", "vtok", F.expr("if(length(vtok) >= 3 or substring(token, -length(vtok) - 1, 1) = '国', 0.80 + 0.01 * length(vtok), 0.0)").alias("sim")).filter("sim > 0")
    return near.unionByName(short).unionByName(behind).groupBy("token", "vtok").agg(F.max("sim").alias("sim"))


def match_names(names: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, country_code, key, score): the entry meant by each distinct (name, country_code).

    ``key`` is null where no entry reaches the threshold or two entries tie.
    """
    spellings = reference_spellings(reference)
    drop = _country_words(reference)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r.name, r.country_code, i, tokens) for r in pdf.itertuples(index=False) for i, tokens in enumerate(readings(r.name, drop))]
            yield pd.DataFrame(out, columns=["name", "country_code", "reading", "tokens"])

    distinct = names.select("name", "country_code").filter("name is not null").distinct()
    read_schema = "name string, country_code string, reading int, tokens array<string>"
    q = cut(distinct.mapInPandas(read, read_schema).withColumn("rid", F.md5(F.concat_ws("\x01", "name", F.coalesce("country_code", F.lit("-")), "reading"))))
    qt = q.select("rid", F.col("country_code").alias("qcc"), F.explode(F.array_distinct("tokens")).alias("token"))
    vocabulary = cut(spellings.select(F.col("token").alias("vtok"), "idf").distinct())
    repairs = cut(token_repairs(qt.select("token").distinct(), vocabulary.select("vtok")))
    repairs = small_side(repairs)
    vocab = small_side(vocabulary)
    unknown = vocabulary.agg(F.max("idf")).first()[0] or 1.0
    # Weight of a query token: that of its best repair, of a rare token where it has none.
    best = repairs.join(vocab, "vtok").groupBy("token").agg(F.max_by("idf", F.struct("sim", "idf")).alias("w"))
    norms = qt.join(small_side(best), "token", "left").groupBy("rid").agg(F.sqrt(F.sum(F.pow(F.coalesce("w", F.lit(unknown)), 2))).alias("qnorm"))
    paths = qt.join(repairs, "token").select("rid", "qcc", "token", "vtok", "sim")
    entries = spellings.select("vid", "key", "country_code", F.col("token").alias("vtok"), "idf", "norm")
    # Rarest tokens first; a token proposes while those after it could still reach the threshold with it gone.
    rest = W.partitionBy("vid").orderBy(F.desc("idf"), "vtok").rowsBetween(0, W.unboundedFollowing)
    proposing = entries.withColumn("rest", F.sum(F.col("idf") * F.col("idf")).over(rest)).filter(F.col("rest") >= F.lit(SLACK * threshold * threshold) * F.col("norm") * F.col("norm"))
    proposing = cut(proposing.select("vid", "country_code", "vtok"))
    seeds = (
        paths.join(small_side(proposing), "vtok")
        .filter("qcc is null or qcc = country_code").select("rid", "vid").distinct()
    )
    dots = (
        paths.join(seeds, "rid").join(small_side(entries), ["vid", "vtok"])
        .groupBy("rid", "vid", "key", "norm", "vtok").agg(F.max(F.col("sim") * F.col("idf") * F.col("idf")).alias("part"))
        .groupBy("rid", "vid", "key", "norm").agg(F.sum("part").alias("dot"))
    )
    scored = dots.join(norms, "rid").select("rid", "key", (F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("score"))
    per_key = scored.join(q.select("rid", "name", "country_code"), "rid").groupBy("name", "country_code", "key").agg(F.max("score").alias("score"))
    w = W.partitionBy("name", "country_code")  # as many rows as entries share a telling token with the name
    ranked = per_key.withColumn("best", F.max("score").over(w)).filter("score >= best - 1e-9")
    top = ranked.groupBy("name", "country_code").agg(F.max("score").alias("score"), F.min("key").alias("key"), F.count("*").alias("n_best"))
    return top.select("name", "country_code", F.when((F.col("score") >= threshold) & (F.col("n_best") == 1), F.col("key")).alias("key"), "score")


def map_entries(entries: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``entries`` (with name, country_code) plus ``geojson_key`` of the entry meant, or UNMATCHED."""
    matched = cut(match_names(entries, reference, threshold).filter("key is not null"))
    m = small_side(matched.select(F.col("name").alias("__place_name"), F.coalesce("country_code", F.lit("")).alias("__place_country"), F.col("key").alias("__place_key")))
    joined = entries.join(m, (F.col("name") == F.col("__place_name")) & (F.coalesce("country_code", F.lit("")) == F.col("__place_country")), "left")
    return joined.withColumn("geojson_key", F.coalesce("__place_key", F.lit(UNMATCHED))).drop("__place_name", "__place_country", "__place_key")
