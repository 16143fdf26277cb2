"""Topic signals of a text from keyword lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

# A default of the package's own, topic -> (category, keywords); whoever needs other topics or words passes a table of theirs.
TOPICS: dict[str, tuple[str, list[str]]] = {
    "ai": ("technology", ["ai", "artificial intelligence", "llm", "machine learning", "人工智能", "大模型"]),
    "chip": ("technology", ["chip", "chips", "semiconductor", "wafer", "芯片", "半导体"]),
    "cybersecurity": ("technology", ["hackers", "ransomware", "malware", "data breach", "网络安全", "黑客"]),
    "space": ("science", ["rocket", "satellite", "space station", "astronomy", "telescope", "航天", "火箭", "卫星"]),
    "science": ("science", ["scientists", "researchers", "laboratory", "experiment", "实验室", "科研"]),
    "conflict": ("conflict", ["war", "missile", "airstrike", "troops", "ceasefire", "战争", "导弹", "停火"]),
    "disaster": ("disaster", ["earthquake", "flood", "wildfire", "storm", "volcano", "landslide", "tsunami", "地震", "洪水", "山火"]),
    "climate": ("science", ["climate", "emissions", "greenhouse gas", "heatwave", "气候", "碳排放"]),
    "health": ("science", ["vaccine", "hospital", "clinics", "disease", "virus", "疫苗", "医院", "医疗"]),
    "energy": ("business", ["oil", "gas", "power grid", "blackout", "grid operator", "停电", "电网", "电力"]),
    "policy": ("policy", ["regulation", "parliament", "council", "ministry", "tariff", "法案", "议会", "监管"]),
    "diplomacy": ("policy", ["summit", "talks", "treaty", "envoy", "delegation", "谈判", "条约", "会谈"]),
    "economy": ("business", ["inflation", "prices", "market", "loan", "wage", "经济", "粮价", "贷款"]),
    "transport": ("business", ["airport", "flight", "shipping", "port", "rail", "ferry", "freight", "港口", "铁路"]),
    "protest": ("conflict", ["protest", "demonstration", "riot", "strike", "抗议", "罢工"]),
    "crime": ("conflict", ["murder", "fraud", "smuggling", "arrested", "诈骗", "走私"]),
}
LOW_VALUE = ["tv series", "celebrity", "box office", "talent show", "综艺", "明星"]
PRIORITY = ["breaking", "urgent", "alert", "confirmed", "emergency", "突发", "紧急"]


def _known(topics: dict[str, tuple[str, list[str]]]) -> list[str]:
    """All keywords in lower case, longest first."""
    return sorted({w.strip().lower() for ws in [*(ws for _, ws in topics.values()), LOW_VALUE, PRIORITY] for w in ws}, key=lambda w: (-len(w), w))


def found_keywords(low: Column, topics: dict[str, tuple[str, list[str]]]) -> Column:
    """Keywords that stand in a lower-case text, each once: two passes over it, whatever the number of keywords.

    A look-ahead at each place finds the longest keyword that begins there, so
    overlapping ones are all met; those that are a beginning of it are added.
    """
    words = _known(topics)
    plain, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    empty = F.array().cast("array<string>")
    body = lambda w: re.sub(r"(\\ | )+", lambda _: r"\s+", re.escape(w))
    found = []
    if plain:
        hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?=({'|'.join(map(body, plain))})(?![a-z0-9]))"), F.lit(1))
        found.append(F.transform(hits, lambda w: F.regexp_replace(w, r"\s+", " ")))
    if other:
        found.append(F.regexp_extract_all(low, F.lit(f"(?=({'|'.join(map(re.escape, other))}))"), F.lit(1)))
    begins = {w: [v for v in words if v != w and w.startswith(v) and (not v.isascii() or not w[len(v)].isalnum())] for w in words}
    begins = {w: vs for w, vs in begins.items() if vs}
    every = F.concat(*found) if found else empty
    if begins:
        more = F.create_map(*[x for w, vs in begins.items() for x in (F.lit(w), F.array(*[F.lit(v) for v in vs]))])
        every = F.concat(every, F.flatten(F.transform(F.concat(*found), lambda w: F.coalesce(F.try_element_at(more, w), empty))))
    return F.array_distinct(every)


def with_signals(df: DataFrame, text: str, topics: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """``df`` with the number of keywords met: hits_<topic>, hits_low, hits_priority."""
    topics = topics or TOPICS
    df = staged(df, _found=found_keywords(F.lower(F.coalesce(F.col(text), F.lit(""))), topics))
    hits = lambda ws: F.size(F.array_intersect("_found", F.array(*[F.lit(w.strip().lower()) for w in ws]))) if ws else F.lit(0)
    named = {f"hits_{t}": hits(ws) for t, (_, ws) in topics.items()} | {"hits_low": hits(LOW_VALUE), "hits_priority": hits(PRIORITY)}
    return staged(df, **named).drop("_found")


def priority_score(topics: dict[str, tuple[str, list[str]]] | None = None) -> Column:
    """2 + up to 2 for each topic met, up to 3 for priority words; over the columns of ``with_signals``."""
    total = F.least(F.lit(3), F.col("hits_priority"))
    for t in topics or TOPICS:
        total = total + F.when(F.col(f"hits_{t}") > 0, 2 + F.least(F.lit(2), F.col(f"hits_{t}"))).otherwise(0)
    return total


def should_drop(topics: dict[str, tuple[str, list[str]]] | None = None) -> Column:
    """Whether a text is of low value: any low-value word, and less than three points."""
    return (F.col("hits_low") > 0) & (priority_score(topics) < 3)


def topic_tags(topics: dict[str, tuple[str, list[str]]] | None = None) -> Column:
    """Topics met, in order; 'other' where none is."""
    met = F.filter(F.array(*[F.when(F.col(f"hits_{t}") > 0, F.lit(t)) for t in topics or TOPICS]), lambda x: x.isNotNull())
    return F.when(F.size(met) > 0, met).otherwise(F.array(F.lit("other")))


def topic_category(base: Column, topics: dict[str, tuple[str, list[str]]] | None = None) -> Column:
    """Category of most hits, the first of equals; ``base`` where none is hit."""
    topics = topics or TOPICS
    order = list(dict.fromkeys(c for c, _ in topics.values()))
    sums = [(c, sum((F.col(f"hits_{t}") for t, (k, _) in topics.items() if k == c), F.lit(0))) for c in order]
    most = F.greatest(*[s for _, s in sums])
    out = base
    for c, s in reversed(sums):
        out = F.when((most > 0) & (s == most), F.lit(c)).otherwise(out)
    return out
