"""Query of topic signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import topics as K
from ..session import table


def topic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, category, score and whether to drop it, of each article from its title, summary and whole content."""
    a = table(spark, sf_dir, "news_articles").select("article_id", "category", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "content")]).alias("t"))
    hits = K.with_signals(a, "t")
    return hits.select("article_id", F.array_join(K.topic_tags(), "|").alias("tags"), K.topic_category(F.col("category")).alias("category"), K.priority_score().alias("score"), (F.col("hits_low") * 2).alias("low_value"), K.should_drop().alias("should_drop"))


QUERIES = {"topic_signals": topic_signals}


def _hits(words: list[str]) -> str:
    parts = []
    for w in words:
        p = f"(^|[^a-z0-9]){w.replace(' ', chr(92) + 's+')}($|[^a-z0-9])" if w.isascii() else w
        parts.append(f"CAST(regexp_matches(t, '{p}') AS INT)")
    return "(" + " + ".join(parts) + ")"


_CATS = list(dict.fromkeys(c for c, _ in K.TOPICS.values()))
_SUM = {c: "(" + " + ".join(f"h_{t}" for t, (k, _) in K.TOPICS.items() if k == c) + ")" for c in _CATS}
_MOST = f"greatest({', '.join(_SUM.values())})"
_SCORE = "(least(3, h_pri)" + "".join(f" + CASE WHEN h_{t} > 0 THEN 2 + least(2, h_{t}) ELSE 0 END" for t in K.TOPICS) + ")"
SQL = {
    "topic_signals": "WITH a AS (SELECT article_id, category, lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(content, ''))) AS t FROM news_articles), h AS (SELECT article_id, category, "
    + ", ".join(f"{_hits(ws)} AS h_{t}" for t, (_, ws) in K.TOPICS.items()) + f", {_hits(K.LOW_VALUE)} AS h_low, {_hits(K.PRIORITY)} AS h_pri FROM a) SELECT article_id, "
    + "coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN h_{t} > 0 THEN '{t}' END" for t in K.TOPICS) + "), ''), 'other') AS tags, "
    + "CASE " + " ".join(f"WHEN {_MOST} > 0 AND {_SUM[c]} = {_MOST} THEN '{c}'" for c in _CATS) + " ELSE category END AS category, "
    + f"CAST({_SCORE} AS INT) AS score, CAST(h_low * 2 AS INT) AS low_value, h_low > 0 AND {_SCORE} < 3 AS should_drop FROM h",
}
