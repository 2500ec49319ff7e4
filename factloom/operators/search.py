"""Search, paging, validation: filters that stay declarative, so scans are pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import labels as B
from factloom.functions import text as X

MAX_LENGTHS = {"headline": 220, "source": 220, "url": 700, "text": 20000, "author": 180, "published": 120, "language": 40, "model": 120}


def haystack(df: DataFrame, columns: list[str]) -> Column:
    """All columns as one lower-case string; arrays are joined by spaces, structs written as JSON."""
    parts = []
    kinds = dict(df.dtypes)
    for c in columns:
        kind = kinds[c]
        parts.append(F.array_join(c, " ") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string"))
    return F.lower(F.concat_ws(" ", *parts))


def search(df: DataFrame, columns: list[str], needle: str = "", label: str = "", order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Substring search (not a pattern, not tokens); a label is normalised on both sides, an unknown one means UNCERTAIN."""
    out = df
    if label:
        out = out.where(B.result_label(F.col("label")) == B.result_label(F.lit(label)))
    if needle.strip():
        out = out.where(F.contains(haystack(df, columns), F.lit(needle.strip().lower())))
    if order:
        out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def paginate(df: DataFrame, order: list[Column], page: int, size: int = 10) -> DataFrame:
    """Rows of one page, by offset and limit, no window over everything."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 10) -> tuple[DataFrame, dict]:
    """One page, and its number, size, the rows in all and the pages in all (at least one)."""
    total = df.count()
    return paginate(df, order, page, size), {"page": page, "size": size, "total": total, "pages": max(1, -(-total // size))}


def with_total(df: DataFrame) -> DataFrame:
    """``total`` on each row: the number of rows that are there after a limit."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Retention: the first ``n`` rows in an order."""
    return df.orderBy(*order).limit(n)


def newest_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def validated(requests: DataFrame) -> DataFrame:
    """Trimmed and cut fields, and ``errors``: an array of messages, empty where the request is valid."""
    cut = {c: F.substring(X.strip_ws(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, n) for c, n in MAX_LENGTHS.items() if c in requests.columns}
    df = requests.withColumns(cut)
    url = F.col("url") if "url" in df.columns else F.lit("")
    checks = [
        F.when((url != "") & ~B.is_http_url(url), F.lit("url is not an http link")),
        F.when((url == "") & (F.length("text") < 40), F.lit("text has fewer than 40 characters")),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def analysable(text: Column) -> Column:
    """Null if a text can be analysed, else why not."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 40, "too short").when(X.looks_like_script(text), "script-like")
