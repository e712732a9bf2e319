"""Operators over ordered rows: neighbours, latest and last rows, carried headers, grouped paragraphs and bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def firsts(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group. The limit also holds in each task before the shuffle, so a hot group sends few rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def neighbors(rows: DataFrame, target: str, by: str = "path", order: str = "pos", value: str = "tag", reach: int = 4) -> DataFrame:
    """by, order, before, after: the values up to `reach` places around each target; the target itself drops out after the cut. Equal places come by value."""
    w = Window.partitionBy(by).orderBy(order, value)
    others = lambda c: F.filter(c, lambda t: t != target)
    own = rows.withColumn("before", F.collect_list(value).over(w.rowsBetween(-reach, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, reach)))
    return own.where(F.col(value) == target).select(by, order, others(F.col("before")).alias("before"), others(F.col("after")).alias("after"))


def siblings(tags: DataFrame, target: str, primitives: list[str], most: int = 10) -> DataFrame:
    """tag, files, rank: what most often stands in the files that use a target, without it and the primitives."""
    used = tags.where(F.col("tag") == target).select("path").distinct()
    n = tags.join(used, "path", "left_semi").where(~F.col("tag").isin([target, *primitives])).groupBy("tag").agg(F.count_distinct("path").alias("files"))
    top = n.orderBy(F.col("files").desc(), "tag").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("files").desc(), "tag")))


def siblings_by_file(tags: DataFrame, target: str, primitives: list[str], most: int = 10) -> DataFrame:
    """path, tag, n, rank: what each file that uses a target holds most often besides, without the primitives."""
    used = tags.where(F.col("tag") == target).select("path").distinct()
    n = tags.join(used, "path", "left_semi").where(~F.col("tag").isin([target, *primitives])).groupBy("path", "tag").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.col("n").desc(), "tag"))).where(F.col("rank") <= most)


def reused_styles(corpus: DataFrame, least: int = 2) -> DataFrame:
    """path, ref, n: style references that a file uses `least` times or more, a sign of flat hierarchy. Of a list of references the first counts."""
    refs = F.regexp_extract_all("text", F.lit(r"\bstyle=\{\[?\s*([^}\]]+)"), F.lit(1))
    found = corpus.select("path", F.explode(refs).alias("raw")).select("path", F.split(F.trim("raw"), r"[,\s]+")[0].alias("ref")).where("ref <> ''")
    return found.groupBy("path", "ref").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_sites(tags: DataFrame, target: str, besides: DataFrame | None = None) -> DataFrame:
    """path, pos of the first use of a target in each file, but for files (path) of `besides`."""
    found = tags.where(F.col("tag") == target).groupBy("path").agg(F.min("pos").alias("pos"))
    return found.join(besides, "path", "left_anti") if besides is not None else found


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group; an aggregate, so groups of any size combine before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*by, *(F.col(f"r.`{c}`").alias(c) for c in rest))


def trend(rows: DataFrame, by: list[str], order: list[str], limit: int = 5) -> DataFrame:
    """The last `limit` rows of each group with seq from 1 for the oldest of them; none for 0."""
    if not isinstance(limit, int) or limit < 0:
        raise ValueError("limit must be a whole number of 0 or more")
    down = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    last = rows.withColumn("_back", F.row_number().over(down)).where(F.col("_back") <= limit)
    return last.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("_back")


def carried(rows: DataFrame, by: str, order: str, is_header: Column, header: Column) -> DataFrame:
    """With section: the last header at or before each row. A header that is null resets the section."""
    mark = F.when(is_header, F.struct(header.alias("h")))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(mark, ignorenulls=True).over(w)["h"])


def paragraphs(rows: DataFrame, by: str = "path", order: str = "line", content: str = "content") -> DataFrame:
    """by, paragraph (from 1), first_line, text: lines between blank lines, rules, headings and bullets, joined by a space."""
    breaks = F.col(content).rlike(r"^\s*$|^\s*([-*_])\1{2,}\s*$|^\s*#{1,6}\s|^\s*[-*+]\s")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_b", breaks).withColumn("_g", F.sum(F.col("_b").cast("int")).over(w)).where("not _b")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(content).alias("x")))), lambda s: s["x"]), " ")
    out = own.groupBy(by, "_g").agg(F.min(order).alias("first_line"), text.alias("text"))
    return out.select(by, F.row_number().over(Window.partitionBy(by).orderBy("_g")).alias("paragraph"), "first_line", "text")


def bullets(rows: DataFrame, by: str = "path", order: str = "line", content: str = "content") -> DataFrame:
    """by, first_line, text: each bullet with the indented lines that follow it, up to a blank line."""
    start, blank = F.col(content).rlike(r"^\s*[-*+]\s+"), F.col(content).rlike(r"^\s*$")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_s", start).withColumn("_g", F.sum(F.when(start | blank, 1).otherwise(0)).over(w)).where(~blank)
    own = own.withColumn("_head", F.first("_s").over(Window.partitionBy(by, "_g").orderBy(order))).where("_head").where(F.col("_s") | F.col(content).rlike(r"^\s"))
    part = F.regexp_replace(F.trim(content), r"^[-*+]\s+", "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("x")))), lambda s: s["x"]), " ")
    return own.groupBy(by, "_g").agg(F.min(order).alias("first_line"), text.alias("text")).drop("_g")
