"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host, a line's frequency is the pages that hold it over all pages of the host. Lines above the ratio are
boilerplate and are dropped from every page of that host. Lines are counted by two chained 64-bit hashes, so
what is shuffled is a few bytes a line; a page counts a line once, so counting needs no distinct and combines before
the shuffle: a hot host or a very common line is no hot task. The few frequent lines are joined back: broadcast
while they are few (counted first), else by a shuffled join that adaptive execution splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace

#: A line on more than this share of a host's pages is boilerplate...
RATIO = 0.1
#: ... if it is on this many of them at least (hosts of a few pages say nothing).
LEAST_PAGES = 3
#: Frequent lines (20 bytes each) that may be broadcast.
BROADCAST_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Two hashes of a trimmed line; an empty line has none and is always kept."""
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """host, a, b, pages, total: the hashes of the lines above the ratio, with their pages and the host's pages."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    keys = F.filter(F.array_distinct(F.transform(_lines(F.col("text")), _key)), lambda k: k.isNotNull())
    lines = pages.select("host", F.explode(keys).alias("k")).groupBy("host", "k.a", "k.b").agg(F.count("*").alias("pages"))
    return lines.where(F.col("pages") >= least).join(total, "host").where(F.col("pages") > ratio * F.col("total")).select("host", "a", "b", "pages", "total")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """docs with boilerplate lines gone from text, and n_lines, n_dropped (long) added (in place of columns of these names).

    Lines end at "\\n" and compare without spaces at their ends; empty lines are kept. A null host is a host of its
    own, shared with the empty name; a null text stays null with 0 lines dropped of 1 (empty) line. Repeated rows are pages of their own.
    Other columns pass unchanged. A page may come out empty; it is kept.
    """
    space = Workspace(docs.sparkSession, "linededup")
    found = space.keep(boilerplate(docs, host, ratio, least), "frequent")
    few = found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    by_host = found.groupBy("host").agg(F.collect_set(F.struct("a", "b")).alias("frequent"))
    packed = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.struct(*docs.columns).alias("row"))  # no name can clash
    joined = packed.join(F.broadcast(by_host) if few else by_host, "host", "left")
    lines = _lines(F.col("row.text"))
    kept = F.when(F.col("frequent").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("frequent"), _key(x)), F.lit(False))))
    joined = joined.withColumn("kept", kept)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    size = F.size(lines).cast("long")
    out |= {"text": F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n")), "n_lines": size, "n_dropped": size - F.size("kept")}
    return joined.select(*(v.alias(c) for c, v in out.items()))
