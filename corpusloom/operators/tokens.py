"""The token graph: which files use which tokens, tokens that are used alike, and how far a change reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from . import graph
from .sequence import firsts


def matrix(refs: DataFrame, scope: DataFrame) -> DataFrame:
    """token, file, n, in_scope from refs (path, token, n) and scope (path)."""
    flagged = refs.join(scope.select("path").distinct().withColumn("own", F.lit(True)), "path", "left")
    return flagged.groupBy("token", F.col("path").alias("file"), F.coalesce("own", F.lit(False)).alias("in_scope")).agg(F.sum("n").alias("n"))


def seeded(cells: DataFrame, definitions: DataFrame) -> DataFrame:
    """token, defined_in, value, uses: tokens that are defined or used (a full outer join)."""
    uses = cells.groupBy("token").agg(F.sum("n").alias("uses"))
    return definitions.join(uses, "token", "full").select("token", "defined_in", "value", F.coalesce("uses", F.lit(0)).alias("uses"))


def _by_scope(cells: DataFrame) -> DataFrame:
    return cells.groupBy("token", "file").agg(F.bool_or("in_scope").alias("in_scope"))


def consumer_counts(cells: DataFrame) -> DataFrame:
    """token, in_files, out_files (distinct files), only_outside."""
    return _by_scope(cells).groupBy("token").agg(F.count_if("in_scope").alias("in_files"), F.count_if(~F.col("in_scope")).alias("out_files"), (~F.bool_or("in_scope")).alias("only_outside"))


def consumers(cells: DataFrame, most: int = 10) -> DataFrame:
    """consumer_counts() with out_sample, the first `most` files outside."""
    sample = _sample(_by_scope(cells).where(~F.col("in_scope")), most, "out_sample")
    return consumer_counts(cells).join(sample, "token", "left").select("token", "in_files", "out_files", F.coalesce("out_sample", F.array()).alias("out_sample"), "only_outside")


def _sample(rows: DataFrame, most: int, name: str) -> DataFrame:
    """token and an array of its first files (token, file: distinct).

    The least files of the buckets of a token are distinct files, so the `most`-th of them is no less than its `most`-th file of all: only
    files up to there are ordered, and no task sorts all files of a token. A token of fewer buckets keeps all its files.
    """
    own = rows.select("token", "file")
    least = own.groupBy("token", F.pmod(F.xxhash64("file"), F.lit(64 * most)).alias("bucket")).agg(F.min("file").alias("file"))
    bound = firsts(least, ["token"], ["file"], most).groupBy("token").agg(F.when(F.count("*") == most, F.max("file")).alias("bound"))
    near = own.join(F.broadcast(bound), "token").where(F.col("bound").isNull() | (F.col("file") <= F.col("bound"))).select("token", "file")
    return firsts(near, ["token"], ["file"], most).groupBy("token").agg(F.array_sort(F.collect_list("file")).alias(name))


def naming_bonus(a: Column, b: Column) -> Column:
    """0.2 for a pair x and onX, 0.15 for a common beginning of four characters, else 0. a, b: keys without their root."""
    on = lambda x: F.concat(F.lit("on"), F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    prefix = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4))
    return F.when((on(a) == b) | (on(b) == a), 0.2).when(prefix, 0.15).otherwise(0.0)


def key_of(token: Column) -> Column:
    return F.substring_index(token, ".", -1)


def pair_scores(cells: DataFrame) -> DataFrame:
    """a, b (a < b), jaccard of their file sets, bonus of their names, for every pair with either.

    Intersections come from a self join on file, unions by arithmetic; pairs that only their names join come from joins on
    the four-character beginning and on the onX form. Files that use very many tokens square; they are few in style code.
    """
    own = cells.select("token", "file").distinct()
    sizes = own.groupBy("token").agg(F.count("*").alias("n"))
    shared = own.select(F.col("token").alias("a"), "file").join(own.select(F.col("token").alias("b"), "file"), "file").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    tokens = sizes.select("token", key_of(F.col("token")).alias("key"))
    left, right = (tokens.select(F.col("token").alias(x), F.col("key").alias(f"k{x}")) for x in "ab")
    four = lambda x: F.when(F.length(x) >= 4, F.substring(x, 1, 4))
    on = lambda x: F.concat(F.lit("on"), F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    named = left.join(right, four(F.col("ka")) == four(F.col("kb"))).select("a", "b")
    named = named.union(left.join(right, on(F.col("ka")) == F.col("kb")).select("a", "b"))
    named = named.union(left.join(right, F.col("ka") == on(F.col("kb"))).select("a", "b")).where("a < b").distinct()
    pairs = shared.join(named, ["a", "b"], "full").select("a", "b", F.coalesce("both", F.lit(0)).alias("both"))
    pairs = pairs.join(sizes.select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("token").alias("b"), F.col("n").alias("nb")), "b")
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return pairs.select("a", "b", jaccard.alias("jaccard"), naming_bonus(key_of(F.col("a")), key_of(F.col("b"))).alias("bonus"))


def clusters(tokens: DataFrame, scores: DataFrame, tau: float = 0.5) -> tuple[DataFrame, float]:
    """token, cluster (its smallest token), and the threshold used: tau, raised by 0.1 up to 0.8 while one cluster holds over half of all tokens."""
    nodes = tokens.select(F.col("token").alias("node")).distinct()
    while True:
        edges = scores.where(F.round(F.col("jaccard") + F.col("bonus"), 9) >= tau).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = graph.components(nodes, edges).select(F.col("node").alias("token"), F.col("comp").alias("cluster"))
        top = found.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if tau >= 0.8 or not top["all"] or top.most <= top["all"] / 2:
            return found, tau
        tau = min(0.8, round(tau + 0.1, 10))


def strength(found: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster, tokens, strength: the mean score of all pairs of its tokens (at most 1, two decimals); 1 for a single token."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("tokens"))
    inner = scores.join(found.select(F.col("token").alias("a"), "cluster"), "a").join(found.select(F.col("token").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other")
    total = inner.groupBy("cluster").agg(F.sum(F.col("jaccard") + F.col("bonus")).alias("total"))
    pairs = F.col("tokens") * (F.col("tokens") - 1) / 2
    mean = F.least(F.lit(1.0), F.coalesce("total", F.lit(0.0)) / pairs)
    return sizes.join(total, "cluster", "left").select("cluster", "tokens", F.when(F.col("tokens") == 1, 1.0).otherwise(round_half_up(F.round(mean, 9))).alias("strength"))


def top_files(found: DataFrame, cells: DataFrame, most: int = 5) -> DataFrame:
    """cluster, rank, file, n: the files of the scope that use most of a cluster."""
    n = cells.where("in_scope").join(found, "token").groupBy("cluster", "file").agg(F.sum("n").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "file"))).where(F.col("rank") <= most).select("cluster", "rank", "file", "n")


def assigned(cells: DataFrame, definitions: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """consumers() with files (all), and defined_in, value and cluster of each token that is used; null where it has none."""
    own = consumers(cells, most).withColumn("files", F.col("in_files") + F.col("out_files"))
    known = definitions.groupBy("token").agg(F.min(F.struct("defined_in", "value")).alias("d"))
    return own.join(known, "token", "left").join(found, "token", "left").select("token", "d.defined_in", "d.value", "files", "in_files", "out_files", "out_sample", "cluster")


def blast_note(definitions: DataFrame, approach: str, blast: DataFrame | None = None, heavy: int = 3) -> DataFrame:
    """One row, note: what a redesign has to mind, in a sentence each on declarations, theming and the blast radius (blast_radius())."""
    n = definitions.agg(F.count("*").alias("n"))
    first = F.when(F.col("n") == 0, "No token module: the redesign can define its own.").otherwise(F.concat("n", F.lit(" declarations: read them before a value changes.")))
    theme = F.lit(f"Theming: {approach}.")
    if blast is None:
        return n.select(F.concat_ws(" ", first, theme, F.lit("No target, so no blast radius.")).alias("note"))
    far = blast.agg(F.count("*").alias("used"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("other_files") >= heavy, F.col("token")))), ", ").alias("far"))
    reach = F.when(F.col("far") != "", F.concat(F.lit("Many other files use "), "far", F.lit(": keep these or add new ones."))).when(F.col("used") > 0, "Few other files use the target's tokens.").otherwise("The target uses no shared tokens.")
    return n.join(F.broadcast(far), how="cross").select(F.concat_ws(" ", first, theme, reach).alias("note"))


def sparse_top(cells: DataFrame, most: int = 200) -> DataFrame:
    return cells.orderBy(F.col("n").desc(), "token", "file").limit(most)


def _by_target(cells: DataFrame, targets: DataFrame) -> DataFrame:
    own = targets.select(F.col("path").alias("file")).distinct().withColumn("own", F.lit(True))
    return cells.groupBy("token", "file").agg(F.sum("n").alias("n")).join(own, "file", "left")


def blast_counts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """token, hits (anywhere), other_files (distinct files outside the targets): of the tokens that target files (path) use."""
    counts = _by_target(cells, targets).groupBy("token").agg(F.sum("n").alias("hits"), F.count_if(F.col("own").isNull()).alias("other_files"), F.bool_or("own").alias("used"))
    return counts.where("used").select("token", "hits", "other_files")


def blast_radius(cells: DataFrame, targets: DataFrame, most: int = 20) -> DataFrame:
    """blast_counts() with sample, the first `most` of the other files."""
    sample = _sample(_by_target(cells, targets).where(F.col("own").isNull()), most, "sample")
    out = blast_counts(cells, targets).join(sample, "token", "left")
    return out.select("token", "hits", "other_files", F.coalesce("sample", F.array()).alias("sample")).orderBy(F.col("other_files").desc(), "token")


def earliest_phase(found: DataFrame, cells: DataFrame, phases: DataFrame) -> DataFrame:
    """cluster, phase: the first phase whose files (node) use any of its tokens."""
    return cells.select("token", F.col("file").alias("node")).join(found, "token").join(phases.select("node", "phase"), "node").groupBy("cluster").agg(F.min("phase").alias("phase"))


def theming(signals: DataFrame, most: int = 10) -> DataFrame:
    """approach, rank, files, evidence (path:line, the first `most`), chosen: the best approach of all; vanilla signals count only if nothing else is there."""
    shown = firsts(signals, ["approach"], ["path"], most).groupBy("approach").agg(F.array_sort(F.collect_list(F.concat_ws(":", "path", "line"))).alias("evidence"))
    tally = signals.groupBy("approach", "rank").agg(F.count("*").alias("files")).join(shown, "approach")
    best = tally.agg(F.min_by("approach", "rank").alias("best"))
    return tally.join(F.broadcast(best), how="cross").select("approach", "rank", "files", "evidence", (F.col("approach") == F.col("best")).alias("chosen"))
