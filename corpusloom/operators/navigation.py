"""Screens, navigators, transitions, deep links and entry points of routed source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .extract import attributes, located, occurrences

ROUTED = r"^(src/)?app/.*\.(tsx?|jsx?)$"
MODAL = r"""presentation\s*:\s*['"`]modal['"`]"""
#: Calls and links that lead to a route, and the navigator factories.
CALL = r"""(?:router|navigation)\.(push|replace|navigate|back)\s*\(\s*['"`]([^'"`]+)['"`]"""
LINK = r"""<Link[^>]*\shref\s*=\s*(?:['"`]([^'"`]+)['"`]|\{[^}]*['"`]([^'"`]+)['"`])"""
FACTORY = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*create(NativeStack|Stack|BottomTab|Tab|MaterialTopTab|MaterialBottomTab|Drawer)Navigator"
SCREEN_TAG = r"<([A-Za-z_$][\w$]*)\.Screen\s+([^>]*?)/?>"
NAV_CALL = r"""(?:navigation|props\.navigation)\.(navigate|push|replace|popTo|reset)\s*\(\s*['"`]([^'"`]+)['"`]"""


def routed(corpus: DataFrame) -> DataFrame:
    """Files under app/, or under src/app/ if there is no app/."""
    own = corpus.where(F.col("path").rlike(ROUTED))
    first = own.agg(F.min(F.col("path").startswith("src/")).alias("src"))
    return own.join(F.broadcast(first), how="cross").where(F.col("path").startswith("src/") == F.col("src")).drop("src")


def _base(path):
    return F.element_at(tx.file_segments(path), -1)


def navigators(corpus: DataFrame) -> DataFrame:
    """path, name (folders, root for none), type of every layout file."""
    layouts = routed(corpus).where(_base(F.col("path")) == "_layout")
    folders = F.slice(tx.file_segments(F.col("path")), F.lit(1), F.size(tx.file_segments(F.col("path"))) - 1)
    kind = F.when(F.col("text").rlike(r"<Tabs[\s>]"), "tabs").when(F.col("text").rlike(r"<Drawer[\s>]"), "drawer").when(F.col("text").rlike(r"<Stack[\s>]"), "stack").when(F.col("text").rlike(r"<Slot[\s/>]"), "slot").otherwise("unknown")
    return layouts.select("path", F.when(F.size(folders) == 0, "root").otherwise(F.array_join(folders, "/")).alias("name"), kind.alias("type"))


def screens(corpus: DataFrame) -> DataFrame:
    """path, name, route, params, kind of every routed file. A name that a layout presents as modal is one."""
    own = routed(corpus)
    base, segments = _base(F.col("path")), tx.file_segments(F.col("path"))
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    seen = F.filter(folders, lambda s: ~s.rlike(r"^\(.+\)$"))
    name = F.when(base != "index", base).otherwise(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("home")))
    kind = F.when(base.startswith("+"), "special").when(F.exists(folders, lambda s: s.isin("modal", "(modal)")) | base.rlike("(?i)modal") | F.col("text").rlike(MODAL), "modal").otherwise("screen")
    found = own.where(~base.isin("_layout", "+not-found", "+native-intent")).select("path", name.alias("name"), tx.file_route(F.col("path")).alias("route"), tx.route_params(F.col("path")).alias("params"), kind.alias("kind"))
    tags = occurrences(own.where(base == "_layout"), r"<Stack\.Screen\s+([^>]*?)/?>", {"a": 1}).where(F.col("a").rlike(MODAL))
    modal = tags.select(F.regexp_extract("a", r"""name\s*=\s*['"`]([^'"`]+)['"`]""", 1).alias("name")).where("name <> ''").distinct().withColumn("modal", F.lit(True))
    return found.join(modal, "name", "left").select("path", "name", "route", "params", F.when(F.col("modal"), "modal").otherwise(F.col("kind")).alias("kind"))


def transitions(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """path, line, kind, route, to: where calls and links lead; to is the screen's name, else the route. Of screens with one route the last path counts."""
    calls = located(occurrences(corpus, CALL, {"kind": 1, "r": 2})).select("path", "line", "kind", tx.normal_route(F.col("r")).alias("route"))
    links = located(occurrences(corpus, LINK, {"a": 1, "b": 2})).select("path", "line", F.lit("link").alias("kind"), tx.normal_route(F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b"))).alias("route"))
    names = found.groupBy("route").agg(F.max_by("name", "path").alias("name"))
    return calls.unionByName(links).join(names, "route", "left").select("path", "line", "kind", "route", F.coalesce("name", "route").alias("to"))


def deep_links(found: DataFrame) -> DataFrame:
    return found.where("route <> '/'").select("route", F.col("name").alias("screen"), "path")


def entry_points(corpus: DataFrame) -> DataFrame:
    """path, kind: the root layout and the root index."""
    roots = navigators(corpus).where("name = 'root'").select("path", F.lit("root-layout").alias("kind"))
    index = screens(corpus).where("route = '/'").agg(F.min("path").alias("path")).where("path is not null").select("path", F.lit("root-index").alias("kind"))
    return roots.unionByName(index)


def hops(found: DataFrame, moves: DataFrame) -> DataFrame:
    """node (route), hops from the root along transitions between screens: an extra that hop-aware plans read."""
    from . import graph

    routes = found.select(F.col("path"), F.col("route").alias("src"))
    edges = moves.join(routes, "path").select("src", F.col("route").alias("dst"))
    return graph.reach(found.where("route = '/'").select(F.col("route").alias("node")), edges)


def declared_navigators(corpus: DataFrame) -> DataFrame:
    """path, name, type, line, children (in order) of navigators made by factories; a screen belongs to the navigator of its name in its file, wherever that stands."""
    made = located(occurrences(corpus, FACTORY, {"name": 1, "type": 2})).select("path", "name", F.lower("type").alias("type"), "line")
    tags = attributes(occurrences(corpus, SCREEN_TAG, {"name": 1, "a": 2}), "a")
    own = tags.select("path", "name", "seq", F.regexp_replace(F.col("attrs")["name"], r"""^['"`]|['"`]$""", "").alias("screen")).where("screen is not null")
    children = own.groupBy("path", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "screen"))), lambda s: s["screen"]).alias("children"))
    return made.join(children, ["path", "name"], "left").select("path", "name", "type", "line", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def declared_screens(corpus: DataFrame) -> DataFrame:
    """path, screen, navigator, type of screens whose navigator is declared in any file."""
    made = occurrences(corpus, FACTORY, {"name": 1, "type": 2}).groupBy("name").agg(F.max_by(F.lower("type"), F.struct("path", "seq")).alias("type"))
    tags = attributes(occurrences(corpus, SCREEN_TAG, {"name": 1, "a": 2}), "a")
    own = tags.select("path", F.col("name"), F.regexp_replace(F.col("attrs")["name"], r"""^['"`]|['"`]$""", "").alias("screen")).where("screen is not null")
    return own.join(made, "name").select("path", "screen", F.col("name").alias("navigator"), "type")


def declared_links(corpus: DataFrame) -> DataFrame:
    """path, screen, link of the screens in a linking block."""
    blocks = corpus.select("path", F.regexp_extract("text", r"linking\s*[:=]\s*\{[\s\S]*?screens\s*:\s*(\{[\s\S]*?\})", 1).alias("text")).where("text <> ''")
    return occurrences(blocks, r"""([A-Za-z_$][\w$]*)\s*:\s*['"`]([^'"`]+)['"`]""", {"screen": 1, "link": 2}).select("path", "screen", "link")


def declared_calls(corpus: DataFrame) -> DataFrame:
    return located(occurrences(corpus, NAV_CALL, {"kind": 1, "to": 2})).select("path", "line", "kind", "to")


def summary(found: DataFrame, navs: DataFrame, moves: DataFrame) -> DataFrame:
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(found, "screens").join(one(navs, "navigators"), how="cross").join(one(moves, "transitions"), how="cross")


def screens_for_flow(found: DataFrame, flow: str) -> DataFrame:
    """Screens whose route (or name, without a route) or navigator holds the flow's name, in any case."""
    part = F.lit(flow.lower())
    hit = F.lower(F.coalesce("route", "name") if "route" in found.columns else F.col("screen")).contains(part)
    return found.where(F.coalesce(hit, F.lit(False)) | F.coalesce(F.lower("navigator").contains(part), F.lit(False)) if "navigator" in found.columns else hit)


def containers(corpus: DataFrame) -> DataFrame:
    """path, line of every navigation container."""
    return located(occurrences(corpus, r"<NavigationContainer\b")).select("path", "line")


def note(totals: DataFrame, router: str) -> DataFrame:
    """One row, note: what was found of a router's navigation; totals as summary() gives them."""
    if router == "unknown":
        return totals.select(F.lit("No router that is known: there is no navigation to map.").alias("note"))
    counts = F.format_string("%d screens, %d navigators, %d transitions.", "screens", "navigators", "transitions")
    return totals.select(F.concat_ws(" ", F.lit(f"Router: {router}."), counts, F.when(F.col("screens") == 0, "No screens: look at the router's configuration.")).alias("note"))
