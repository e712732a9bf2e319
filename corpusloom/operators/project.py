"""Projects: import resolution and closure, scopes, manifests, snapshots, lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph
from .extract import imports

#: Endings tried for an import, in order.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
LAYOUT = r"_layout\.(tsx?|jsx?)$|Navigator\.(tsx?|jsx?)$"
SCREEN = r"^app/(?!.*_layout).*\.(tsx?|jsx?)$|(?:^|/)(?:screens?|pages?)/[^/]+\.(tsx?|jsx?)$"


def normal_path(path: Column) -> Column:
    """A path without . and .. parts."""
    step = lambda out, s: F.when(s.isin("", "."), out).when((s == "..") & (F.size(out) > 0), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.concat(out, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve(specs: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, type_only: relative imports (path, spec, type_only) to existing files (path); the first ending that names a file counts."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    base = normal_path(F.concat(folder, F.col("spec")))
    tried = specs.where(F.col("spec").startswith(".")).select(F.col("path").alias("src"), "spec", "type_only", F.posexplode(F.array(*(F.concat(base, F.lit(e)) for e in ENDINGS))).alias("rank", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = found.groupBy("src", "spec", "type_only").agg(F.min_by("candidate", "rank").alias("dst"))
    return best.groupBy("src", "dst").agg(F.bool_and("type_only").alias("type_only"))


def import_graph(corpus: DataFrame) -> DataFrame:
    return resolve(imports(corpus), corpus)


def barrels(corpus: DataFrame) -> DataFrame:
    """node: index files of which over 0.6 of the lines (but blank ones and comments) export others."""
    own = corpus.where(F.col("path").rlike(r"(^|/)index\.(tsx?|jsx?)$"))
    code = F.filter(F.transform(F.split("text", "\n", -1), F.trim), lambda x: (x != "") & ~x.startswith("//"))
    share = F.size(F.filter(code, lambda x: x.rlike(r"^export\s+(?:\*|\{)"))) / F.greatest(F.size(code), F.lit(1))
    return own.where(share > 0.6).select(F.col("path").alias("node"))


def scope(corpus: DataFrame, kind: str = "all", value: str = "") -> DataFrame:
    """path, role (screen, component, excluded): screens of a scope, what they import, and layout files left out.

    kind: all, routes (a glob), tokens (an axis), flow (part of a path).
    """
    if kind == "routes":
        seeds = corpus.where(F.col("path").rlike(tx.glob_pattern(value)))
    elif kind == "tokens":
        seeds = corpus.where(F.col("text").rlike(rf"(?i)\b(?:tokens?|theme|colors?|palette)\.{value}\b"))
    else:
        seeds = corpus.where(F.col("path").rlike(SCREEN) & F.lower("path").contains(value.lower()))
    layout = F.col("path").rlike(LAYOUT)
    screens = seeds.where(~layout).select("path")
    near = graph.reach(screens.select(F.col("path").alias("node")), import_graph(corpus).select("src", "dst"))
    parts = near.select(F.col("node").alias("path")).join(screens, "path", "left_anti").where(~F.col("path").rlike(SCREEN))
    out = screens.withColumn("role", F.lit("screen")).unionByName(parts.withColumn("role", F.lit("component")))
    return out.unionByName(seeds.where(layout).select("path", F.lit("excluded").alias("role")))


def flavor(manifests: DataFrame) -> DataFrame:
    """flavor, router, styling, new_arch, sdk_version, rn_version of each manifest (path, text, config: the app's configuration text or null).

    A text that is no JSON object gives unknown and nulls.
    """
    part = lambda k: F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    dev, own = part("devDependencies"), part("dependencies")
    has = lambda n: F.map_contains_key("dev", n) | F.map_contains_key("own", n)
    version = lambda n: tx.strip_range(F.coalesce(F.col("dev")[n], F.col("own")[n]))
    rows = manifests.withColumn("dev", dev).withColumn("own", own)
    mentions = lambda c: F.coalesce(F.col(c).rlike(r"""newArchEnabled["']?\s*:\s*true"""), F.lit(False))
    rn = version("react-native")
    pick = lambda pairs, other: F.coalesce(*(F.when(has(n), v) for n, v in pairs), F.lit(other))
    return rows.select(
        "path",
        pick([("expo", "expo"), ("react-native", "bare")], "unknown").alias("flavor"),
        pick([("expo-router", "expo-router"), ("@react-navigation/native", "react-navigation")], "unknown").alias("router"),
        pick([("nativewind", "nativewind"), ("react-native-unistyles", "unistyles")], "stylesheet").alias("styling"),
        (F.coalesce(tx.version_at_least(rn, 0, 73), F.lit(False)) | mentions("text") | mentions("config")).alias("new_arch"),
        version("expo").alias("sdk_version"),
        rn.alias("rn_version"),
    )


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """slug, stamp, name, content of snapshots (slug, meta map, body, at): computed keys beat given ones, of one slug and second the last counts."""
    stamp = tx.file_stamp(F.col("at"))
    keys = F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("timestamp", "slug") & v.isNotNull()), F.create_map(F.lit("timestamp"), stamp, F.lit("slug"), F.col("slug")))
    quoted = lambda v: F.when(v.rlike("[:#]"), F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)).otherwise(v)
    front = F.array_join(F.transform(F.map_entries(keys), lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"]))), "\n")
    text = F.concat(F.lit("---\n"), front, F.lit("\n---\n"), tx.trimmed(F.col("body")), F.lit("\n"))
    rows = snapshots.where("slug <> ''").select("slug", stamp.alias("stamp"), F.concat(stamp, F.lit("__"), F.col("slug"), F.lit(".md")).alias("name"), text.alias("content"), "at")
    return rows.groupBy("slug", "stamp", "name").agg(F.max_by("content", "at").alias("content"))


def snapshot_meta(text: Column) -> Column:
    """The front matter of a snapshot as a map of strings, cut at the first colon of a line; quoted values without their quotes."""
    front = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = F.filter(F.split(front, r"\r?\n"), lambda x: x.contains(":"))
    unquote = lambda v: F.when(v.rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), unquote(F.trim(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x)))).alias("value")))
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def owned_skills(skills: DataFrame, lock: DataFrame, source: str, word: str, fingerprints: dict[str, str] | None = None, prefix: str = "i-") -> DataFrame:
    """name, owned: a skill (name, body) is owned if the lock (name, source) says so, else if its body has the word, else the fingerprint of its name without the prefix."""
    known = skills.join(lock.select("name", F.col("source").alias("_s")), "name", "left")
    body, marks = F.coalesce("body", F.lit("")), F.create_map(*(F.lit(x) for kv in (fingerprints or {"": ""}).items() for x in kv))
    bare = F.when(F.col("name").startswith(prefix), F.substring("name", len(prefix) + 1, 1 << 20)).otherwise(F.col("name"))
    marked = F.coalesce((marks[bare] != "") & body.contains(marks[bare]), F.lit(False))
    return known.select("name", F.coalesce(F.col("_s") == source, body.rlike(rf"(?i)\b\Q{word}\E\b") | marked).alias("owned"))


def clean_lock(lock: DataFrame, gone: DataFrame) -> DataFrame:
    return lock.join(gone.select("name"), "name", "left_anti")


def skill_bundles(files: DataFrame) -> DataFrame:
    """name, body, references, scripts, agents (arrays of name, content, by name) of each skill folder: <skill>/SKILL.md and the files in its sub-folders."""
    parts = F.split("path", "/")
    rows = files.where(F.size(parts) >= 2).select(F.element_at(parts, 1).alias("name"), F.when(F.size(parts) > 2, F.element_at(parts, 2)).alias("kind"), F.element_at(parts, -1).alias("file"), "text")
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("file").alias("name"), F.col("text").alias("content")))))
    found = rows.groupBy("name").agg(F.max(F.when(F.col("kind").isNull() & (F.col("file") == "SKILL.md"), F.col("text"))).alias("body"), pick("reference").alias("references"), pick("scripts").alias("scripts"), pick("agents").alias("agents"))
    return found.where("body is not null")


def deprecated_targets(names: DataFrame, folders: DataFrame, existing: DataFrame, prefixes: tuple[str, ...] = ("", "i-")) -> DataFrame:
    """path: every folder/prefix+name that exists."""
    cut = F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1
    own = existing.select("path", F.substring_index("path", "/", -1).alias("name"), F.substring(F.col("path"), F.lit(1), cut).alias("folder"))
    wanted = names.select(F.explode(F.array(*(F.concat(F.lit(p), "name") for p in prefixes))).alias("name"))
    return own.join(wanted, "name", "left_semi").join(folders.select("folder"), "folder", "left_semi").select("path")


def snapshots_of(files: DataFrame, slug: str) -> DataFrame:
    """files (path) that are snapshots of a slug, oldest first: their names begin with the time."""
    name = F.substring_index("path", "/", -1)
    return files.where(name.endswith(f"__{slug}.md")).orderBy(name)


def project_root(files: DataFrame, start: str, marks: tuple[str, ...] = ("package.json", ".git")) -> DataFrame:
    """root: the nearest folder at or above start that holds one of the marks, of files (path); start itself if none does."""
    parts = start.strip("/").split("/") if start.strip("/") else []
    above = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]
    tried = files.sparkSession.createDataFrame([(f"{a}/{m}".lstrip("/"), a, k) for k, a in enumerate(above) for m in marks], "path string, root string, k int")
    return files.select(F.regexp_replace("path", "^/", "").alias("path")).join(tried, "path").agg(F.coalesce(F.min_by("root", "k"), F.lit("/".join(parts))).alias("root"))
