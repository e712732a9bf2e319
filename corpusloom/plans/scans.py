"""The composed scans: what a migration touches, what a rebrand would resolve, what a redesign breaks or may rethink, the navigation, and the literals worth a token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract, graph, navigation, project, registry, rules, sequence, tokens
from ..sources.space import Space


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), how="cross")
    return out


def migration_readiness(verdict: Column, blocking: Column) -> Column:
    severe, stuck = verdict == "severe", blocking > 0
    return F.when(severe & stuck, "blockers").when(severe, "violations-first").when(stuck, "cycles-first").otherwise("ready")


def complexity(files: Column, token_count: Column, cycles: Column, phase_count: Column) -> Column:
    return F.when((files > 30) | (token_count > 50) | (cycles > 3), "high").when((files > 10) | (token_count > 20) | (phase_count > 4), "moderate").otherwise("low")


def migration(corpus: DataFrame, kind: str = "all", value: str = "", tau: float = 0.5) -> dict[str, DataFrame]:
    """scope, clusters, cycles, phases, violations, cluster_phases and a one-row summary with readiness and complexity."""
    space = Space(corpus.sparkSession, "migration")
    scope = space.keep(project.scope(corpus, kind, value), "scope")
    own = scope.where("role <> 'excluded'").select("path")
    refs = space.keep(extract.token_refs(corpus), "refs")
    cells = tokens.matrix(refs, own)
    used = cells.where("in_scope")
    scores = tokens.pair_scores(used)
    clusters, tau = tokens.clusters(used, scores, tau)
    nodes = own.select(F.col("path").alias("node"))
    edges = space.keep(project.import_graph(corpus).join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"), "edges")
    sccs = space.keep(graph.cycles(nodes, edges), "sccs")
    cycles = graph.classify_cycles(sccs, edges, project.barrels(corpus))
    phases = space.keep(graph.phases(nodes, edges, graph.file_kind(F.col("node"))), "phases")
    found = space.keep(rules.violations(corpus.join(own, "path", "left_semi")), "violations")
    counts = _row(_one(own, "files"), _one(used.select("token").distinct(), "tokens"), _one(cycles, "cycles"), _one(cycles.where("kind = 'genuine'"), "blocking"), phases.agg(F.count_distinct("phase").alias("phases")), _one(found, "violations"))
    verdict = rules.verdict(F.col("violations"), F.col("files"))
    summary = counts.select("*", F.lit(tau).alias("tau"), verdict.alias("verdict"), migration_readiness(verdict, F.col("blocking")).alias("readiness"), complexity(F.col("files"), F.col("tokens"), F.col("cycles"), F.col("phases")).alias("complexity"))
    return {"scope": scope, "clusters": clusters, "cycles": cycles, "phases": phases, "violations": found, "cluster_phases": tokens.earliest_phase(clusters, cells, phases), "summary": summary}


def temperature(family: Column) -> Column:
    return F.when(family.isin("red", "orange", "yellow", "magenta"), "warm").when(family.isin("cyan", "blue", "violet"), "cool").when(family.isNull(), "unknown").otherwise("neutral")


def posture(saturation: Column, language: Column, colors: Column) -> Column:
    s = F.coalesce(saturation, F.lit(0.0))
    return F.when((s > 0.6) | (language == "pill") | (colors > 14), "expressive").when((s < 0.25) & language.isin("sharp", "soft"), "restrained").otherwise("confident")


def era(language: Column, base: Column) -> Column:
    return F.when(language.isin("pill", "large"), "of-the-moment").when((language == "sharp") & (base == 8), "timeless").otherwise("mixed")


def convention(custom_fonts: Column, fit: Column) -> Column:
    return F.when((custom_fonts >= 2) | ((fit < 0.7) & (custom_fonts >= 1)), "distinct").when((custom_fonts == 0) & (fit > 0.85), "inherits-platform").otherwise("mostly-platform")


def rebrand_readiness(verdict: Column, colors: Column, violations: Column) -> Column:
    flags = (verdict == "incoherent").cast("int") + (colors >= 20).cast("int") + (violations == "severe").cast("int")
    return F.when(flags == 0, "coherent-enough").when(flags >= 2, "rebrand-recommended").otherwise("consider-rebrand")


def rebrand(corpus: DataFrame, threshold: float = 3.5) -> dict[str, DataFrame]:
    """facts, colors, fingerprint (one row of axes), incoherence, violations and a one-row summary with readiness."""
    space = Space(corpus.sparkSession, "rebrand")
    facts = space.keep(extract.style_facts(corpus), "facts")
    usages = facts.groupBy("kind", "value").agg(F.count("*").alias("usages"))
    number = lambda k: usages.where(F.col("kind") == k).select(F.col("value").cast("double").alias("value"), "usages")
    colors = space.keep(registry.color_clusters(usages.where("kind = 'color'").select(F.col("value").alias("hex"), "usages"), threshold), "colors")
    leaders = registry.leader_clusters(number("spacing"), 2.0).select(F.col("leader").alias("value"), F.col("usage").alias("usages"))
    fonts = _one(usages.where("kind = 'fontFamily'").where(~F.col("value").rlike(registry.SYSTEM_FONTS)), "custom_fonts")
    whole = _row(
        registry.palette(colors.select(F.col("leader").alias("hex"), F.col("usage").alias("usages"))),
        registry.rhythm(number("spacing")).select(F.col("base").alias("rhythm"), "fit"),
        registry.radius_language(number("radius")).select(F.col("dominant").alias("corners")),
        registry.density(leaders).select(F.col("axis").alias("density")),
        _one(colors, "colors"),
        _one(colors.where(F.size("members") > 1), "duplicate_colors"),
        fonts,
    )
    family = F.when(F.col("avg_hue").isNotNull(), F.col("dominant_hue"))
    axes = whole.select(
        "*",
        temperature(family).alias("temperature"),
        posture(F.col("avg_saturation"), F.col("corners"), F.col("colors")).alias("posture"),
        era(F.col("corners"), F.col("rhythm")).alias("era"),
        convention(F.col("custom_fonts"), F.col("fit")).alias("convention"),
        F.lit("undetermined").alias("voice"),
    )
    told = F.format_string("It reads as %s and %s, in %s density; its main hue is %s, its corners are %s, its rhythm is %s, and it has %s colors that look apart.", "temperature", "posture", "density", F.coalesce("dominant_hue", F.lit("none")), F.coalesce("corners", F.lit("unclear")), F.coalesce(F.col("rhythm").cast("string"), F.lit("unclear")), F.col("colors").cast("string"))
    fingerprint = axes.withColumn("paragraph", told)
    found = space.keep(rules.violations(corpus), "violations")
    odd = space.keep(registry.incoherence(facts, threshold), "incoherence")
    parts = _row(registry.incoherence_verdict(odd), _one(colors, "colors"), _one(found, "violations"), _one(corpus, "files"))
    verdict = rules.verdict(F.col("violations"), F.col("files"))
    summary = parts.select("*", verdict.alias("violation_verdict"), rebrand_readiness(F.col("verdict"), F.col("colors"), verdict).alias("readiness"))
    return {"facts": facts, "colors": colors, "fingerprint": fingerprint, "incoherence": odd, "violations": found, "summary": summary}


#: Elements, the ones that count as primitives, and the kinds of literals, each with the name of its inventory.
ELEMENT = r"<([A-Z][A-Za-z0-9_]*)\b"
PRIMITIVES = ["View", "Text", "ScrollView", "SafeAreaView", "Fragment"]
LITERAL_KINDS = {"color": "colors", "size": "sizes", "radius": "radii", "duration": "durations"}


def _within(target: str) -> Column:
    """Whether path is the target, or in it where the target is a folder."""
    target = target.rstrip("/")
    return (F.col("path") == target) | F.col("path").startswith(target + "/")


def _surface(corpus: DataFrame, space: Space) -> tuple[DataFrame, DataFrame, str]:
    """Declarations, approaches to theming with five sites each, and the approach chosen (unknown if there is none)."""
    modules = space.keep(extract.token_modules(corpus), "modules")
    theming = space.keep(tokens.theming(extract.theming_signals(corpus), 5), "theming")
    chosen = theming.where("chosen").first()
    return modules, theming, chosen.approach if chosen else "unknown"


def breaking(corpus: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """modules, theming, blast (with a target: a file or folder) and a one-row summary: what other files feel if the target's tokens change.

    The target's tokens are the roots of its references; all files' uses of them count, those inside longer references, too. A target
    that names no file has an empty blast radius, and the summary says that it is not resolved.
    """
    space = Space(corpus.sparkSession, "breaking")
    modules, theming, approach = _surface(corpus, space)
    own = corpus.where(_within(target) if target is not None else F.lit(False))
    resolved = target is not None and not own.select("path").isEmpty()
    cells = extract.token_refs(corpus, extract.ANY_TOKEN_REF).withColumnRenamed("path", "file").join(extract.deep_tokens(own), "token", "left_semi")
    blast = space.keep(tokens.blast_radius(cells, own.select("path")), "blast")
    note = tokens.blast_note(modules, approach, blast if resolved else None)
    counts = _row(_one(corpus, "files"), modules.agg(F.coalesce(F.bool_or(F.col("kind") == "token-module"), F.lit(False)).alias("has_token_module")), note)
    summary = counts.select("files", "has_token_module", F.lit(approach).alias("approach"), F.lit(resolved).alias("target_resolved"), "note")
    return {"modules": modules, "theming": theming, "blast": blast, "summary": summary}


def component_name(target: str) -> str:
    """The component a target stands for: a folder's or file's name; index files take their folder's."""
    *folders, base = target.rstrip("/").split("/")
    name = re.sub(r"\.(tsx?|jsx?)$", "", base)
    return folders[-1] if name == "index" and name != base and folders else name


def rethinking(corpus: DataFrame, target: str) -> dict[str, DataFrame]:
    """modules, theming, sites, neighbors, siblings, reused and a one-row summary: where a component stands, and what stands around it.

    sites: path, line, source of the first import of the component in each other file. The other parts are of these files only.
    """
    space = Space(corpus.sparkSession, "rethinking")
    modules, theming, approach = _surface(corpus, space)
    name = component_name(target)
    word = re.escape(name)
    imported = rf"""import\s+(?:\{{[^}}]*\b{word}\b[^}}]*\}}|{word}|\*\s+as\s+\w+)\s+from\s+['"]([^'"]+)['"]"""
    found = extract.occurrences(corpus.where(~_within(target)), imported, {"source": 1}).where("seq = 0")
    sites = space.keep(found.select("path", "line", "source"), "sites")
    users = corpus.join(sites.select("path"), "path", "left_semi")
    tags = space.keep(extract.occurrences(users, ELEMENT, {"tag": 1}).select("path", F.col("seq").alias("pos"), "tag"), "tags")
    neighbors = space.keep(sequence.neighbors(tags, name), "neighbors")
    shown = space.keep(sequence.siblings_by_file(tags.unionByName(sites.select("path", F.lit(-1).alias("pos"), F.lit(name).alias("tag"))), name, PRIMITIVES), "siblings")
    reused = space.keep(sequence.reused_styles(users), "reused")
    flat = reused.groupBy("path").agg(F.count("*").alias("n")).where("n >= 3")
    counts = _row(_one(corpus, "files"), _one(sites, "usages"), modules.agg(F.count("*").alias("declarations"), F.coalesce(F.bool_or(F.col("kind") == "token-module"), F.lit(False)).alias("has_token_module")), _one(flat, "flat"))
    used = F.when(F.col("usages") == 0, f"No file imports {name}: it is unused, or imported in another way.").otherwise(F.format_string(f"%d files use {name.replace('%', '%%')}.", "usages"))
    brand = F.when(F.col("declarations") == 0, "No token module: there is no vocabulary to compose from.").otherwise(F.format_string("%d declarations to compose from, none to change.", "declarations"))
    level = F.when(F.col("flat") > 0, F.format_string("In %d files the hierarchy looks flat.", "flat"))
    summary = counts.select("files", F.lit(name).alias("component"), "usages", "has_token_module", F.lit(approach).alias("approach"), F.concat_ws(" ", used, brand, level).alias("note"))
    return {"modules": modules, "theming": theming, "sites": sites, "neighbors": neighbors, "siblings": shown, "reused": reused, "summary": summary}


def flow(corpus: DataFrame, router: str) -> dict[str, DataFrame]:
    """screens, navigators, transitions, links, entries and a one-row summary of the navigation, by a router (project.flavor() tells it).

    `expo-router` reads routes from files; `react-navigation` reads declarations; any other has no navigation to map: empty parts.
    """
    if router == "react-navigation":
        calls = navigation.declared_calls(corpus).select("path", "line", "kind", "to")
        parts = {"screens": navigation.declared_screens(corpus), "navigators": navigation.declared_navigators(corpus), "transitions": calls, "links": navigation.declared_links(corpus), "entries": navigation.containers(corpus)}
    else:
        corpus = corpus if router == "expo-router" else corpus.limit(0)
        screens = navigation.screens(corpus)
        parts = {"screens": screens, "navigators": navigation.navigators(corpus), "transitions": navigation.transitions(corpus, screens), "links": navigation.deep_links(screens), "entries": navigation.entry_points(corpus)}
        router = router if router == "expo-router" else "unknown"
    space = Space(corpus.sparkSession, "flow")
    parts = {name: space.keep(part, name) for name, part in parts.items()}
    totals = navigation.summary(parts["screens"], parts["navigators"], parts["transitions"])
    summary = _row(totals, _one(parts["links"], "links"), navigation.note(totals, router)).withColumn("router", F.lit(router))
    return {**parts, "summary": summary}


def extraction(corpus: DataFrame, least: int = 3) -> dict[str, DataFrame]:
    """colors, sizes, radii, durations: the values that occur `least` times or more, with their first places; and a one-row summary."""
    space = Space(corpus.sparkSession, "extraction")
    found = space.keep(extract.literals(corpus), "literals")
    parts = {name: space.keep(registry.inventory(found.where(F.col("kind") == kind), least), name) for kind, name in LITERAL_KINDS.items()}
    counts = _row(_one(corpus, "files"), _one(found, "literals"), *(_one(part, name) for name, part in parts.items()))
    candidates = sum((F.col(name) for name in parts), F.lit(0))
    note = F.when(F.col("candidates") == 0, f"No literal occurs {least} times or more.").otherwise(F.format_string("%d literals are worth a token, the most frequent first.", "candidates"))
    summary = counts.withColumn("candidates", candidates).withColumn("least", F.lit(least)).withColumn("note", note)
    return {**parts, "summary": summary}
