"""Queries over source texts that are rendered from keys: the operators read code, the SQL works the same out from the keys.

`part` gives a style file a row, `nation` and `region` a tree of routed files, `supplier` manifests, `customer` token definitions and
snapshots. What a text holds depends on its key by small remainders, so every branch of the rules occurs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import a11y, extract, graph, navigation, project, registry, rewrite, rules, tokens
from ..sources.space import Space
from .catalogue import derived_hex, query, table

K = "p_partkey"
#: The lines of a style file: {0} is the key, {1} a hex color, the others are remainders or chosen by one.
LINES = [
    "import {{ Box }} from '../components/C{5}';",
    "import type {{ T }} from './S{6}';",
    "const s = StyleSheet.create({{",
    "  a: {{ color: '{1}', padding: {2}, borderRadius: {3}, fontSize: {4} }},",
    "  b: {{ shadowColor: theme.shadow, shadowOpacity: 0.5{7} }},",
    "  c: {{ backgroundColor: tokens.surface{8}, gap: spacing.md }},",
    "}});",
    "export const V = () => <Pressable onPress={{go}}{9}><Text>Hi</Text></Pressable>;",
    "const d = {{ duration: {10} }};",
    "const k = <KeyboardAvoidingView{11}>;",
    "const h = () => Haptics.impactAsync();",
    "const i = <Image source={{x}}{12} />;",
    'const t = <TextInput placeholder="p" />;',
    "const m = <View className=\"card-{8} p-2\" style={{s.a}} />;",
]


def _slots(k: str, hex_: str) -> list[tuple]:
    """Slots as (kind, ...): a number, or texts by a remainder. Read both by Spark and for the SQL."""
    return [
        ("n", k), ("hex", hex_), ("n", f"{k} % 50"), ("n", f"{k} % 30"), ("n", f"8 + {k} % 20"), ("n", f"{k} % 5"), ("n", f"{k} + 1"),
        ("if", k, 2, ["", ", elevation: 4"]), ("n", f"{k} % 3"), ("if", k, 3, [' accessibilityRole="button"', "", ""]), ("n", f"100 + {k} % 400"),
        ("if", k, 4, [' behavior="padding"', "", " behavior={Platform.OS === 'ios' ? 'padding' : 'height'}", " enabled"]), ("if", k, 7, [' alt="x"', *[""] * 6]),
    ]


HEX_SQL = "'#' || lower(lpad(printf('%x', (p_partkey * 2654435761) % 16777216), 6, '0'))"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _parts(line: str) -> list[str | int]:
    """A line as texts and numbers of slots."""
    out: list[str | int] = []
    at = 0


    for m in re.finditer(r"\{\{|\}\}|\{(\d+)\}", line):
        out.append(line[at : m.start()])
        out.append(int(m[1]) if m[1] else m[0][0])
        at = m.end()
    return [x for x in [*out, line[at:]] if x != ""]


def line_sql(n: int) -> str:
    slots = _slots(K, "hex")
    as_sql = lambda s: s[1] if s[0] == "hex" else f"CAST({s[1]} AS VARCHAR)" if s[0] == "n" else f"CASE {s[1]} % {s[2]} " + " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(s[3])) + " END"
    return " || ".join(_q(x) if isinstance(x, str) else f"({as_sql(slots[x])})" for x in _parts(LINES[n - 1]))


def line_column(n: int) -> Column:
    slots, k = _slots(K, "hex"), F.col(K)
    pick = lambda s: derived_hex(k) if s[0] == "hex" else F.expr(f"CAST({s[1]} AS STRING)") if s[0] == "n" else F.element_at(F.array(*map(F.lit, s[3])), (k % s[2] + 1).cast("int"))
    return F.concat(*(F.lit(x) if isinstance(x, str) else pick(slots[x]) for x in _parts(LINES[n - 1])))


def style_files(spark: SparkSession, d: str) -> DataFrame:
    """Keys are small and their texts long, so keys are dealt to four tasks a core before texts are rendered."""
    part = table(spark, d, "part").select(K).repartition(4 * spark.sparkContext.defaultParallelism, K)
    return part.select(F.concat(F.lit("src/screens/S"), K, F.lit(".tsx")).alias("path"), F.concat_ws("\n", *(line_column(n) for n in range(1, len(LINES) + 1))).alias("text"))


FILES = f"WITH f AS (SELECT {K}, 'src/screens/S' || {K} || '.tsx' AS path, {HEX_SQL} AS hex FROM part)"
LITERALS_SQL = f"""{FILES}, lits AS (
SELECT path, 'color' AS kind, hex AS value, 4 AS line FROM f
UNION ALL SELECT path, 'size', CAST(CAST({K} % 50 AS DOUBLE) AS VARCHAR), 4 FROM f WHERE {K} % 50 > 1
UNION ALL SELECT path, 'size', CAST(CAST(8 + {K} % 20 AS DOUBLE) AS VARCHAR), 4 FROM f
UNION ALL SELECT path, 'radius', CAST(CAST({K} % 30 AS DOUBLE) AS VARCHAR), 4 FROM f WHERE {K} % 30 > 0
UNION ALL SELECT path, 'duration', CAST(CAST(100 + {K} % 400 AS DOUBLE) AS VARCHAR), 9 FROM f)"""


@query(f"{LITERALS_SQL} SELECT path, kind, value, line FROM lits")
def style_literals(spark: SparkSession, d: str) -> DataFrame:
    return extract.literals(style_files(spark, d)).select("path", "kind", "value", F.col("line").cast("int").alias("line"))


@query(f"""{LITERALS_SQL}, c AS (SELECT kind, value, count(*) AS n FROM lits GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT kind, value, path, line, row_number() OVER (PARTITION BY kind, value ORDER BY path, line) AS k FROM (SELECT DISTINCT * FROM lits))
SELECT kind || ' ' || value AS value, n, string_agg(path || ':' || line, ' ' ORDER BY path, line) AS places FROM r JOIN c USING (kind, value) WHERE k <= 20 GROUP BY ALL""")
def style_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Values on three places or more, with their first twenty."""
    found = extract.literals(style_files(spark, d)).select(F.concat_ws(" ", "kind", "value").alias("value"), "path", "line")
    found = Space(spark, "style-literals").keep(found, "found")  # texts are scanned once, though counts and places both read this
    places = F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["path"], x["line"])), " ")
    return registry.inventory(found).select("value", "n", places.alias("places"))


def _step_sql(value: str, scale: list[tuple[float, str]]) -> str:
    steps = ", ".join(f"{{'s': {s}, 'n': '{n}'}}" for s, n in scale)
    return f"list_extract(list_sort(list_transform([{steps}], lambda x, i: {{'d': abs({value} - x.s), 'i': i, 'n': x.n}})), 1).n"


def _violation_sql(kind: str, key: str, value: str, skip: str, scale: list[tuple[float, str]]) -> str:
    return f"SELECT path, 4 AS line, CAST(strpos(l, '{key}:') AS INTEGER) AS col, '{kind}' AS kind, '{key}: ' || ({value}) AS value, {_step_sql(value, scale)} AS nearest, substr(trim(l), 1, 80) AS context FROM g WHERE ({value}) NOT IN ({skip})"


VIOLATIONS_SQL = f"""{FILES}, g AS (SELECT *, {line_sql(4)} AS l FROM f), v AS (
SELECT path, 4 AS line, CAST(strpos(l, '#') AS INTEGER) AS col, 'inline-color' AS kind, hex AS value, CAST(NULL AS VARCHAR) AS nearest, substr(trim(l), 1, 80) AS context FROM g
UNION ALL {_violation_sql("magic-spacing", "padding", f"{K} % 50", "0, 1, 2, 100", rules.SPACING_SCALE)}
UNION ALL {_violation_sql("magic-radius", "borderRadius", f"{K} % 30", "0, 1, 2, 3, 4, 5, 6", rules.RADIUS_SCALE)}
UNION ALL {_violation_sql("magic-fontsize", "fontSize", f"8 + {K} % 20", "-1", rules.FONT_SCALE)})"""


@query(f"{VIOLATIONS_SQL} SELECT path, line, col, kind, value, nearest, context FROM v")
def style_violations(spark: SparkSession, d: str) -> DataFrame:
    found = rules.violations(style_files(spark, d))
    return found.select("path", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), "kind", "value", "nearest", "context")


@query(f"""{VIOLATIONS_SQL} SELECT kind, n, n // files AS per_file, CASE WHEN n = 0 THEN 'clean' WHEN n < 10 OR n / greatest(files, 1) < 2 THEN 'moderate' ELSE 'severe' END AS verdict
FROM (SELECT kind, count(*) AS n FROM v GROUP BY kind UNION ALL SELECT NULL, count(*) FROM v), (SELECT count(*) AS files FROM f)""")
def style_violation_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Totals by kind and in all, each with its verdict."""
    files = style_files(spark, d)
    totals = rules.violation_totals(rules.violations(files)).where("path is null").join(files.agg(F.count("*").alias("files")), how="cross")
    return totals.select("kind", "n", F.floor(F.col("n") / F.col("files")).alias("per_file"), rules.verdict(F.col("n"), F.col("files")).alias("verdict"))


@query(f"""{FILES}, t AS (SELECT *, {K} % 4 = 2 AS split FROM f), p AS (
SELECT 'PP001' AS rule, 'error' AS severity, path, 5 AS line, {line_sql(5)} AS l FROM t WHERE {K} % 2 = 0
UNION ALL SELECT 'PP003', CASE WHEN {K} % 4 = 0 THEN 'error' ELSE 'warning' END, path, 10, {line_sql(10)} FROM t WHERE NOT split
UNION ALL SELECT 'PP004', 'warning', path, 11, {line_sql(11)} FROM t WHERE NOT split
UNION ALL SELECT 'PP005', 'warning', path, 5, {line_sql(5)} FROM t WHERE NOT split)
SELECT rule, severity, path, line, trim(l) AS snippet FROM p""")
def style_parity(spark: SparkSession, d: str) -> DataFrame:
    return rules.parity(style_files(spark, d)).select("rule", "severity", "path", F.col("line").cast("int").alias("line"), "snippet")


@query(f"""{FILES}, p AS (
SELECT 'A11Y001' AS rule, 'error' AS severity, path, 8 AS line, {line_sql(8)} AS l FROM f WHERE {K} % 3 <> 0
UNION ALL SELECT 'A11Y003', 'warning', path, 12, {line_sql(12)} FROM f WHERE {K} % 7 <> 0
UNION ALL SELECT 'A11Y005', 'warning', path, 13, {line_sql(13)} FROM f)
SELECT rule, severity, path, line, trim(l) AS snippet FROM p""")
def style_accessibility(spark: SparkSession, d: str) -> DataFrame:
    return a11y.audit(style_files(spark, d)).select("rule", "severity", "path", F.col("line").cast("int").alias("line"), "snippet")


REFS_SQL = f"refs AS (SELECT path, unnest(['theme.shadow', 'tokens.surface' || ({K} % 3)]) AS token, CAST(1 AS BIGINT) AS n FROM f)"


@query(f"{FILES}, {REFS_SQL} SELECT path, token, n FROM refs")
def style_token_refs(spark: SparkSession, d: str) -> DataFrame:
    return extract.token_refs(style_files(spark, d))


@query(f"{FILES}, {REFS_SQL} SELECT token, path AS file, {K} % 2 = 0 AS in_scope, n FROM refs JOIN f USING (path)")
def style_token_matrix(spark: SparkSession, d: str) -> DataFrame:
    files = style_files(spark, d)
    even = files.where(F.regexp_extract("path", r"S(\d+)", 1).cast("long") % 2 == 0)
    return tokens.matrix(extract.token_refs(files), even)


@query(f"{FILES} SELECT path, unnest(['../components/C' || ({K} % 5), './S' || ({K} + 1)]) AS spec, unnest([false, true]) AS type_only FROM f")
def style_imports(spark: SparkSession, d: str) -> DataFrame:
    return extract.imports(style_files(spark, d))


@query(f"""{FILES} SELECT path AS src, 'src/screens/S' || ({K} + 1) || '.tsx' AS dst, true AS type_only FROM f WHERE {K} + 1 IN (SELECT {K} FROM f)
UNION ALL SELECT path, 'src/components/C' || ({K} % 5) || '/index.tsx', false FROM f""")
def style_import_graph(spark: SparkSession, d: str) -> DataFrame:
    """Imports that lead to a file: the next screen, and a component's folder."""
    files = style_files(spark, d)
    parts = spark.createDataFrame([(f"src/components/C{k}/index.tsx", "export const Box = 1;") for k in range(5)], "path string, text string")
    return project.import_graph(files.unionByName(parts))


@query(f"""{FILES} SELECT 'color' AS kind, hex AS value, path FROM f
UNION ALL SELECT 'fontSize', CAST(CAST(8 + {K} % 20 AS DOUBLE) AS VARCHAR), path FROM f
UNION ALL SELECT 'spacing', CAST(CAST({K} % 50 AS DOUBLE) AS VARCHAR), path FROM f
UNION ALL SELECT 'radius', CAST(CAST({K} % 30 AS DOUBLE) AS VARCHAR), path FROM f""")
def style_usages(spark: SparkSession, d: str) -> DataFrame:
    return extract.style_facts(style_files(spark, d))


@query(f"""{FILES} SELECT path, unnest(['nativewind', 'stylesheet']) AS approach, unnest([14, 3]) AS line FROM f""")
def style_theming(spark: SparkSession, d: str) -> DataFrame:
    return extract.theming_signals(style_files(spark, d)).select("path", "approach", F.col("line").cast("int").alias("line"))


def _edits(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), "before", "after", "kind")


@query(f"{FILES} SELECT path, 5 AS line, CAST(strpos(l, 'theme.shadow') AS INTEGER) AS col, 'theme.shadow' AS before, 'theme.depth' AS after, 'rename-dotted' AS kind FROM (SELECT path, {line_sql(5)} AS l FROM f)")
def edit_rename(spark: SparkSession, d: str) -> DataFrame:
    return _edits(rewrite.rename_access(style_files(spark, d), "theme.shadow", "theme.depth"))


@query(f"{FILES} SELECT path, 14 AS line, CAST(strpos(l, 'card-1') AS INTEGER) AS col, 'card-1' AS before, 'panel' AS after, 'class-rename' AS kind FROM (SELECT path, {line_sql(14)} AS l FROM f WHERE {K} % 3 = 1)")
def edit_class(spark: SparkSession, d: str) -> DataFrame:
    return _edits(rewrite.replace_class(style_files(spark, d), "card-1", "panel"))


@query(f"{FILES} SELECT path, 4 AS line, CAST(strpos(l, '''' || hex) AS INTEGER) AS col, '''' || hex || '''' AS before, 'colors.brand' AS after, 'literal-promote' AS kind FROM (SELECT path, hex, {line_sql(4)} AS l FROM f) WHERE hex = '#3779b1'")
def edit_literal(spark: SparkSession, d: str) -> DataFrame:
    """A color with its quotes."""
    return _edits(rewrite.promote_literal(style_files(spark, d), "#3779b1", "colors.brand"))


@query(f"{FILES} SELECT path, 4 AS line, CAST(strpos(l, 'padding: 8') AS INTEGER) AS col, 'padding: 8' AS before, 'padding: spacing.sm' AS after, 'numeric-promote' AS kind FROM (SELECT path, {line_sql(4)} AS l FROM f WHERE {K} % 50 = 8)")
def edit_number(spark: SparkSession, d: str) -> DataFrame:
    return _edits(rewrite.promote_number(style_files(spark, d), "padding", "8", "spacing.sm"))


@query(f"""{FILES}, e AS (SELECT path, {" || chr(10) || ".join(f"({line_sql(n)})" for n in range(1, len(LINES) + 1))} AS t FROM f)
SELECT path, md5(replace(t, 'theme.shadow', 'theme.depth')) AS text_md5, 'edited' AS status FROM e""")
def edit_applied(spark: SparkSession, d: str) -> DataFrame:
    files = style_files(spark, d)
    return rewrite.apply(files, rewrite.rename_access(files, "theme.shadow", "theme.depth")).select("path", F.md5("text").alias("text_md5"), "status")


# routed files


def routed_files(spark: SparkSession, d: str) -> DataFrame:
    """A root layout and index, a layout for each region, a screen for each nation."""
    root = spark.createDataFrame([("app/_layout.tsx", "export default () => <Stack />;"), ("app/index.tsx", "export default () => <Link href=\"/r0/n0\">go</Link>;")], "path string, text string")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("r"))
    kind = F.element_at(F.array(*map(F.lit, ["<Tabs>", "<Drawer>", "<Slot />", "<Stack>"])), F.col("r") % 4 + 1)
    layouts = region.select(F.concat(F.lit("app/(main)/r"), "r", F.lit("/_layout.tsx")).alias("path"), F.concat(F.lit("export default () => "), kind, F.lit(";")).alias("text"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    name = F.when(F.col("n") % 6 == 5, F.concat(F.lit("[id"), "n", F.lit("]"))).otherwise(F.concat(F.lit("n"), "n"))
    call = F.when(F.col("n") % 2 == 0, "router.push('/r0/n0/?from=x');").otherwise("const a = 1;\nnavigation.navigate('/nowhere');")
    modal = F.when(F.col("n") % 5 == 3, "\nconst o = { presentation: 'modal' };").otherwise("")
    screens = nation.select(F.concat(F.lit("app/(main)/r"), "r", F.lit("/"), name, F.lit(".tsx")).alias("path"), F.concat(call, modal).alias("text"))
    return root.unionByName(layouts).unionByName(screens)


ROUTED_SQL = """WITH s AS (SELECT n_nationkey AS n, n_regionkey AS r, CASE WHEN n_nationkey % 6 = 5 THEN '[id' || n_nationkey || ']' ELSE 'n' || n_nationkey END AS name FROM nation),
screens AS (SELECT 'app/(main)/r' || r || '/' || name || '.tsx' AS path, name, '/r' || r || '/' || name AS route, CASE WHEN n % 5 = 3 THEN 'modal' ELSE 'screen' END AS kind,
  CASE WHEN n % 6 = 5 THEN 'id' || n ELSE '' END AS params, n FROM s UNION ALL SELECT 'app/index.tsx', 'home', '/', 'screen', '', -1)"""


@query(ROUTED_SQL + " SELECT path, name, route, params, kind FROM screens")
def routed_screens(spark: SparkSession, d: str) -> DataFrame:
    return navigation.screens(routed_files(spark, d)).select("path", "name", "route", F.array_join(F.transform("params", lambda p: p["name"]), ",").alias("params"), "kind")


@query("""SELECT 'app/(main)/r' || r_regionkey || '/_layout.tsx' AS path, '(main)/r' || r_regionkey AS name, CASE r_regionkey % 4 WHEN 0 THEN 'tabs' WHEN 1 THEN 'drawer' WHEN 2 THEN 'slot' ELSE 'stack' END AS type FROM region
UNION ALL SELECT 'app/_layout.tsx', 'root', 'stack'""")
def routed_navigators(spark: SparkSession, d: str) -> DataFrame:
    return navigation.navigators(routed_files(spark, d))


MOVES_SQL = ROUTED_SQL + """, moves AS (SELECT path, 1 AS line, 'push' AS kind, '/r0/n0' AS route FROM screens WHERE n >= 0 AND n % 2 = 0
UNION ALL SELECT path, 2, 'navigate', '/nowhere' FROM screens WHERE n % 2 = 1 UNION ALL SELECT path, 1, 'link', '/r0/n0' FROM screens WHERE n = -1)"""


@query(MOVES_SQL + ' SELECT m.path, m.line, m.kind, m.route, coalesce(t.name, m.route) AS "to" FROM moves m LEFT JOIN screens t ON t.route = m.route')
def routed_transitions(spark: SparkSession, d: str) -> DataFrame:
    files = routed_files(spark, d)
    return navigation.transitions(files, navigation.screens(files)).select("path", F.col("line").cast("int").alias("line"), "kind", "route", "to")


@query(ROUTED_SQL + " SELECT route, name AS screen, path FROM screens WHERE route <> '/'")
def routed_deep_links(spark: SparkSession, d: str) -> DataFrame:
    return navigation.deep_links(navigation.screens(routed_files(spark, d)))


@query("SELECT unnest(['app/_layout.tsx', 'app/index.tsx']) AS path, unnest(['root-layout', 'root-index']) AS kind")
def routed_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return navigation.entry_points(routed_files(spark, d))


@query(MOVES_SQL + " SELECT CAST((SELECT count(*) FROM screens) AS BIGINT) AS screens, CAST((SELECT count(*) + 1 FROM region) AS BIGINT) AS navigators, CAST((SELECT count(*) FROM moves) AS BIGINT) AS transitions")
def routed_summary(spark: SparkSession, d: str) -> DataFrame:
    files = routed_files(spark, d)
    found = navigation.screens(files)
    return navigation.summary(found, navigation.navigators(files), navigation.transitions(files, found))


@query(ROUTED_SQL + " SELECT path, route FROM screens WHERE contains(lower(route), 'r1/')")
def routed_flow(spark: SparkSession, d: str) -> DataFrame:
    return navigation.screens_for_flow(navigation.screens(routed_files(spark, d)), "R1/").select("path", "route")


@query(ROUTED_SQL + " SELECT DISTINCT route AS node, 1 AS hops FROM screens WHERE route = '/r0/n0' UNION ALL SELECT '/', 0")
def routed_hops(spark: SparkSession, d: str) -> DataFrame:
    files = routed_files(spark, d)
    found = navigation.screens(files)
    moves = navigation.transitions(files, found).where("kind = 'link'")
    return navigation.hops(found, moves).select("node", F.col("hops").cast("int").alias("hops"))


# graphs of parts


def part_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """nodes: parts; edges from k to k / 2, rounded down."""
    nodes = table(spark, d, "part").select(F.col(K).alias("node"))
    return nodes, nodes.where("node > 1").select(F.col("node").alias("src"), F.floor(F.col("node") / 2).cast("long").alias("dst"))


@query(f"SELECT {K} AS node, CAST(len(bin({K})) - 1 AS INTEGER) AS level FROM part")
def part_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(*part_tree(spark, d))


@query(f"SELECT {K} AS node, CAST(len(bin({K})) - 1 AS INTEGER) AS hops FROM part WHERE p_partkey > 0")
def part_hops(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = part_tree(spark, d)
    return graph.reach(nodes.where("node = 1"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"""WITH n AS (SELECT {K} AS node, {K} // 10 AS g FROM part), s AS (SELECT g, min(node) AS least FROM n GROUP BY g HAVING count(*) = 10)
SELECT node, coalesce(least, node) AS scc, CAST(CASE WHEN least IS NULL THEN 1 ELSE 10 END AS BIGINT) AS size FROM n LEFT JOIN s USING (g)""")
def part_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Rings of ten parts, where all ten are there."""
    nodes = table(spark, d, "part").select(F.col(K).alias("node"))
    edges = nodes.select(F.col("node").alias("src"), (F.floor(F.col("node") / 10) * 10 + (F.col("node") + 1) % 10).cast("long").alias("dst"))
    return graph.cycles(nodes, edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))


@query(f"""WITH n AS (SELECT {K} AS node, len(bin({K})) - 1 AS level, CAST((SELECT count(*) FROM part c WHERE c.{K} // 2 = p.{K} AND c.{K} > 1) AS BIGINT) AS importers FROM part p)
SELECT node, importers, CAST(row_number() OVER (PARTITION BY level ORDER BY importers DESC, node) AS INTEGER) AS place FROM n""")
def part_order(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = part_tree(spark, d)
    return graph.ready_order(graph.levels(nodes, edges), graph.fan_out(nodes, edges)).select("node", "importers", F.col("place").cast("int").alias("place"))


@query("SELECT 'theme.shadow' AS token UNION SELECT 'tokens.surface' || (p_partkey % 3) FROM part")
def style_deep_tokens(spark: SparkSession, d: str) -> DataFrame:
    return extract.deep_tokens(style_files(spark, d))


# declared navigators


def declared_files(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier a file that makes a navigator, names two screens, links one and calls the other."""
    s, kind = F.col("s_suppkey"), F.element_at(F.array(*map(F.lit, ["NativeStack", "BottomTab", "Drawer"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit("const Nav"), s, F.lit(" = create"), kind, F.lit("Navigator();\n<Nav"), s, F.lit('.Screen name="Home" component={H} />\n<Nav'), s, F.lit(".Screen name=\"Item"), s, F.lit("\" />\nnavigation.navigate('Item"), s, F.lit("');\nconst linking = { config: { screens: { Home: 'home/"), s, F.lit("' } } };"))
    return table(spark, d, "supplier").select(F.concat(F.lit("src/nav/N"), s, F.lit(".tsx")).alias("path"), text.alias("text"))


DECLARED_SQL = "WITH n AS (SELECT s_suppkey AS s, 'src/nav/N' || s_suppkey || '.tsx' AS path, CASE s_suppkey % 3 WHEN 0 THEN 'nativestack' WHEN 1 THEN 'bottomtab' ELSE 'drawer' END AS type FROM supplier)"


@query(DECLARED_SQL + " SELECT path, 'Nav' || s AS name, type, 1 AS line, 'Home,Item' || s AS children FROM n")
def declared_navigators(spark: SparkSession, d: str) -> DataFrame:
    return navigation.declared_navigators(declared_files(spark, d)).select("path", "name", "type", F.col("line").cast("int").alias("line"), F.array_join("children", ",").alias("children"))


@query(DECLARED_SQL + " SELECT path, unnest(['Home', 'Item' || s]) AS screen, 'Nav' || s AS navigator, type FROM n")
def declared_screens(spark: SparkSession, d: str) -> DataFrame:
    return navigation.declared_screens(declared_files(spark, d))


@query(DECLARED_SQL + " SELECT path, 'Home' AS screen, 'home/' || s AS link FROM n")
def declared_links(spark: SparkSession, d: str) -> DataFrame:
    return navigation.declared_links(declared_files(spark, d))


@query(DECLARED_SQL + """ SELECT path, 4 AS line, 'navigate' AS kind, 'Item' || s AS "to" FROM n""")
def declared_calls(spark: SparkSession, d: str) -> DataFrame:
    return navigation.declared_calls(declared_files(spark, d)).select("path", F.col("line").cast("int").alias("line"), "kind", "to")


# definitions, manifests, snapshots


def definition_files(spark: SparkSession, d: str) -> DataFrame:
    """A customer's token file: an exported object of two tokens."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("export const colors"), k, F.lit(" = {\n  primary: '"), derived_hex(k), F.lit("',\n  onPrimary: '#ffffff',\n};"))
    return table(spark, d, "customer").select(F.concat(F.lit("src/c"), k, F.lit("/tokens.ts")).alias("path"), text.alias("text"))


CUSTOMER_HEX = HEX_SQL.replace("p_partkey", "c_custkey")


@query(f"""SELECT 'colors' || c_custkey || '.' || key AS token, 'src/c' || c_custkey || '/tokens.ts:' || line AS defined_in, value
FROM (SELECT c_custkey, unnest(['primary', 'onPrimary']) AS key, unnest([2, 3]) AS line, unnest([{CUSTOMER_HEX}, '#ffffff']) AS value FROM customer)""")
def token_definitions(spark: SparkSession, d: str) -> DataFrame:
    return extract.token_definitions(definition_files(spark, d))


@query("SELECT 'src/c' || c_custkey || '/tokens.ts' AS path, 'token-module' AS kind, 'colors' || c_custkey AS exports, 1 AS line FROM customer")
def token_modules(spark: SparkSession, d: str) -> DataFrame:
    return extract.token_modules(definition_files(spark, d)).select("path", "kind", F.array_join("exports", ",").alias("exports"), F.col("line").cast("int").alias("line"))


@query(f"""SELECT 'src/c' || c_custkey || '/tokens.ts' AS path, 'onPrimary' AS token, 'edit' AS status, 3 AS line, '  onPrimary: ''#000000'',' AS after FROM customer
UNION ALL SELECT 'src/c' || c_custkey || '/tokens.ts', 'primary', CASE WHEN {CUSTOMER_HEX} = '#3779b1' THEN 'skipped' ELSE 'edit' END, CASE WHEN {CUSTOMER_HEX} = '#3779b1' THEN NULL ELSE 2 END, CASE WHEN {CUSTOMER_HEX} = '#3779b1' THEN NULL ELSE '  primary: ''#3779b1'',' END FROM customer""")
def token_value_edits(spark: SparkSession, d: str) -> DataFrame:
    found = rewrite.token_edits(definition_files(spark, d), [("onPrimary", "#000000"), ("primary", "#3779b1")])
    return found.select("path", "token", "status", "line", "after")


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    expo = F.when(s % 2 == 0, '"expo": "~51.0.2", "expo-router": "^3.5.0", ').otherwise("")
    text = F.concat(F.lit('{"dependencies": {'), expo, F.lit('"react-native": "^0.'), (70 + s % 8).cast("string"), F.lit('.1"'), F.when(s % 3 == 0, ', "nativewind": "4.0.1"').otherwise(""), F.lit("}}"))
    return table(spark, d, "supplier").select(F.concat(F.lit("p"), s, F.lit("/package.json")).alias("path"), text.alias("text"), F.lit(None).cast("string").alias("config"))


@query("""SELECT 'p' || s_suppkey || '/package.json' AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'expo' ELSE 'bare' END AS flavor, CASE WHEN s_suppkey % 2 = 0 THEN 'expo-router' ELSE 'unknown' END AS router,
CASE WHEN s_suppkey % 3 = 0 THEN 'nativewind' ELSE 'stylesheet' END AS styling, 70 + s_suppkey % 8 >= 73 AS new_arch, CASE WHEN s_suppkey % 2 = 0 THEN '51.0.2' END AS sdk_version, '0.' || (70 + s_suppkey % 8) || '.1' AS rn_version FROM supplier""")
def manifest_flavor(spark: SparkSession, d: str) -> DataFrame:
    return project.flavor(manifest_files(spark, d))


@query("""SELECT slug, stamp, stamp || '__' || slug || '.md' AS name, '---' || chr(10) || 'total: ' || n || chr(10) || 'timestamp: ' || stamp || chr(10) || 'slug: ' || slug || chr(10) || '---' || chr(10) || 'Body of ' || slug || chr(10) AS content
FROM (SELECT 'c' || o_custkey AS slug, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') AS stamp, o_orderkey AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)""")
def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot for each customer and order time; of one second that of the last order counts."""
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("n"))
    slug = F.concat(F.lit("c"), "o_custkey")
    rows = o.select(slug.alias("slug"), F.create_map(F.lit("total"), F.col("n").cast("string")).alias("meta"), F.concat(F.lit("  Body of "), slug, F.lit("\n\n")).alias("body"), F.col("o_orderdate").alias("at"))
    return project.snapshot_rows(rows)


@query("SELECT 'c' || c_custkey AS slug, 'c' || c_custkey AS read, CAST(c_custkey AS VARCHAR) AS total FROM customer")
def snapshot_fields(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written and read back."""
    k = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("slug"), F.create_map(F.lit("total"), k).alias("meta"), F.lit("x").alias("body"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("at"))
    meta = project.snapshot_meta(F.col("content"))
    return project.snapshot_rows(rows).select("slug", meta["slug"].alias("read"), meta["total"].alias("total"))


@query("SELECT url, route, len(route) AS size FROM (SELECT url, CASE WHEN len(b) > 1 AND ends_with(b, '/') THEN substr(b, 1, len(b) - 1) ELSE b END AS route FROM (SELECT url, split_part(url, '?', 1) AS b FROM pages))")
def query_free_route(spark: SparkSession, d: str) -> DataFrame:
    route = tx.normal_route(F.col("url"))
    return table(spark, d, "pages").select("url", route.alias("route"), F.length(route).cast("long").alias("size"))


