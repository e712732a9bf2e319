"""Rules over text windows: an anchor, then a test of its neighbourhood. All rules give findings (rule, description, severity, path, line, snippet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import RADIUS_KEYS, Pattern, _by_kind, scan

FINDING = ["rule", "description", "severity", "path", "line", "snippet"]
#: What tells that code differs by platform.
PLATFORM_GATE = r"Platform\.(?:OS|select)"
IOS_GUARD = r"""Platform\.OS\s*===?\s*['"]ios['"]|Platform\.OS\s*!==?\s*['"]android['"]|Platform\.select\s*\(\s*\{"""
#: Color names that count as inline colors.
COLOR_NAMES = """
aliceblue antiquewhite aqua aquamarine azure beige bisque blanchedalmond blueviolet brown burlywood cadetblue chartreuse chocolate coral
cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkkhaki darkmagenta darkolivegreen darkorange
darkorchid darkred darksalmon darkseagreen darkslateblue darkslategray darkturquoise darkviolet deeppink deepskyblue dimgray dodgerblue
firebrick floralwhite forestgreen fuchsia gainsboro ghostwhite gold goldenrod greenyellow honeydew hotpink indianred indigo ivory khaki
lavender lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightpink
lightsalmon lightseagreen lightskyblue lightslategray lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine
mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue mediumspringgreen mediumturquoise mediumvioletred midnightblue
mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange orangered orchid palegoldenrod palegreen paleturquoise
palevioletred papayawhip peachpuff peru pink plum powderblue rebeccapurple rosybrown royalblue saddlebrown salmon sandybrown seagreen
seashell sienna silver skyblue slateblue slategray snow springgreen steelblue tan teal thistle tomato turquoise violet wheat yellowgreen
""".split()
#: Files whose own hex and rgb colors are definitions, and accessors before which a number is no literal.
TOKEN_FILES = r"(?:tokens?|theme|colors?|palette)\.(ts|tsx|js)$"
ACCESSOR = r"(?:theme|tokens?|spacing|colors?|palette)\s*[\[.]\s*\z"
_SIDE = "(?:Horizontal|Vertical|Top|Bottom|Left|Right|Start|End)?"
SPACING = rf"\b(padding{_SIDE}|margin{_SIDE}|gap|rowGap|columnGap|width|height|minWidth|maxWidth|minHeight|maxHeight|size)\s*:\s*(\d+(?:\.\d+)?)\b"
RADIUS = rf"\b({RADIUS_KEYS})\s*:\s*(\d+(?:\.\d+)?)\b"
FONT = r"\b(fontSize|lineHeight|letterSpacing)\s*:\s*(\d+(?:\.\d+)?)\b"
#: The steps of the three scales.
SPACING_SCALE = [(2, "spacing.xxs"), (4, "spacing.xs"), (8, "spacing.sm"), (12, "spacing.md"), (16, "spacing.lg"), (20, "spacing.xl"), (24, "spacing.2xl"), (32, "spacing.3xl"), (40, "spacing.4xl"), (48, "spacing.5xl")]
RADIUS_SCALE = [(2, "radii.xs"), (4, "radii.sm"), (8, "radii.md"), (12, "radii.lg"), (16, "radii.xl"), (24, "radii.2xl"), (9999, "radii.full")]
FONT_SCALE = [(10, "type.xs"), (12, "type.sm"), (14, "type.md"), (16, "type.lg"), (18, "type.xl"), (20, "type.2xl"), (24, "type.3xl"), (28, "type.4xl"), (32, "type.5xl")]


def nearest_step(value: Column, scale: list[tuple[float, str]]) -> Column:
    """The name of the nearest step of a scale, the earlier one at a tie."""
    best = F.array_min(F.array(*(F.struct(F.abs(value - F.lit(float(s))).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, (s, n) in enumerate(scale))))
    return best["name"]


def _findings(found: DataFrame, rules: dict[str, tuple[str, int, str, Column]]) -> DataFrame:
    """Findings of scanned patterns, each name told as (rule, rank, severity, description)."""
    pick = lambda k: _by_kind({name: F.lit(r[k]) if not isinstance(r[k], Column) else r[k] for name, r in rules.items()})
    return found.select(pick(0).alias("rule"), pick(3).alias("description"), pick(2).alias("severity"), "path", "line", pick(1).alias("rank"), "offset", F.col("content").alias("snippet"))


def window_rule(corpus: DataFrame, rule: str, anchor: str, lacks: str, before: int, after: int, severity: str = "warning", description: str = "", seq: int = 0) -> DataFrame:
    """A finding for the first anchor of each line whose window lacks a pattern."""
    found = scan(corpus, [Pattern(rule, anchor, (), before, after, lacks)], lines=0, first_of_line=True)
    return _findings(found, {rule: (rule, seq, severity, F.lit(description))})


def parity(corpus: DataFrame) -> DataFrame:
    """Style code that gives one platform less than the other: five rules in one scan, one finding for a rule, file and line, errors first."""
    view, behavior, word = r"<KeyboardAvoidingView\b", r"\bbehavior\s*=", F.get("groups", 0)
    patterns = [
        Pattern("color", r"\bshadowColor\s*:", (), 100, 600, r"\belevation\s*:"),
        Pattern("elevation", r"\belevation\s*:", (), 100, 600, r"\bshadowColor\s*:"),
        Pattern("same", view, (), 0, 600, PLATFORM_GATE, behavior),
        Pattern("without", view, (), 0, 600, behavior),
        Pattern("haptic", r"Haptics\.(impactAsync|notificationAsync|selectionAsync)\s*\(", (1,), 300, 300, IOS_GUARD),
        Pattern("shadow", r"\b(shadowOffset|shadowOpacity|shadowRadius)\s*:", (1,), 400, 400, PLATFORM_GATE),
    ]
    told = {
        "color": ("PP001", 1, "error", F.lit("A shadow color without elevation casts no shadow on Android.")),
        "elevation": ("PP002", 2, "warning", F.lit("Elevation without a shadow color casts no shadow on iOS.")),
        "same": ("PP003", 3, "error", F.lit("The keyboard behavior is the same on both platforms.")),
        "without": ("PP003", 3, "warning", F.lit("The keyboard-avoiding view has no behavior.")),
        "haptic": ("PP004", 4, "warning", F.concat(F.lit("Haptics."), word, F.lit("() runs without a guard for iOS."))),
        "shadow": ("PP005", 5, "warning", F.concat(word, F.lit(" does nothing on Android."))),
    }
    return first_findings(_findings(scan(corpus, patterns, lines=0, first_of_line=True), told))


def first_findings(findings: DataFrame) -> DataFrame:
    """The first finding (by rank, offset) for each rule, path and line; errors first, then path and line."""
    own = Window.partitionBy("rule", "path", "line").orderBy("rank", "offset")
    out = findings.withColumn("_k", F.row_number().over(own)).where("_k = 1").select(FINDING)
    return out.orderBy(F.col("severity") != "error", "path", "line", "rule")


def violations(corpus: DataFrame) -> DataFrame:
    """path, line, col, kind, value, nearest, context: literals where a design token should stand, from one scan."""
    number = lambda name, pattern: Pattern(name, pattern, (1, 2), 40, 0, ACCESSOR)
    patterns = [
        Pattern("hex", r"#([0-9a-fA-F]{3,8})\b"),
        Pattern("rgb", r"rgba?\(\s*\d+\s*,\s*\d+\s*,\s*\d+(?:\s*,\s*[\d.]+)?\s*\)"),
        Pattern("hsl", r"hsla?\(\s*\d+\s*,\s*[\d.]+%\s*,\s*[\d.]+%(?:\s*,\s*[\d.]+)?\s*\)"),
        Pattern("name", r"""['"]([a-z]{4,})['"]""", (1,)),
        number("magic-spacing", SPACING),
        number("magic-radius", RADIUS),
        number("magic-fontsize", FONT),
    ]
    x, kind, plain = F.get("groups", 1).cast("double"), F.col("kind"), ~F.col("path").rlike(TOKEN_FILES)
    literal = lambda comment: plain & ~F.col("content").rlike(comment)
    unsafe = lambda safe: ~x.isin([float(s) for s in safe])
    stays = {"hex": literal(r"^(//|\*)"), "rgb": literal("^//"), "hsl": literal("^//"), "name": F.get("groups", 0).isin(COLOR_NAMES), "magic-spacing": unsafe([0, 1, 2, 100]), "magic-radius": unsafe(range(7)), "magic-fontsize": unsafe(range(7))}
    steps = {"magic-spacing": nearest_step(x, SPACING_SCALE), "magic-radius": nearest_step(x, RADIUS_SCALE), "magic-fontsize": nearest_step(x, FONT_SCALE)}
    value = F.when(kind.startswith("magic-"), F.concat_ws(": ", "groups")).when(kind == "name", F.get("groups", 0)).otherwise(F.col("match"))
    found = scan(corpus, patterns, lines=80).where(_by_kind(stays))
    return found.select("path", "line", "col", F.when(kind.startswith("magic-"), kind).otherwise("inline-color").alias("kind"), value.alias("value"), _by_kind(steps).cast("string").alias("nearest"), F.col("content").alias("context"))


def violation_totals(found: DataFrame) -> DataFrame:
    """path, kind, n: violations by file, by kind, and in all (both null), from one pass."""
    return found.groupingSets([["path"], ["kind"], []], "path", "kind").agg(F.count("*").alias("n"))


def verdict(n: Column, files: Column) -> Column:
    return F.when(n == 0, "clean").when((n < 10) | (n / F.greatest(files, F.lit(1)) < 2), "moderate").otherwise("severe")
