"""Regex extraction: one row a match, with its offset, groups and position."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Patterns of literals in style code.
HEX = r"#([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})\b"
RGB = r"rgba?\(\s*\d+\s*,\s*\d+\s*,\s*\d+(?:\s*,\s*[\d.]+)?\s*\)"
RADIUS_KEYS = "borderRadius|borderTopLeftRadius|borderTopRightRadius|borderBottomLeftRadius|borderBottomRightRadius"
SIDES = "(?:Top|Bottom|Left|Right|Horizontal|Vertical)?"
SIZE_KEYS = f"width|height|padding{SIDES}|margin{SIDES}|top|bottom|left|right|fontSize|lineHeight|letterSpacing|borderWidth|{RADIUS_KEYS}|gap|rowGap|columnGap|flex(?:Basis)?|minWidth|maxWidth|minHeight|maxHeight"
DURATION_KEYS = "duration|delay|damping|stiffness|mass|velocity|overshootClamping"
NUMBER = r"\s*:\s*(\d+(?:\.\d+)?)"
#: What every key before a number holds: 3 to 23 letters up to the colon. Told first, it spares most places the tries of all keys.
BEFORE_NUMBER = r"(?=[A-Za-z]{3,23}+\s*:\s*\d)"
TOKEN_REF = r"\b(tokens?|theme|colors?|palette|t|styles?)\.([\w$]+)"
DEEP_TOKEN_REF = r"\b(tokens?|theme|colors?|palette|t)\.([A-Za-z_$][\w$]*)(?:\.[A-Za-z_$][\w$]*)*"
ANY_TOKEN_REF = r"\b(tokens?|theme|colors?|palette|t)\.(?=([A-Za-z_$][\w$]*))"
TOKEN_FILE = r"(?i)(^|[./-])(tokens|theme|themes|colors|palette|design-?system|design-?tokens)\.(tsx?|jsx?)$"
TOKEN_OR_STYLE_FILE = r"(?i)(^|[./-])(tokens|theme|themes|colors|palette|design-?system|design-?tokens|styles?)\.(tsx?|jsx?)$"
TOKEN_EXPORT = r"export\s+(?:const|default|let|var)\s+([A-Za-z_$][\w$]*)\s*[:=]"
TOKEN_NAME = r"(?i)^(tokens?|theme|themes|colors?|palette|spacing|space|radii|radius|shadows?|typography|type|fonts?|motion|elevation|darkTheme|lightTheme|dark|light)$"
ATTRIBUTE = r"""([\w-]+)\s*=\s*(?:\{([^}]+)\}|"([^"]*)"|'([^']*)')"""
#: Approaches to theming, best first, and the pattern that tells each.
THEMING = [
    ("nativewind", r"\b(?:className\s*=|nativewind|tailwind\.config|useColorScheme\(\)[\s\S]*className)"),
    ("restyle", r"@shopify/restyle|createTheme|useTheme<\s*Theme\s*>|createBox|createText"),
    ("styled-components", r"styled-components(?:/native)?|styled\.\w+`|ThemeProvider"),
    ("tamagui", r"tamagui|createTamagui|@tamagui/"),
    ("unistyles", r"react-native-unistyles|createStyleSheet|UnistylesRegistry"),
    ("context-usetheme", r"(?i)useTheme\s*\(\)|ThemeContext|createContext\([^)]*theme"),
    ("usecolorscheme", r"useColorScheme\s*\(\)"),
    ("stylesheet", r"StyleSheet\.create\s*\("),
]


class Pattern(NamedTuple):
    """A pattern to scan for. Of its matches those stay whose window (`before` code points before the match's start to `after` behind it) holds and lacks what is told."""

    name: str
    regex: str
    groups: tuple[int, ...] = ()
    before: int = 0
    after: int = 0
    lacks: str | None = None
    holds: str | None = None


_CHUNK = 512
_let = tx.let


def _starts(pieces: Column) -> Column:
    """Where each match starts: (at, newlines, since the last newline), from the pieces of text between the starts of matches.

    Running sums in blocks of the cube root of n pieces: n^(4/3) steps for n matches, where plain prefix sums would take n^2.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("newlines"), F.lit(0).alias("since"))
    size = lambda p: F.struct(F.length(p).alias("at"), (F.length(p) - F.length(F.replace(p, F.lit("\n")))).alias("newlines"), F.length(F.substring_index(p, "\n", -1)).alias("since"))

    def plus(x: Column, y: Column) -> Column:
        since = F.when(y["newlines"] > 0, y["since"]).otherwise(x["since"] + y["since"])
        return F.struct((x["at"] + y["at"]).alias("at"), (x["newlines"] + y["newlines"]).alias("newlines"), since.alias("since"))

    def upto(v: Column) -> Column:
        sums = lambda a, k, n, start: F.aggregate(F.slice(a, k, n), start, plus)
        blocks = F.transform(F.sequence(F.lit(0), (F.size(v["sizes"]) - 1).cast("int"), v["block"]), lambda k: sums(v["sizes"], k + 1, v["block"], zero))
        whole = lambda b: F.transform(b, lambda _, k: sums(b, F.lit(1), k, zero))
        within = lambda w: F.transform(v["sizes"], lambda _, i: _let((i - i % v["block"]).cast("int"), lambda k: sums(v["sizes"], k + 1, i - k + 1, F.get(w, F.floor(k / v["block"]).cast("int")))))
        return _let(blocks, lambda b: _let(whole(b), within))

    block = F.greatest(F.lit(4), F.ceil(F.cbrt(F.size(pieces))).cast("int"))
    return _let(F.struct(F.transform(pieces, size).alias("sizes"), block.alias("block")), upto)


def _matches(text: Column, chunks: Column, p: Pattern, first_of_line: bool) -> Column:
    """The matches of a pattern in order: kind, seq, offset, line, col, match, groups. Each text is read a fixed number of times, however many matches it has."""
    every = lambda g: F.regexp_extract_all(text, F.lit(p.regex), F.lit(g))
    base = lambda hits: F.struct(F.split(text, p.regex, -1).alias("seg"), hits.alias("hits"), *(every(g).alias(f"g{g}") for g in p.groups))

    def near(at: Column) -> Column:
        start = F.greatest(at - p.before, F.lit(0))
        own = F.array_join(F.slice(chunks, F.floor(start / _CHUNK).cast("int") + 1, (p.before + p.after) // _CHUNK + 2), "")
        return F.substring(own, (start % _CHUNK + 1).cast("int"), (at + p.after - start).cast("int"))

    def stays(hit: Column) -> Column:
        def told(window: Column) -> Column:
            return (F.lit(True) if p.holds is None else window.rlike(p.holds)) & (F.lit(True) if p.lacks is None else ~window.rlike(p.lacks))

        return _let(near(hit["offset"]), told)

    def rows(v: Column) -> Column:
        def row(starts: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                s = F.get(starts, i)
                groups = F.array(*(F.get(v[f"g{g}"], i) for g in p.groups)) if p.groups else F.array().cast("array<string>")
                return F.struct(F.lit(p.name).alias("kind"), i.alias("seq"), s["at"].alias("offset"), (s["newlines"] + 1).alias("line"), (s["since"] + 1).alias("col"), hit.alias("match"), groups.alias("groups"))

            return F.transform(v["hits"], one)

        pieces = F.transform(F.slice(v["seg"], F.lit(1), F.size(v["hits"])), lambda s, i: F.concat(F.coalesce(F.get(v["hits"], i - 1), F.lit("")), s))
        found = _let(_starts(pieces), row)
        return found if p.lacks is None and p.holds is None else F.filter(found, stays)

    none = F.array().cast("array<struct<kind:string,seq:int,offset:int,line:int,col:int,match:string,groups:array<string>>>")
    found = _let(every(0), lambda hits: F.when(F.size(hits) > 0, _let(base(hits), rows)).otherwise(none))
    if first_of_line:
        found = _let(found, lambda all_: F.filter(all_, lambda h, i: (i == 0) | (h["line"] != F.get(all_, i - 1)["line"])))
    return found


def scan(corpus: DataFrame, patterns: list[Pattern], lines: int | None = None, first_of_line: bool = False) -> DataFrame:
    """path, kind (the pattern's name), seq, offset, line, col, match, groups (in the pattern's order) of every match of all patterns, in one reading of the corpus.

    With `lines`, also content: the trimmed text of the match's line, its first `lines` code points (0: all). `first_of_line` keeps of the
    matches of one pattern in one line the first. Stays in the JVM and shuffles nothing; null texts give no row; an inner group that took
    no part is the empty string. Texts are not copied to their matches.
    """
    text = F.col("text")
    windows = any(p.lacks is not None or p.holds is not None for p in patterns)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)) if windows else F.array().cast("array<string>")
    hits = _let(cut, lambda chunks: F.concat(*(_matches(text, chunks, p, first_of_line) for p in patterns)))
    if lines is not None:
        short = (lambda s: F.substring(s, 1, lines)) if lines else (lambda s: s)
        told = F.transform(F.split("text", "\n", -1), lambda s: short(tx.trimmed(s)))
        hits = _let(F.struct(hits.alias("hits"), told.alias("told")), lambda v: F.transform(v["hits"], lambda h: h.withField("content", F.element_at(v["told"], h["line"]))))
    some = F.lit(False)
    for p in patterns:
        some = some | F.col("text").rlike(p.regex)
    return corpus.where(some).select("path", "text", F.explode(hits).alias("hit")).select("path", "text", "hit.*")


def occurrences(corpus: DataFrame, pattern: str, groups: dict[str, int] | None = None) -> DataFrame:
    """path, text, seq, offset, line, col, match and the named groups of every match of pattern, in order of place; text is read only where the caller uses it."""
    groups = groups or {}
    found = scan(corpus, [Pattern("", pattern, tuple(groups.values()))])
    return found.select("path", "text", "seq", "offset", "line", "col", "match", *(F.get("groups", k).alias(n) for k, n in enumerate(groups)))


def located(found: DataFrame) -> DataFrame:
    """With the snippet and 80-character context of each match."""
    return found.withColumn("snippet", tx.snippet(F.col("text"), F.col("line"))).withColumn("context", F.substring("snippet", 1, 80))


def _by_kind(cases: dict[str, Column]) -> Column:
    out = F.lit(None)
    for kind, value in cases.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def literals(corpus: DataFrame) -> DataFrame:
    """path, kind, value, line of colors, radii, sizes and durations, from one scan. A number taken as a radius is not a size."""
    number = lambda name, keys: Pattern(name, f"{BEFORE_NUMBER}(?:{keys}){NUMBER}", (1,))
    found = scan(corpus, [Pattern("hex", HEX), Pattern("rgb", RGB), number("radius", RADIUS_KEYS), number("size", SIZE_KEYS), number("duration", DURATION_KEYS)])
    color, n = F.col("kind").isin("hex", "rgb"), F.get("groups", 0).cast("double")
    found = found.where(color | (n > F.when(F.col("kind") == "size", 1.0).otherwise(0.0))).where((F.col("kind") != "size") | ~F.col("match").rlike(f"^(?:{RADIUS_KEYS})\\b"))
    value = F.when(color, F.lower(F.regexp_replace("match", r"\s+", ""))).otherwise(n.cast("string"))
    return found.select("path", F.when(color, "color").otherwise(F.col("kind")).alias("kind"), value.alias("value"), "line")


def style_facts(corpus: DataFrame) -> DataFrame:
    """kind (color, fontSize, spacing, radius, fontFamily), value, path: the raw usages of a style inventory, from one scan, and one of the names of colors. Numbers are canonical strings."""
    from ..functions import color as co

    side = "(?:Horizontal|Vertical|Top|Bottom|Left|Right|Start|End)?"
    g = lambda k: F.get("groups", k)
    found = scan(
        corpus,
        [
            Pattern("hex", r"#([0-9a-fA-F]{3,8})\b", (1,)),
            Pattern("rgb", r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)(?:\s*,\s*[\d.]+)?\s*\)", (1, 2, 3)),
            Pattern("fontSize", r"\bfontSize" + NUMBER, (1,)),
            Pattern("spacing", rf"\b(padding{side}|margin{side}|gap|rowGap|columnGap)" + NUMBER, (2,)),
            Pattern("radius", rf"\b({RADIUS_KEYS})" + NUMBER, (2,)),
            Pattern("fontFamily", r"""\bfontFamily\s*:\s*['"]([^'"]+)['"]""", (1,)),
        ],
    )
    number = g(0).cast("double").cast("string")
    values = {"hex": F.concat(F.lit("#"), co.expand_hex(g(0))), "rgb": co.rgb_hex(g(0), g(1), g(2)), "fontSize": number, "spacing": number, "radius": number, "fontFamily": g(0)}
    facts = found.select(F.when(F.col("kind").isin("hex", "rgb"), "color").otherwise(F.col("kind")).alias("kind"), _by_kind(values).alias("value"), "path").where("kind <> 'color' or value is not null")
    names = F.explode(F.array(*(F.when(F.col("text").rlike(f"['\"]{n}['\"]"), F.lit(h)) for n, h in co.BASIC_NAMES.items())))  # one usage a file and name
    return facts.unionByName(corpus.select(F.lit("color").alias("kind"), names.alias("value"), "path").where("value is not null"))


def token_refs(corpus: DataFrame, pattern: str = TOKEN_REF) -> DataFrame:
    """path, token (root.first), n."""
    found = occurrences(corpus, pattern, {"root": 1, "first": 2})
    return found.groupBy("path", F.concat_ws(".", "root", "first").alias("token")).agg(F.count("*").alias("n"))


def deep_tokens(corpus: DataFrame) -> DataFrame:
    """token (root.first): the distinct tokens that files refer to, deeper parts cut off."""
    found = occurrences(corpus, DEEP_TOKEN_REF, {"root": 1, "first": 2})
    return found.select(F.concat_ws(".", "root", "first").alias("token")).distinct()


def lines(corpus: DataFrame) -> DataFrame:
    """path, line (from 1), content of every line."""
    return corpus.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), "content")


def token_definitions(corpus: DataFrame, look_back: int = 20) -> DataFrame:
    """token (object.key), defined_in (path:line), value: string properties in token files; the object is the nearest declaration in the lines before, else tokens."""
    own = lines(corpus.where(F.regexp_extract("path", r"([^/]+)$", 1).rlike(TOKEN_FILE)))
    declared = F.nullif(F.regexp_extract("content", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[=:]", 1), F.lit(""))
    near = Window.partitionBy("path").orderBy("line").rowsBetween(-look_back, -1)
    prop = r"""^\s{2,}(\w+)\s*:\s*['"]([^'"]+)['"]"""
    named = own.withColumn("owner", F.last(declared, ignorenulls=True).over(near)).withColumn("key", F.regexp_extract("content", prop, 1)).where("key <> ''")
    rows = named.select(F.concat_ws(".", F.coalesce("owner", F.lit("tokens")), "key").alias("token"), F.concat_ws(":", "path", "line").alias("defined_in"), F.regexp_extract("content", prop, 2).alias("value"), "path", "line")
    return rows.groupBy("token").agg(F.max_by(F.struct("defined_in", "value"), F.struct("path", "line")).alias("d")).select("token", "d.defined_in", "d.value")


def token_modules(corpus: DataFrame) -> DataFrame:
    """path, kind (token-module, token-export), exports (in order), line of the first."""
    by_file = F.regexp_extract("path", r"([^/]+)$", 1).rlike(TOKEN_OR_STYLE_FILE)
    found = occurrences(corpus, TOKEN_EXPORT, {"name": 1}).withColumn("by_file", by_file).where(F.col("by_file") | F.col("name").rlike(TOKEN_NAME))
    out = found.groupBy("path").agg(F.when(F.any_value("by_file"), "token-module").otherwise("token-export").alias("kind"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("exports"), F.min("line").alias("line"))
    return out.orderBy(F.col("kind") != "token-module", F.size("exports").desc(), "path")


def theming_signals(corpus: DataFrame, signals: list[tuple[str, str]] | None = None) -> DataFrame:
    """path, approach, rank, line of the first match of each signal in each file."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("approach"), F.lit(k).alias("rank"), F.when(F.col("text").rlike(p), F.length(F.element_at(F.split("text", p, 2), 1))).alias("offset")) for k, (a, p) in enumerate(signals or THEMING))))
    found = corpus.select("path", "text", each.alias("s")).where("s.offset is not null")
    return found.select("path", "s.approach", "s.rank", tx.line_of(F.col("text"), F.col("s.offset")).alias("line"))


def imports(corpus: DataFrame) -> DataFrame:
    """path, spec, type_only of every import, re-export and require of a relative or bare module."""
    pattern = r"""(?:import|export)\s+(type\s+)?(?:[\w*${}\s,]+\s+from\s+)?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)"""
    found = occurrences(corpus, pattern, {"kind": 1, "a": 2, "b": 3})
    return found.select("path", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("spec"), (F.col("kind") != "").alias("type_only"))


def attributes(found: DataFrame, column: str = "match") -> DataFrame:
    """With attrs, a map of the attributes in a tag: the first value of a name counts."""
    part = lambda g: F.regexp_extract_all(column, F.lit(ATTRIBUTE), F.lit(g))
    pairs = F.arrays_zip(part(1).alias("k"), part(2).alias("x"), part(3).alias("y"), part(4).alias("z"))
    value = lambda p: F.when(p["x"] != "", p["x"]).when(p["y"] != "", p["y"]).otherwise(p["z"])
    items = F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), value(p).alias("value")))
    first = F.aggregate(items, F.array().cast("array<struct<key:string,value:string>>"), lambda out, x: F.when(F.exists(out, lambda o: o["key"] == x["key"]), out).otherwise(F.concat(out, F.array(x))))
    return found.withColumn("attrs", F.map_from_entries(first))


def tags(corpus: DataFrame) -> DataFrame:
    """path, pos, tag of every opening tag, in order."""
    return corpus.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("pos", "tag"))
