"""Design documents and skill files: front matter, sections, rules, colors, and their way back to text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .extract import lines
from .sequence import bullets, carried

#: The sections of a design document.
SECTIONS = ["Overview", "Colors", "Typography", "Elevation", "Components", "Do's and Don'ts"]


def scalar(raw: str) -> Any:
    """A YAML scalar: quoted text, true, false, null, whole and decimal numbers, else text."""
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    known = {"true": True, "false": False, "null": None, "~": None, "": None}
    if raw in known:
        return known[raw]
    if re.fullmatch(r"-?\d+", raw):
        return int(raw)
    return float(raw) if re.fullmatch(r"-?\d+\.\d+", raw) else raw


def _pair(line: str) -> tuple[str, str] | None:
    """Key and rest of a line, cut at the first colon outside quotes that a blank or the end follows."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ":" and line[k + 1 : k + 2] in ("", " ", "\t"):
            return line[:k].strip().strip("\"'"), line[k + 1 :].strip()
    return None


def _bare(line: str) -> str:
    """A line without its comment: a # outside quotes, at the start or behind a blank."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (not line[:k].strip() or (line[k - 1].isspace() and line[k + 1 : k + 2] in ("", " "))):
            return line[:k].rstrip()
    return line.rstrip()


def parse_yaml(text: str) -> Any:
    """Nested maps, lists of scalars and of maps, by indentation: the subset that front matter uses."""
    rows = [(len(b) - len(b.lstrip()), b.strip()) for b in map(_bare, text.splitlines()) if b.strip()]
    at = 0

    def block(indent: int) -> Any:
        nonlocal at
        out: Any = None
        while at < len(rows) and rows[at][0] >= indent:
            depth, line = rows[at]
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                item = line[1:].strip()
                pair = _pair(item) if item else None
                if pair and isinstance(out, list):
                    rows[at] = (depth + 2, item)
                    out.append(block(depth + 2))
                else:
                    at += 1
                    out.append(scalar(item) if item else block(depth + 1))
                continue
            pair = _pair(line)
            if not pair:
                raise ValueError(f"neither a pair nor an item: {line!r}")
            out = {} if out is None else out
            if isinstance(out, list):
                break
            at += 1
            deeper = at < len(rows) and (rows[at][0] > depth or (rows[at][0] == depth and rows[at][1].startswith("- ")))
            out[pair[0]] = block(rows[at][0]) if not pair[1] and deeper else scalar(pair[1])
            if at < len(rows) and rows[at][0] < depth:
                break
        return out

    return block(0) or {}


def split_front(text: str) -> tuple[dict | None, str]:
    """Front matter and body; no front matter where it does not begin, end or parse."""
    rows = re.split(r"\r?\n", text)
    ends = [k for k, x in enumerate(rows[1:], 1) if x.strip() == "---"]
    if rows[0].strip() != "---" or not ends:
        return None, text
    try:
        return parse_yaml("\n".join(rows[1 : ends[0]])), "\n".join(rows[ends[0] + 1 :])
    except ValueError:
        return None, text


def front_matter(docs: DataFrame) -> DataFrame:
    """path, front (variant, null without front matter), body. Parsing needs a stack, so it runs in an Arrow function that gives JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [split_front(x or "") for x in batch.column("text").to_pylist()]
            front = pa.array([None if f is None else json.dumps(f) for f, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), front, pa.array([b for _, b in got], pa.string())], ["path", "front", "body"])

    return docs.select("path", "text").mapInArrow(run, "path string, front string, body string").withColumn("front", F.parse_json("front"))


def canonical(name):
    """The section that a heading means: its own name, or the first section whose name stands in it as words; null for others."""
    plain = F.lower(tx.straight_quotes(name))
    exact = [F.when(plain == s.lower(), F.lit(s)) for s in SECTIONS]
    within = [F.when(plain.rlike(rf"\b\Q{s.lower()}\E\b"), F.lit(s)) for s in SECTIONS]
    return F.coalesce(*exact, *within)


def section_lines(docs: DataFrame) -> DataFrame:
    """path, line, content, section: lines under a level-2 heading of a section; other level-2 headings end it."""
    rows = lines(docs)
    head = F.regexp_extract("content", r"^##\s+(.+?)\s*$", 1)
    name = F.regexp_replace(tx.strip_bold(head), r"^\d+\.\s*", "")
    return carried(rows, "path", "line", head != "", canonical(name)).where("section is not null").where(~F.col("content").rlike(r"^##\s"))


def named_rules(docs: DataFrame) -> DataFrame:
    """path, name, body of rules in three writings: bold sentence, level-3 heading, bold bullet; one of a name (in any case) counts, in that order."""
    bold = docs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"\*\*(The [^*]+?Rule)\.\*\*((?:(?!\*\*The [^*]+?Rule\.\*\*)(?!\n##)[\s\S])*)"), F.lit(1))).alias("k", "name"), "text")
    body = F.element_at(F.regexp_extract_all("text", F.lit(r"\*\*(The [^*]+?Rule)\.\*\*((?:(?!\*\*The [^*]+?Rule\.\*\*)(?!\n##)[\s\S])*)"), F.lit(2)), F.col("k") + 1)
    one = bold.select("path", F.lit(0).alias("style"), "k", "name", tx.trimmed(tx.strip_bold(body)).alias("body"))
    clean = lambda c: F.trim(F.regexp_replace(tx.strip_bold(c), "[\"“”]", ""))
    heads = docs.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^###\s+(.+?)\s*$((?:\n(?!##)[^\n]*)*)"), F.lit(0))).alias("k", "x"))
    two = heads.select("path", F.lit(1).alias("style"), "k", clean(F.regexp_extract("x", r"^###\s+([^\n]+)", 1)).alias("name"), F.trim(tx.strip_bold(F.regexp_replace(F.regexp_replace("x", r"^[^\n]*\n?", ""), r"\n+", " "))).alias("body"))
    two = two.where(F.col("name").rlike(r"(?i)^The\b.*\b(Rule|Fallback|Principle)\b") & (F.col("body") != ""))
    items = bullets(lines(docs)).withColumn("head", F.regexp_extract("text", r"^\*\*([^*]+?)\*\*\s*(.+)$", 1))
    three = items.where("head <> ''").select("path", F.lit(2).alias("style"), F.col("first_line").alias("k"), F.regexp_replace(clean(F.col("head")), r"[.:]\s*$", "").alias("name"), F.trim(tx.strip_bold(F.regexp_extract("text", r"^\*\*([^*]+?)\*\*\s*(.+)$", 2))).alias("body"))
    three = three.where(F.col("name").rlike(r"(?i)^The\b.+\b(Rule|Fallback|Principle)$"))
    every = one.unionByName(two).unionByName(three)
    return every.groupBy("path", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "body"), F.struct("style", "k")).alias("r")).select("path", "r.name", "r.body")


def coverage(docs: DataFrame) -> DataFrame:
    """path, section, present, bullets: which sections each document has, and how many bullets they hold."""
    present = section_lines(docs).groupBy("path", "section").agg(F.count_if(F.col("content").rlike(r"^\s*[-*+]\s+")).alias("bullets"))
    every = docs.select("path", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    return every.join(present, ["path", "section"], "left").select("path", "section", F.col("bullets").isNotNull().alias("present"), F.coalesce("bullets", F.lit(0)).alias("bullets"))


def compiled(skills: DataFrame, providers: DataFrame, known: list[str]) -> DataFrame:
    """provider, name, title, description, body of each skill (name, description, body) for each provider (provider, tag, values map): blocks and placeholders settled.

    The few providers multiply the skills; a provider's blocks are one fixed expression each.
    """
    out = None
    for p in providers.collect():  # configuration: a row for each provider
        body = tx.placeholders(tx.provider_blocks(F.col("body"), [p.tag], known), p["values"] or {})
        one = skills.select(F.lit(p.provider).alias("provider"), "name", tx.humanized(F.col("name")).alias("title"), tx.clip(F.col("description")).alias("description"), body.alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


def provider_files(made: DataFrame) -> DataFrame:
    """provider, name, path, text of the skill file of each row of compiled(): front matter, then the body."""
    front = F.concat(F.lit("---\nname: "), tx.yaml_scalar(F.col("name")), F.lit("\ndescription: "), tx.yaml_scalar(F.coalesce("description", F.lit(""))), F.lit("\n---\n\n"))
    return made.select("provider", "name", F.concat(F.lit("."), "provider", F.lit("/skills/"), "name", F.lit("/SKILL.md")).alias("path"), F.concat(front, F.coalesce("body", F.lit(""))).alias("text"))


def write_tree(files: DataFrame, folder: str) -> None:
    """The files as a tree: a folder for each provider, in it one for each skill with the text in one file. Rows of a folder must be one; a folder written before is replaced."""
    files.select("provider", "name", "text").write.partitionBy("provider", "name").option("lineSep", "\n").mode("overwrite").text(folder)


def subsections(docs: DataFrame) -> DataFrame:
    """section_lines() with sub, the level-3 heading above each line (null before the first)."""
    rows = section_lines(docs)
    head = F.nullif(tx.strip_bold(F.regexp_extract("content", r"^###\s+(.+?)\s*$", 1)), F.lit(""))
    w = Window.partitionBy("path", "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sub", F.last(head, ignorenulls=True).over(w)).where(head.isNull())


def items(docs: DataFrame) -> DataFrame:
    """path, section, sub, line, text of every bullet in a section, with the lines that continue it."""
    rows = subsections(docs).withColumn("place", F.to_json(F.struct("path", "section", "sub")))
    found = bullets(rows, "place")
    where = F.from_json("place", "path string, section string, sub string")
    return found.select(where.path.alias("path"), where.section.alias("section"), where.sub.alias("sub"), F.col("first_line").alias("line"), "text")


#: How colors are written, the words that name a role, the headings in Colors that hold no colors.
HEX, OKLCH = r"#[0-9a-fA-F]{3,8}\b", r"oklch\([^)]*\)"
ROLE = r"(?i)^(primary|secondary|tertiary|neutral|accent)\b"
NO_COLORS = r"(?i)Named Rules?|^The\s"
#: A bold name with its value in parentheses (which may hold others) behind it, or with its value within the bold.
_BEHIND = r"^(?>\*\*(.+?)\*\*)\s*\(([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+)\)\s*:\s*(.*)$"
_WITHIN = r"^\*\*([^*]+?)\s*\(([^)]+)\):\*\*\s*(.*)$"


def _color(text: Column) -> Column:
    """name, value, value_range (null for one value), format, description of a bullet; null for one without a color."""
    values = lambda c: F.concat(F.regexp_extract_all(c, F.lit(HEX), F.lit(0)), F.regexp_extract_all(c, F.lit(OKLCH), F.lit(0)))
    text = F.trim(text)
    part = lambda k: F.when(text.rlike(_BEHIND), F.regexp_extract(text, _BEHIND, k)).when(text.rlike(_WITHIN), F.regexp_extract(text, _WITHIN, k))
    raw = F.coalesce(part(2), F.when(F.size(values(text)) > 0, text))
    found = values(raw)
    value = F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.trim(raw))
    clean = lambda c: F.nullif(F.trim(tx.strip_bold(c)), F.lit(""))
    kind = F.when(value.startswith("#"), "hex").when(value.rlike("(?i)^oklch"), "oklch").when(value.rlike("(?i)^rgb"), "rgb").otherwise("unknown")
    color = F.struct(clean(part(1)).alias("name"), value.alias("value"), F.when(F.size(found) > 1, found).alias("value_range"), kind.alias("format"), clean(F.coalesce(part(3), text)).alias("description"))
    return F.when(raw.isNotNull(), color)


def colors(docs: DataFrame) -> DataFrame:
    """path, line, name, value, value_range, format (hex, oklch, rgb, unknown), description of color bullets in the Colors section."""
    own = bullets(section_lines(docs).where("section = 'Colors'"))
    return own.select("path", F.col("first_line").alias("line"), _color(F.col("text")).alias("c")).where("c is not null").select("path", "line", "c.*")


def color_groups(docs: DataFrame) -> DataFrame:
    """path, role, line (of the first color), colors (in their order) of the Colors section.

    A level-3 heading is a group; if all its colors are named by roles, each is a group of its own. Headings of rules hold none. Where no heading
    holds colors, those named by roles are groups and the others make up 'Palette'.
    """
    own = items(docs).where("section = 'Colors'").withColumn("c", _color(F.col("text"))).where("c is not null")
    headed = F.col("sub").isNotNull() & ~F.col("sub").rlike(NO_COLORS)
    role = F.coalesce(F.col("c.name").rlike(ROLE), F.lit(False))
    own = own.select("path", "sub", "line", "c", headed.alias("headed"), role.alias("role"))
    own = own.withColumn("grouped", F.max("headed").over(Window.partitionBy("path"))).where("headed or not grouped")
    alone = F.when(F.col("grouped"), F.min("role").over(Window.partitionBy("path", "sub"))).otherwise(F.col("role"))
    own = own.withColumn("alone", alone)
    name = F.when(F.col("alone"), F.col("c.name")).when(F.col("grouped"), F.col("sub")).otherwise("Palette")
    made = own.groupBy("path", name.alias("role"), F.when(F.col("alone"), F.col("line")).alias("own")).agg(F.array_sort(F.collect_list(F.struct("line", "c"))).alias("x"))
    return made.select("path", "role", F.get("x", F.lit(0)).line.alias("line"), F.transform("x", lambda x: x["c"]).alias("colors"))


def subtitles(docs: DataFrame) -> DataFrame:
    """path, section, subtitle: what follows the colon in the first level-2 heading of each section."""
    head = F.regexp_replace(tx.strip_bold(F.regexp_extract("content", r"^##\s+(.+?)\s*$", 1)), r"^\d+\.\s*", "")
    rows = lines(docs).select("path", "line", head.alias("head")).where("head <> ''").withColumn("section", canonical(F.regexp_extract("head", r"^[^:]*", 0)))
    first = rows.where("section is not null").groupBy("path", "section").agg(F.min_by("head", "line").alias("head"))
    return first.select("path", "section", F.nullif(F.trim(F.regexp_extract("head", r"^[^:]*:(.*)$", 1)), F.lit("")).alias("subtitle"))


def overview(docs: DataFrame) -> DataFrame:
    """path, subtitle, north_star, philosophy (paragraphs), characteristics (bullets below their mark) of each document with an Overview."""
    own = section_lines(docs).where("section = 'Overview'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("x"))
    own = own.select("path", F.transform("x", lambda x: x["content"]).alias("rows")).withColumn("text", F.array_join("rows", "\n"))
    ends = lambda r: (F.trim(r) == "") | F.trim(r).rlike(r"^(-{3,}|\*{3,}|_{3,})$") | r.rlike(r"^#|^[-*]\s")
    paragraphs = F.split(F.array_join(F.transform("rows", lambda r: F.when(ends(r), F.lit("\x01")).otherwise(F.trim(r))), " "), "\x01")
    paragraphs = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^\*\*(Creative North Star|Key Characteristics)"))
    marked = F.regexp_extract("text", r"\*\*Key Characteristics:\*\*\s*\n([\s\S]+?)(?:\n##|\z)", 1)
    traits = F.filter(F.split(marked, "\n"), lambda r: r.rlike(r"^\s*[-*]\s+\S"))
    traits = F.transform(traits, lambda r: tx.strip_bold(F.trim(F.regexp_replace(r, r"^\s*[-*]\s+", ""))))
    star = F.nullif(F.regexp_extract("text", r'\*\*Creative North Star:\s*"([^"]+)"\*\*', 1), F.lit(""))
    named = subtitles(docs).where("section = 'Overview'").select("path", "subtitle")
    return own.join(named, "path", "left").select("path", "subtitle", star.alias("north_star"), paragraphs.alias("philosophy"), traits.alias("characteristics"))


#: The words that make a component's bullet a variant, not a property.
VARIANT = r"(?i)^(primary|secondary|tertiary|ghost|hover|focus|active|disabled|default|error|selected|unselected|state)\b"


def components(docs: DataFrame) -> DataFrame:
    """path, component, key, value, is_variant of the bold-keyed bullets under each component's heading."""
    own = items(docs).where("section = 'Components' and sub is not null")
    pattern = r"^\*\*(.+?):?\*\*:?\s*(.+)$"
    key = F.trim(tx.strip_bold(F.regexp_extract("text", pattern, 1)))
    rows = own.withColumn("key", key).where("key <> ''")
    variant = F.col("key").rlike(VARIANT)
    return rows.select("path", F.col("sub").alias("component"), F.when(variant, F.col("key")).otherwise(F.lower("key")).alias("key"), F.trim(tx.strip_bold(F.regexp_extract("text", pattern, 2))).alias("value"), variant.alias("is_variant"))


def advice(docs: DataFrame) -> DataFrame:
    """path, kind (do, dont), text of the bullets in Do's and Don'ts, by the heading above them or their first word; each text once."""
    own = items(docs).where(F.col("section") == SECTIONS[-1]).withColumn("text", F.trim(tx.strip_bold(F.col("text"))))
    plain, head = tx.straight_quotes(F.col("text")), F.coalesce(tx.straight_quotes(F.col("sub")), F.lit(""))
    kind = F.when(head.rlike(r"(?i)^don'?ts?:?$") | plain.rlike(r"(?i)^don'?t\b"), "dont").when(head.rlike(r"(?i)^do'?s?:?$") | plain.rlike(r"(?i)^do\b"), "do")
    return own.select("path", kind.alias("kind"), plain.alias("text")).where("kind is not null").distinct()


def fonts(docs: DataFrame) -> DataFrame:
    """path, role, family, fallback of the fonts that the Typography section names; headline counts as display, ui as body."""
    own = subsections(docs).where("section = 'Typography'").select("path", F.col("content").alias("text"))
    found = own.select("path", F.regexp_extract("text", r"\*\*([\w\s/]+?)Font:\*\*\s*([^\n(]+?)(?:\s*\(with\s+([^)]+)\))?\s*$", 0).alias("m"), *(F.trim(F.regexp_extract("text", r"\*\*([\w\s/]+?)Font:\*\*\s*([^\n(]+?)(?:\s*\(with\s+([^)]+)\))?\s*$", k)).alias(n) for k, n in ((1, "role"), (2, "family"), (3, "fallback"))))
    words = F.split(F.lower("role"), r"[-/&\s]+")
    role = F.coalesce(*(F.when(F.array_contains(words, w), F.lit(r)) for w, r in (("display", "display"), ("headline", "display"), ("body", "body"), ("ui", "body"), ("label", "label"), ("mono", "mono"))), F.lit("display"))
    return found.where("m <> ''").select("path", role.alias("role"), "family", F.nullif("fallback", F.lit("")).alias("fallback"))


def type_scale(docs: DataFrame) -> DataFrame:
    """path, name, specs, purpose of the bullets under a hierarchy heading in Typography."""
    own = items(docs).where((F.col("section") == "Typography") & F.col("sub").rlike("(?i)hierarch"))
    part = lambda k: F.trim(F.regexp_extract("text", r"^\*\*(.+?)\*\*\s*\(([^)]+)\):\s*(.*)$", k))
    return own.where(part(1) != "").select("path", part(1).alias("name"), F.split(part(2), r"\s*,\s*").alias("specs"), F.nullif(tx.strip_bold(part(3)), F.lit("")).alias("purpose"))


def shadows(docs: DataFrame) -> DataFrame:
    """path, name, value of the shadows in Elevation: bold-named bullets and box-shadow declarations in any line; each once."""
    own = items(docs).where("section = 'Elevation'")
    part = lambda k: F.trim(F.regexp_extract("text", r"^\*\*(.+?)\*\*\s*\(`?([^`]+?)`?\):\s*(.*)$", k))
    value = F.trim(F.regexp_replace(part(2), r"(?i)^box-shadow:\s*", ""))
    named = own.select("path", tx.strip_bold(part(1)).alias("name"), value.alias("value")).where(F.col("value").rlike(r"(?i)box-shadow|rgba?\(|\bpx\b|\brem\b|px|^-?\d+\s") & F.col("value").rlike(r"\d"))
    inline = subsections(docs).where("section = 'Elevation'").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)box-shadow\s*:\s*([^`;\n]+)"), F.lit(1))).alias("value"))
    inline = inline.select("path", F.lit(None).cast("string").alias("name"), F.trim(F.when(F.col("value").contains("("), F.regexp_replace("value", r"[`.]+$", "")).otherwise(F.regexp_replace("value", r"[`.)]+$", ""))).alias("value")).where("value <> ''")
    inline = inline.join(named.select("path", "value"), ["path", "value"], "left_anti").select("path", "name", "value")
    return named.unionByName(inline).distinct()


def _plain(value: Any) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if not isinstance(value, str):
        return str(value)
    risky = value == "" or re.search(r"^\s|\s\Z|^[\[\]{},&*!|>'\"%@`#]|^[?:-](\s|\Z)|: |\s#|:\Z", value) or re.fullmatch(r"(?i)true|false|null|yes|no|on|off|~|-?\d+(\.\d+)?(e[+-]?\d+)?", value)
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if risky else value


def write_yaml(value: Any, depth: int = 0) -> str:
    """What parse_yaml reads: maps, lists of scalars and of maps, scalars quoted where they would read as something else."""
    pad, out = "  " * depth, []
    if isinstance(value, dict):
        for k, v in value.items():
            nested = isinstance(v, dict | list) and v
            out.append(f"{pad}{k}:\n{write_yaml(v, depth + 1)}" if nested else f"{pad}{k}: {'null' if isinstance(v, dict | list) else _plain(v)}")
    else:
        for v in value:
            body = write_yaml(v, depth + 1) if isinstance(v, dict) else _plain(v)
            out.append(f"{pad}- {body.lstrip()}")
    return "\n".join(out)
