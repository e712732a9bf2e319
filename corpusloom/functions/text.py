"""Positions in texts, names, routes and versions, as Column expressions. Offsets count code points from 0, lines and columns from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix(text: Column, offset: Column) -> Column:
    return F.substring(text, F.lit(1), offset.cast("int"))


def line_of(text: Column, offset: Column) -> Column:
    """The line of an offset."""
    p = prefix(text, offset)
    return F.length(p) - F.length(F.replace(p, F.lit("\n"))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """The column of an offset: its distance from the newline before it."""
    return offset.cast("int") + 1 - (F.length(prefix(text, offset)) - F.length(F.substring_index(prefix(text, offset), "\n", -1)))


def line_text(text: Column, line: Column) -> Column:
    return F.element_at(F.split(text, "\n", -1), line.cast("int"))


def snippet(text: Column, line: Column) -> Column:
    return trimmed(line_text(text, line))


def context(text: Column, line: Column, width: int = 80) -> Column:
    return F.substring(snippet(text, line), 1, width)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def window(text: Column, offset: Column, before: int, after: int) -> Column:
    """The text from `before` code points before an offset to `after` behind it."""
    start = F.greatest(offset.cast("int") - before, F.lit(0))
    return F.substring(text, start + 1, offset.cast("int") + after - start)


def kebab(text: Column, keep: int = 50) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends; the last `keep` characters."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(whole) > keep, F.regexp_replace(F.right(whole, F.lit(keep)), "^-+", "")).otherwise(whole)


def slug(target: Column, root: str = "/") -> Column:
    """A name for a URL (host and path) or a path (relative to root; its last part if outside); null where neither can be read."""
    url = F.concat_ws("", F.try_parse_url(target, F.lit("HOST")), F.try_parse_url(target, F.lit("PATH")))
    root = root.rstrip("/") + "/"
    path = F.when(target.startswith(root), F.substring(target, len(root) + 1, 1 << 20)).when(target.startswith("/"), F.substring_index(target, "/", -1)).otherwise(F.regexp_replace(target, r"^\./", ""))
    name = kebab(F.when(target.rlike("^https?://"), F.when(F.try_parse_url(target, F.lit("HOST")).isNotNull(), url)).otherwise(path))
    return F.when(name != "", name)


def file_stamp(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def normal_route(route: Column) -> Column:
    """Without the query and without one slash at the end, but for the root."""
    bare = F.substring_index(route, "?", 1)
    return F.when((F.length(bare) > 1) & bare.endswith("/"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def file_segments(path: Column) -> Column:
    """The segments of a routed file under app/ or src/app/, the file's own without its extension."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"^(src/)?app/", ""), r"\.(tsx?|jsx?)$", ""), "/")


def file_route(path: Column) -> Column:
    """The route of a file: groups in parentheses drop out, index is its folder."""
    named = F.filter(file_segments(path), lambda s: ~s.rlike(r"^\(.+\)$"))
    last = F.element_at(named, -1)
    named = F.when(last == "index", F.slice(named, F.lit(1), F.size(named) - 1)).otherwise(named)
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def route_params(path: Column) -> Column:
    """Parameters of a file's route: their names, and whether they catch all that follows."""
    found = F.filter(file_segments(path), lambda s: s.rlike(r"^\[.+\]$"))
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^\[(?:\.\.\.)?(.+)\]$", 1).alias("name"), s.startswith("[...").alias("catch_all")))


def glob_pattern(glob: str) -> str:
    """An unanchored pattern for a glob: ** is anything, * anything within a segment, ? one character of it."""
    out, k = "", 0
    while k < len(glob):
        two = glob[k : k + 2]
        if two == "**":
            out, k = out + ".*", k + 2
            continue
        c = glob[k]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".+^$()|{}[]\\" else c)
        k += 1
    return out


def scope_kind(raw: Column) -> Column:
    """The kind of a scope written as kind:value (all without a kind), and its value."""
    kind = F.when(raw.rlike("^[a-z]+:"), F.substring_index(raw, ":", 1)).otherwise(F.lit("all"))
    return F.struct(kind.alias("kind"), F.when(raw.contains(":"), F.regexp_replace(raw, "^[a-z]+:", "")).alias("value"))


def strip_range(version: Column) -> Column:
    """A version without what stands before its first digit."""
    return F.trim(F.regexp_replace(version, "^[^0-9]*", ""))


def version_at_least(version: Column, major: int, minor: int) -> Column:
    parts = F.split(strip_range(version), r"\.")
    own = F.struct(F.try_element_at(parts, F.lit(1)).try_cast("int"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0)))
    return F.coalesce(own >= F.struct(F.lit(major), F.lit(minor)), F.lit(False)) & F.try_element_at(parts, F.lit(1)).try_cast("int").isNotNull()


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounded to digits, halves upwards."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def clip(text: Column, most: int = 88) -> Column:
    """The text cut at the last space behind its 48th character, or hard, with three dots if it is longer than most."""
    head = F.substring(text, 1, most - 1)
    last = F.length(head) - F.length(F.substring_index(head, " ", -1))
    cut = F.when(head.contains(" ") & (last - 1 > 48), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def provider_blocks(text: Column, active: list[str], known: list[str]) -> Column:
    """Blocks between <tag> and </tag> on lines of their own, for known tags: the body stays if the tag is active, else all goes; then runs of blank lines shrink."""
    out = text
    for tag in known:
        block = rf"(^|\r?\n)[ \t]*<{tag}>[ \t]*\r?\n([\s\S]*?)\r?\n[ \t]*</{tag}>[ \t]*(?=\r?\n|\z)"
        out = F.regexp_replace(out, block, "$1$2" if tag in active else "$1")
    return F.when(out == text, text).otherwise(F.regexp_replace(out, r"(?:\r?\n){3,}+", "\n\n"))  # possessive: long runs take no stack


def placeholders(text: Column, values: dict[str, str]) -> Column:
    """{{name}} replaced, longest names first."""
    for name in sorted(values, key=len, reverse=True):
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(values[name]))
    return text


def humanized(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def toml_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def toml_multiline(text: Column) -> Column:
    body = F.regexp_replace(trimmed(text), "\r\n", "\n")
    escaped = F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"""'), F.lit('\\"""'))
    return F.when(~body.contains("\'\'\'"), F.concat(F.lit("\'\'\'\n"), body, F.lit("\n\'\'\'"))).otherwise(F.concat(F.lit('"""\n'), escaped, F.lit('\n"""')))


def toml_array(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(texts, toml_string), ", "), F.lit("]"))


def yaml_needs_quotes(value: Column) -> Column:
    """Whether a plain scalar would be read as something else than its own text."""
    parts = [r"^\s|\s\z", r"""^[\[\]{},&*!|>'"%@`#]""", r"^[?:-](\s|\z)", r": |\s#|:\z", r"(?i)^(true|false|null|yes|no|on|off|~)\z", r"^-?\d+(\.\d+)?([eE][+-]?\d+)?\z"]
    found = value == ""
    for p in parts:
        found = found | value.rlike(p)
    return found


def yaml_scalar(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(yaml_needs_quotes(value), quoted).otherwise(value)


def strip_bold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*(.*?)\*\*", "$1")


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’", "''")
