"""Accessibility rules. Opening tags and their children need a scanner with state, so a file's findings are made in an Arrow function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import first_findings

#: Interactive components, and the marks of what screen readers do not see.
INTERACTIVE = ("Pressable", "TouchableOpacity", "TouchableHighlight", "TouchableWithoutFeedback", "TouchableNativeFeedback")
HIDDEN = re.compile(r"""accessibilityElementsHidden\s*=\s*\{?\s*true|importantForAccessibility\s*=\s*["'{]?\s*no\b|accessible\s*=\s*\{?\s*false|aria-hidden""")
_OUT = "rule string, description string, severity string, path string, line int, snippet string, rank int, offset int"


def opening_tag(text: str, start: int) -> tuple[str, int]:
    """The tag that begins at start and where it ends: at the first > outside braces; 400 characters if there is none."""
    depth = 0
    for m in re.compile("[{}>]").finditer(text, start):
        if m[0] == ">" and depth == 0:
            return text[start : m.end()], m.start()
        depth += {"{": 1, "}": -1}.get(m[0], 0)
    return text[start : start + 400], start + 400


def has_text_child(text: str, end: int, tag: str) -> bool:
    """Whether an element whose opening tag ends at end has visible text: a <Text> in it, or letters or digits before any other tag or expression."""
    if text[end - 1 : end] == "/":
        return False
    limit, close, depth = min(len(text), end + 4000), -1, 1
    for m in re.compile(rf"<{re.escape(tag)}(?=[\s/>])|</{re.escape(tag)}\s*>").finditer(text, end + 1):
        if m.start() >= limit:
            break
        if m[0].startswith("</"):
            depth -= 1
            if not depth:
                close = m.start()
                break
        elif not re.search(r"/>\s*\Z", opening_tag(text, m.start())[0]):
            depth += 1
    inner = text[end + 1 : close if close >= 0 else min(len(text), end + 600)]
    return bool(re.search(r"<Text[\s>]", inner) or re.match(r"[^<{]*[A-Za-z0-9]", inner.lstrip()))


def _has(tag: str, *props: str) -> bool:
    return any(re.search(rf"\b{p}\s*=", tag) for p in props)


def findings(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """rule, description, severity, offset, rank of one file."""
    label = ("accessibilityLabel", "aria-label")
    for name in INTERACTIVE:
        for m in re.finditer(rf"<{name}(?=[\s/>])", text):
            tag, end = opening_tag(text, m.start())
            if HIDDEN.search(tag):
                continue
            if not _has(tag, "accessibilityRole", "role"):
                yield "A11Y001", f"{name} has no role.", "error", m.start(), 1
            if not _has(tag, *label) and not has_text_child(text, end, name):
                yield "A11Y002", f"{name} has neither a label nor text.", "error", m.start(), 1
    for m in re.finditer(r"<(Image|FastImage)(?=[\s/>])", text):
        tag, _ = opening_tag(text, m.start())
        if not HIDDEN.search(tag) and not _has(tag, "alt", *label):
            role = re.search(r"""accessibilityRole\s*=\s*["'{]?\s*image""", tag)
            yield "A11Y003", f"{m[1]} has no label and is not hidden.", "error" if role else "warning", m.start(), 2
    for m in re.finditer(r"""accessibilityRole\s*=\s*["'{]?\s*button""", text):
        start = text.rfind("<", 0, m.start() + 1)
        if start >= 0:
            tag, end = opening_tag(text, start)
            name = re.match(r"<(\w+)", tag)
            if not _has(tag, *label) and not has_text_child(text, end, name[1] if name else "element"):
                yield "A11Y004", f"{name[1] if name else 'element'} is a button without a name.", "error", start, 3
    for m in re.finditer(r"<TextInput(?=[\s/>])", text):
        tag, _ = opening_tag(text, m.start())
        if not _has(tag, *label):
            yield "A11Y005", "TextInput has only a placeholder." if _has(tag, "placeholder") else "TextInput has no label.", "warning", m.start(), 4


def audit(corpus: DataFrame) -> DataFrame:
    """Findings of five rules, one for a rule, file and line, errors first. Null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for rule, why, severity, at, rank in findings(text):
                    line = text.count("\n", 0, at) + 1
                    rows.append((rule, why, severity, path, line, text.split("\n")[line - 1].strip(), rank, at))
            names = [f.split(" ")[0] for f in _OUT.split(", ")]
            kinds = [pa.int32() if f.endswith("int") else pa.string() for f in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    code = corpus.where(F.col("text").rlike("Pressable|Touchable|Image|TextInput|accessibilityRole"))
    return first_findings(code.select("path", "text").mapInArrow(run, _OUT))
