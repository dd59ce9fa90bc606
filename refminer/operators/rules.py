"""Retrieval by rules: selectors and paths that mark the parts of a page or an article that speak of data.

A rule table maps the name of a publisher to kinds of parts, and each kind to selectors with a label. Selectors are a
subset of CSS: tags, .class, #id, [attribute], with = *= ~= ^= $=, :contains('text'), and descendants. Paths for XML are
those of the standard library's parser.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refminer.operators import markup
from refminer.operators.markup import XLINK, plain

Rules = dict[str, dict[str, str]]

HTML_RULES: dict[str, Rules] = {
    "general": {
        "links": {"a[href*=dataset]": "dataset", "a[href*=data]": "dataset", "a[href*=supplementary]": "supplementary", "a[href*=pdf]": "supplementary"},
    },
    "PMC": {
        "data_availability": {"section.data-availability-statement": "dataset", "section.associated-data": "dataset", "h2.pmc_sec_title:contains('Data Availability')": "dataset", "h3.pmc_sec_title:contains('Data Availability')": "dataset"},
        "supplementary_material": {"section.supplementary-material": "supplementary", "h2.pmc_sec_title:contains('Supplementary Material')": "supplementary"},
    },
    "nature": {"links": {".additional-information a": "supplementary", "#data-availability-content a": "supplementary", "[data-title~=Data] a": "dataset"}},
    "sciencedirect": {"links": {".Appendices a": "dataset", "#da0010 a": "dataset"}},
}
XML_RULES: Rules = {
    "data_availability": {".//sec[@sec-type='data-availability']": "dataset", ".//notes[@notes-type='data-availability']": "dataset"},
    "supplementary_material": {".//supplementary-material": "supplementary"},
    "supplementary_data": {".//sec[@sec-type='supplementary-material']": "supplementary", ".//sec[@sec-type='associated-data']": "dataset", ".//sec[@sec-type='extended-data']": "dataset"},
}
#: Links that are labelled without looking any further.
SKIPPED = {"scholar.google.com": "Related Works"}

_STEP = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[*~^$]?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\]|:contains\((?P<q>['\"])(?P<text>.*?)(?P=q)\)")


class Step(NamedTuple):
    tag: str
    tests: tuple[tuple[str, str, str], ...]

    def fits(self, e: ET.Element) -> bool:
        return (self.tag in ("*", e.tag)) and all(_holds(e, *t) for t in self.tests)


def _holds(e: ET.Element, attribute: str, op: str, value: str) -> bool:
    if op == "contains":
        return value in plain(e)
    own = e.get(attribute)
    if own is None:
        return False
    return {"": True, "=": own == value, "*=": value in own, "~=": value in own.split(), "^=": own.startswith(value), "$=": own.endswith(value)}[op]


def parse_selector(css: str) -> list[Step]:
    """The steps of a selector; ValueError for what isn't understood."""
    steps = []
    for part in re.findall(r"(?:[^\s\[(]|\[[^\]]*\]|\([^)]*\))+", css):
        tag, tests, at = "*", [], 0
        while at < len(part):
            m = _STEP.match(part, at)
            if not m:
                raise ValueError(f"selector {css!r}")
            if m["tag"]:
                tag = m["tag"]
            elif m["cls"]:
                tests.append(("class", "~=", m["cls"]))
            elif m["id"]:
                tests.append(("id", "=", m["id"]))
            elif m["attr"]:
                tests.append((m["attr"], m["op"] or "", m["value"] or ""))
            else:
                tests.append(("", "contains", m["text"]))
            at = m.end()
        steps.append(Step(tag, tuple(tests)))
    return steps


def select(root: ET.Element, steps: list[Step]) -> list[ET.Element]:
    """The elements that a selector picks, in document order."""
    out: list[ET.Element] = []

    def walk(e: ET.Element, done: int) -> None:
        for child in e:
            # the longest prefix of the steps before the last that the ancestors have met, greedily from the left
            if done == len(steps) - 1 and steps[done].fits(child):
                out.append(child)
            walk(child, done + 1 if done < len(steps) - 1 and steps[done].fits(child) else done)

    walk(root, 0)
    return out


def merged(publisher: str | None, rules: dict[str, Rules] | None = None) -> Rules:
    """The general rules with a publisher's own, whose selectors come first."""
    table = HTML_RULES if rules is None else rules
    out = {kind: dict(s) for kind, s in table.get(publisher or "", {}).items()}
    for kind, selectors in table.get("general", {}).items():
        out.setdefault(kind, {})
        out[kind] |= {s: label for s, label in selectors.items() if s not in out[kind]}
    return out


def _found(content: str, kind: str, rules: Rules) -> list[tuple[str, str, str, ET.Element]]:
    """(rule kind, selector, label, element) of all matches; selectors that aren't understood match nothing."""
    root = markup.html_tree(content) if kind == "HTML" else markup.xml_tree(content)
    out = []
    for name, selectors in rules.items():
        for selector, label in selectors.items():
            try:
                hits = select(root, parse_selector(selector)) if kind == "HTML" else root.findall(selector)
            except (ValueError, SyntaxError, KeyError):
                continue
            out += [(name, selector, label, e) for e in hits]
    return out


def has_links(e: ET.Element) -> bool:
    """Whether an element holds an external link, a file or an anchor."""
    return any((d.tag in ("ext-link", "media", "uri") and d.get(XLINK + "href")) or (d.tag == "a" and d.get("href")) for d in e.iter())


def rule_matches(docs: DataFrame, publisher: str | None = None, html: dict[str, Rules] | None = None, xml: Rules | None = None) -> DataFrame:
    """key, rule, selector, label, tag, href, text and linked of every element of docs (key, content, format) that a rule picks."""
    pages, articles = merged(publisher, html), XML_RULES if xml is None else xml

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        found = _found(content, kind, pages if kind == "HTML" else articles)
        return [(name, s, label, e.tag, e.get("href") or e.get(XLINK + "href"), plain(e), has_links(e)) for name, s, label, e in found]

    return markup._rows(docs, parse, "rule string, selector string, label string, tag string, href string, text string, linked boolean")


def section_flags(docs: DataFrame, publisher: str | None = None, html: dict[str, Rules] | None = None, xml: Rules | None = None) -> DataFrame:
    """key, rule, present and linked: for every document and rule kind, whether some selector picks anything, and anything with a link.
    Documents that can't be read have no row."""
    pages, articles = merged(publisher, html), XML_RULES if xml is None else xml

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        rules = pages if kind == "HTML" else articles
        found = _found(content, kind, rules)
        return [(name, any(f[0] == name for f in found), any(f[0] == name and has_links(f[3]) for f in found)) for name in rules]

    return markup._rows(docs, parse, "rule string, present boolean, linked boolean")


def namespaces(docs: DataFrame) -> DataFrame:
    """key, prefix ('' for the default one) and uri of the namespaces that XML documents declare, each once."""
    declared = F.regexp_extract_all("content", F.lit(r"""(xmlns(?::[\w.-]+)?\s*=\s*["'][^"']*["'])"""), F.lit(1))
    one = docs.select(F.col("key").cast("string").alias("key"), F.explode(F.array_distinct(declared)).alias("d"))
    return one.select("key", F.regexp_extract("d", r"^xmlns:([\w.-]+)", 1).alias("prefix"), F.regexp_extract("d", r"""["']([^"']*)["']$""", 1).alias("uri")).distinct()


def elements_with(docs: DataFrame, identifier: str, tags: tuple[str, ...] = ("p", "table")) -> DataFrame:
    """key, tag, text and length of the paragraphs and tables of docs (key, content, format, and the column identifier) whose text has it, whatever the case."""
    sought = docs.select(F.col("key").cast("string").alias("key"), F.lower(identifier).alias("_i")).distinct()

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        root = markup.html_tree(content) if kind == "HTML" else markup.xml_tree(content)
        return [(k, e.tag, plain(e)) for k, e in enumerate(e for e in root.iter() if e.tag in tags)]

    parts = markup._rows(docs, parse, "at int, tag string, text string")
    return parts.join(sought, "key").filter(F.contains(F.lower("text"), F.col("_i"))).select("key", "at", "tag", "text", F.length("text").alias("length"))


def _pretty(e: ET.Element, depth: int, out: list[str]) -> None:
    name = lambda t: t.rpartition("}")[2]
    attributes = "".join(f' {name(k)}="{v}"' for k, v in sorted(e.attrib.items()))
    text, pad = (e.text or "").strip(), "  " * depth
    if not len(e):
        out.append(f"{pad}<{name(e.tag)}{attributes}>{text}</{name(e.tag)}>" if text else f"{pad}<{name(e.tag)}{attributes}/>")
        return
    out.append(f"{pad}<{name(e.tag)}{attributes}>{text}")
    for child in e:
        _pretty(child, depth + 1, out)
        if (child.tail or "").strip():
            out.append(f"{pad}  {(child.tail or '').strip()}")
    out.append(f"{pad}</{name(e.tag)}>")


def normalised(docs: DataFrame) -> DataFrame:
    """key and content of docs (key, content, format) in one form: a line for each element, indented, attributes sorted, texts stripped.

    XML begins with a declaration and its namespaces' prefixes go; of pages, scripts, styles and what else isn't shown go too.
    """

    def drop(e: ET.Element) -> None:
        for child in list(e):
            if child.tag in markup.DROPPED or not isinstance(child.tag, str):
                before = e[list(e).index(child) - 1] if list(e).index(child) else None
                if before is not None:
                    before.tail = (before.tail or "") + (child.tail or "")
                else:
                    e.text = (e.text or "") + (child.tail or "")
                e.remove(child)
            else:
                drop(child)

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        root = markup.html_tree(content) if kind == "HTML" else markup.xml_tree(content)
        out: list[str] = []
        if kind == "HTML":
            drop(root)
            for child in root:
                _pretty(child, 0, out)
        else:
            out.append('<?xml version="1.0" encoding="UTF-8"?>')
            _pretty(root, 0, out)
        return [("\n".join(out),)]

    return markup._rows(docs, parse, "content string")
