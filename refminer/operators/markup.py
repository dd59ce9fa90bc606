"""Reading of markup: JATS and TEI XML, HTML pages, embedded metadata.

Titles, tag counts and plain text are column functions. Anything with structure is parsed once per document, in Arrow
batches, by the standard library's parsers; broken documents give no rows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refminer.functions.batches import pieces

TEI = "{http://www.tei-c.org/ns/1.0}"
XLINK = "{http://www.w3.org/1999/xlink}"
SECTION_TAGS = ("sec", "notes", "ack", "app", "fn-group")
AVAILABILITY = re.compile(r"data[\s_-]*(and[\s\w-]*)?availability|availability of data|associated data|deposited data|accession (codes|numbers)|key resources", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style img iframe noscript svg button form input".split())


# --- column functions -------------------------------------------------------------------------------------------------


def html_title(html: Column) -> Column:
    """The article's heading, else the page's title, else 'No title found'."""
    pick = lambda p: F.when(F.regexp_extract(html, p, 1) != "", F.regexp_extract(html, p, 1))
    return F.trim(F.coalesce(pick(r'(?is)<h1[^>]*class="[^"]*article-title[^"]*"[^>]*>(.*?)</h1>'), pick(r"(?is)<title[^>]*>(.*?)</title>"), F.lit("No title found")))


def xml_title(xml: Column) -> Column:
    title = F.regexp_extract(xml, r"(?is)<article-title[^>]*>(.*?)</article-title>", 1)
    return F.trim(F.regexp_replace(title, "<[^>]*>", ""))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, space runs become one space."""
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " "))


def section_count(content: Column, kind: str) -> Column:
    pattern = r"(?i)<section[ >]" if kind == "HTML" else r"<(sec|ack|app|fn-group)[ >]"
    return F.regexp_count(content, F.lit(pattern)).cast("bigint")


def fulltext_complete(content: Column, kind: Column, least: int) -> Column:
    """Whether a document has at least so many sections; a PDF is complete, none isn't."""
    enough = F.when(kind == "XML", section_count(content, "XML") >= least).otherwise(section_count(content, "HTML") >= least)
    return F.when(content.isNull(), F.lit(False)).when(kind == "PDF", F.lit(True)).otherwise(enough)


def is_tei(xml: Column) -> Column:
    return xml.contains("http://www.tei-c.org/ns/1.0")


# --- trees ------------------------------------------------------------------------------------------------------------


class _Builder(HTMLParser):
    """HTML to an element tree; unclosed p and li end where the next begins, other unclosed tags where their parent ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        element = ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if len(at):
            at[-1].tail = (at[-1].tail or "") + data
        else:
            at.text = (at.text or "") + data


def html_tree(html: str) -> ET.Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def xml_tree(xml: str) -> ET.Element:
    """The root; entity definitions are refused, since they can grow without bound."""
    if "<!ENTITY" in xml:
        raise ET.ParseError("entity definitions")
    return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", xml))


def plain(element: ET.Element | None, skip: frozenset[str] = frozenset()) -> str:
    """Text of an element, space runs as one space."""

    def walk(e: ET.Element) -> Iterator[str]:
        yield e.text or ""
        for child in e:
            if child.tag not in skip:
                yield from walk(child)
            yield child.tail or ""

    return "" if element is None else " ".join("".join(walk(element)).split())


def with_marks(element: ET.Element) -> str:
    """Text in which references show what they point to: [rid=...] and (href)."""

    def walk(e: ET.Element) -> Iterator[str]:
        yield e.text or ""
        for child in e:
            yield from walk(child)
            if child.get("rid"):
                yield f" [rid={child.get('rid')}]"
            elif link := child.get(XLINK + "href") or child.get("href"):
                yield f" ({link})"
            yield child.tail or ""

    return " ".join("".join(walk(element)).split())


def _own_paragraphs(section: ET.Element, nested: tuple[str, ...]) -> list[ET.Element]:
    """Paragraphs of a section without those of sections inside it."""
    out: list[ET.Element] = []
    for child in section:
        if child.tag in nested:
            continue
        out += [child] if child.tag == "p" else _own_paragraphs(child, nested)
    return out


def table_rows(table: ET.Element) -> list[list[str]]:
    """Cells of every row that aren't empty."""
    return [[t for t in (plain(c) for c in row if c.tag in ("td", "th")) if t] for row in table.iter("tr")]


def table_text(rows: list[list[str]]) -> str:
    """Rows as lines, cells padded to their column's width and joined by ' | '."""
    width = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return "\n".join(" | ".join(c.ljust(width[k]) for k, c in enumerate(r)) for r in rows if r)


# --- sections, paragraphs, tables -------------------------------------------------------------------------------------

Section = tuple[str, str, str, list[str], str]


def jats_sections(root: ET.Element) -> list[Section]:
    """(title, type, text, paragraphs, tables as text) of each section with text; a title is led by its parents' titles. Repeats go."""
    out: list[Section] = []
    seen: set[str] = set()

    def walk(e: ET.Element, path: list[str]) -> None:
        here = path
        if e.tag in SECTION_TAGS:
            title = plain(e.find("title")) or {"ack": "Acknowledgments", "fn-group": "Footnotes"}.get(e.tag, "")
            here = [*path, title] if title else path
            kind = e.get("sec-type") or e.get("notes-type") or ("unknown" if e.tag == "sec" else e.tag)
            paragraphs = [p for p in map(plain, _own_paragraphs(e, SECTION_TAGS)) if p]
            tables = "\n\n".join(table_text(table_rows(t)) for w in e.findall("table-wrap") for t in w.iter("table"))
            text = "\n".join(paragraphs)
            if (text or tables) and text + tables not in seen:
                seen.add(text + tables)
                out.append((" > ".join(here), kind, text, paragraphs, tables))
        for child in e:
            walk(child, here)

    walk(root, [])
    return out


def tei_sections(root: ET.Element) -> list[Section]:
    out: list[Section] = []
    for div in root.iter(TEI + "div"):
        paragraphs = [t for t in map(plain, div.findall(TEI + "p")) if t]
        if paragraphs:
            out.append((plain(div.find(TEI + "head")), "tei_div", "\n".join(paragraphs), paragraphs, ""))
    return out


def html_sections(root: ET.Element) -> list[Section]:
    """The same of <section> elements, or of the whole page where there is none; the title is the first heading, the type the class."""
    found = list(root.iter("section")) or [root]
    out: list[Section] = []
    seen: set[str] = set()
    for s in found:
        heading = next((plain(h) for h in s.iter() if h.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), "")
        paragraphs = [t for t in (plain(p, DROPPED) for p in _own_paragraphs(s, ("section",))) if t]
        inner = {id(t) for n in s.iter("section") if n is not s for t in n.iter("table")}
        tables = "\n\n".join(table_text(table_rows(t)) for t in s.iter("table") if id(t) not in inner)
        text = "\n".join(paragraphs)
        if (text or tables) and text + tables not in seen:
            seen.add(text + tables)
            out.append((heading, s.get("class") or "unknown", text, paragraphs, tables))
    return out


def document_sections(content: str, kind: str) -> list[Section]:
    if kind == "HTML":
        return html_sections(html_tree(content))
    if kind == "XML":
        root = xml_tree(content)
        return tei_sections(root) if any(e.tag.startswith(TEI) for e in root.iter()) else jats_sections(root)
    return [("", "unknown", content, [p for p in content.split("\n") if p.strip()], "")]


_BROKEN = (ET.ParseError, ValueError, RecursionError, AssertionError)


def _rows(docs: DataFrame, parse: Callable[[str, str], list[tuple[Any, ...]]], schema: str, empty: tuple[Any, ...] | None = None) -> DataFrame:
    """key and the tuples that parse(content, format) gives, for docs with key, content and format; empty, if given, for a document without content."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for batch in parts for piece in pieces(batch)):
            keys, rows = [], []
            for key, content, kind in zip(*[part.column(c) for c in ("key", "content", "format")], strict=True):
                content, kind = content.as_py(), kind.as_py()
                try:
                    found = parse(content, kind or "HTML") if content else [] if empty is None else [empty]
                except _BROKEN:
                    found = []  # a broken document has no parts
                keys += [key.as_py()] * len(found)
                rows += found
            arrays = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *arrays], ["key", *kinds.names])

    kind = F.col("format") if "format" in docs.columns else F.lit("HTML")
    return docs.select(F.col("key").cast("string"), "content", kind.alias("format")).mapInArrow(run, f"key string, {schema}")


def sections(docs: DataFrame) -> DataFrame:
    """key, sec_idx, section_title, sec_type, kind ('availability' or 'section'), text, paragraphs and tables of docs (key, content, format)."""

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        return [(k, s[0], s[1], "availability" if AVAILABILITY.search(f"{s[0]} {s[1]}") else "section", s[2], s[3], s[4]) for k, s in enumerate(document_sections(content, kind))]

    return _rows(docs, parse, "sec_idx int, section_title string, sec_type string, kind string, text string, paragraphs array<string>, tables string")


def html_paragraphs(docs: DataFrame) -> DataFrame:
    """key, p_idx, sec_type (the class) and text of paragraphs of at least five characters."""

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        found = [(p.get("class") or "", plain(p, DROPPED)) for p in html_tree(content).iter("p")]
        return [(k, c, t) for k, (c, t) in enumerate(x for x in found if len(x[1]) >= 5)]

    return _rows(docs, parse, "p_idx int, sec_type string, text string")


def _bibliography(root: ET.Element) -> dict[str, str]:
    """Text of each entry of a TEI bibliography by its id: authors, titles, date and number, joined by ', '."""
    out = {}
    for b in root.iter(TEI + "biblStruct"):
        names = [" ".join(t for t in (plain(a.find(TEI + "forename")), plain(a.find(TEI + "surname"))) if t) for a in b.findall(f".//{TEI}analytic/{TEI}author/{TEI}persName")]
        parts = [", ".join(n for n in names if n), plain(b.find(f".//{TEI}analytic/{TEI}title")), plain(b.find(f".//{TEI}monogr/{TEI}title")), plain(b.find(f".//{TEI}monogr/{TEI}imprint/{TEI}date")), plain(b.find(f".//{TEI}idno"))]
        out[b.get("{http://www.w3.org/XML/1998/namespace}id") or ""] = ", ".join(p for p in parts if p)
    return out


def tei_paragraphs(docs: DataFrame, substitute: bool = False) -> DataFrame:
    """key, p_idx, section_title and text of the paragraphs of TEI documents with at least five characters. The title is the head
    of the nearest division that has one. With substitute, references to the bibliography give way to their entries' text."""

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        root = xml_tree(content)
        entries = _bibliography(root) if substitute else {}
        parents = {c: p for p in root.iter() for c in p}

        def text(e: ET.Element) -> str:
            own = entries.get((e.get("target") or "").lstrip("#")) if e.tag == TEI + "ref" else None
            return own or "".join([e.text or "", *[text(c) + (c.tail or "") for c in e]])

        out = []
        for p in root.iter(TEI + "p"):
            at = _near(p, parents, (TEI + "div",))
            while at is not None and not plain(at.find(TEI + "head")):
                at = _near(parents[at], parents, (TEI + "div",)) if at in parents else None
            title = plain(at.find(TEI + "head")) if at is not None else "No Title"
            words = " ".join(text(p).split())
            if len(words) >= 5:
                out.append((len(out), title, words))
        return out

    return _rows(docs, parse, "p_idx int, section_title string, text string")


def pdf_text(pages: DataFrame) -> DataFrame:
    """key and text of documents from the text of their pages (key, page, text), each in Unicode's composed compatibility form, joined in order by a line 'NewPage'."""

    def compose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        for part in parts:
            texts = [unicodedata.normalize("NFKC", t) if t else "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("page"), pa.array(texts, pa.string())], ["key", "page", "text"])

    composed = pages.select(F.col("key").cast("string"), F.col("page").cast("bigint"), F.col("text").cast("string")).mapInArrow(compose, "key string, page bigint, text string")
    ordered = composed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("_p"))
    return ordered.select("key", F.array_join(F.transform("_p", lambda p: p["text"]), "\nNewPage\n").alias("text"))


def pdf_sections(docs: DataFrame) -> DataFrame:
    """key, sec_idx, section_title and text of documents (key, text): a heading line, as text.section_headings takes it, opens a section; what stands before the first has the title ''."""
    from refminer.functions.text import section_headings

    lines = docs.select(F.col("key").cast("string").alias("key"), section_headings(F.col("text")).alias("_h"), F.split("text", "\n").alias("_l"))
    # the sections of a row are cut at its headings' places: no fold over its lines
    at = F.filter(F.transform("_l", lambda x, i: F.when(F.array_contains("_h", x), i)), lambda i: i.isNotNull())
    starts = F.concat(F.when(F.get(at, F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))), at)
    cut = lines.withColumn("_s", starts).select("key", "_h", "_l", "_s", F.posexplode("_s").alias("sec_idx", "_a"))
    end = F.coalesce(F.get("_s", F.col("sec_idx") + 1), F.size("_l"))
    first = F.get("_l", F.col("_a"))
    headed = F.array_contains("_h", first)
    body = F.when(headed, F.slice("_l", F.col("_a") + 2, end - F.col("_a") - 1)).otherwise(F.slice("_l", F.col("_a") + 1, end - F.col("_a")))
    return cut.select("key", "sec_idx", F.when(headed, F.trim(first)).otherwise("").alias("section_title"), F.trim(F.array_join(body, "\n")).alias("text"))


def pdf_references(docs: DataFrame) -> DataFrame:
    """key, ref_idx and text of the entries of the last section called References of documents (key, text)."""
    from refminer.functions.text import split_references

    found = pdf_sections(docs).filter(F.lower("section_title").rlike(r"^(\d+(\.\d+)*\.? )?references$"))
    last = found.groupBy("key").agg(F.max_by("text", "sec_idx").alias("text"))
    return last.select("key", F.posexplode(split_references(F.col("text"))).alias("ref_idx", "text"))


def tables_of(docs: DataFrame) -> DataFrame:
    """key, table_idx, headers, rows (cells that aren't empty) and text of every table."""

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        root = html_tree(content) if kind == "HTML" else xml_tree(content)
        out = []
        for k, t in enumerate(root.iter("table")):
            rows = table_rows(t)
            out.append((k, [plain(h) for head in t.iter("thead") for h in head.iter("th")], rows, table_text(rows)))
        return out

    return _rows(docs, parse, "table_idx int, headers array<string>, rows array<array<string>>, text string")


def table_chunks(text: str, most_tokens: int) -> list[str]:
    """A table's lines in chunks within a budget of four characters a token, the header first in each."""
    header, *lines = text.split("\n")
    out, now = [], [header]
    for line in lines:
        if len(now) > 1 and sum(map(len, now)) + len(line) > 4 * most_tokens:
            out.append("\n".join(now))
            now = [header]
        now.append(line)
    return [*out, "\n".join(now)]


# --- links, citations, titles -----------------------------------------------------------------------------------------


def _near(element: ET.Element, parents: dict[ET.Element, ET.Element], tags: tuple[str, ...]) -> ET.Element | None:
    at: ET.Element | None = element
    while at is not None and at.tag not in tags:
        at = parents.get(at)
    return at


def supplements(docs: DataFrame) -> DataFrame:
    """key, link, id, content_type, title, caption, context_description, file_extension and source_section of supplementary files.

    JATS: media in supplementary material (each link once) and inline material; HTML: links marked as supplements or within
    supplementary sections. The context is the sentences of the text that refer to the file's id.
    """

    def xml(root: ET.Element) -> list[tuple[Any, ...]]:
        parents = {c: p for p in root.iter() for c in p}
        mentions: dict[str, list[str]] = {}
        for x in root.iter("xref"):
            if (p := _near(x, parents, ("p",))) is not None and x.get("rid"):
                mentions.setdefault(x.get("rid", ""), []).append(with_marks(p))
        out, seen = [], set()
        for s in [e for e in root.iter() if e.tag in ("supplementary-material", "inline-supplementary-material")]:
            media = list(s.iter("media")) or [s]
            for m in media:
                link = m.get(XLINK + "href") or s.get(XLINK + "href")
                if not link or (s.tag == "supplementary-material" and link in seen):
                    continue
                seen.add(link)
                name = s.get("id") or m.get("id") or ""
                section = _near(s, parents, SECTION_TAGS)
                tail = link.rpartition(".")[2]
                sentences = [t for p in mentions.get(name, []) for t in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p.replace(f"[rid={name}]", "this file")) if "this file" in t]
                title, caption = plain(s.find(".//caption/title")) or plain(s.find("label")), " ".join(plain(p) for p in s.findall(".//caption/p"))
                out.append((link, name, s.get("content-type") or "media p", title, caption, " ".join(dict.fromkeys(sentences)), "" if "/" in tail else tail, (section.get("sec-type") or plain(section.find("title"))) if section is not None else ""))
        return out

    def html(root: ET.Element) -> list[tuple[Any, ...]]:
        parents = {c: p for p in root.iter() for c in p}
        out, seen = [], set()
        for a in root.iter("a"):
            link = a.get("href") or ""
            section = _near(a, parents, ("section",))
            label = f"{section.get('class') or ''} {section.get('id') or ''}" if section is not None else ""
            marked = "suppl" in (a.get("data-ga-action") or "") or "suppl" in (a.get("data-track-action") or "").lower() or "suppl" in label.lower() or "associated-data" in label
            if not marked or not link or link.startswith("#") or "ref-list" in label or link in seen:
                continue
            seen.add(link)
            around = parents.get(a)
            caption = next((plain(d) for d in (around.iter() if around is not None else []) if "caption" in (d.get("class") or "")), plain(around))
            tail = link.rpartition(".")[2]
            name = section.get("id") or "" if section is not None else ""
            referring = [plain(parents.get(x)) for x in root.iter("a") if name and x.get("href") == "#" + name]
            out.append((link, name, a.get("data-ga-action") or "link", plain(a), caption, " ".join(referring), "" if "/" in tail else tail, label.strip()))
        return out

    return _rows(docs, lambda content, kind: html(html_tree(content)) if kind == "HTML" else xml(xml_tree(content)), "link string, id string, content_type string, title string, caption string, context_description string, file_extension string, source_section string")


def availability_links(docs: DataFrame) -> DataFrame:
    """key, href, link_text and surrounding_text of the external links, and of references other than bibliographic ones, in
    availability sections; such references have '#rid' as href."""

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        root = html_tree(content) if kind == "HTML" else xml_tree(content)
        tags = ("section", "div") if kind == "HTML" else SECTION_TAGS
        out: dict[tuple[str, str], tuple[Any, ...]] = {}
        for s in root.iter():
            if s.tag in tags and AVAILABILITY.search(" ".join([s.get("class") or "", s.get("sec-type") or s.get("notes-type") or "", plain(s.find("title")), plain(s.find("h2")), plain(s.find("h3"))])):
                for p in [e for e in s.iter() if e.tag in ("p", "li", "td")]:
                    for e in p.iter():
                        href = e.get(XLINK + "href") if e.tag in ("ext-link", "uri", "media") else e.get("href") if e.tag == "a" else "#" + e.get("rid", "") if e.tag == "xref" and e.get("ref-type") != "bibr" else None
                        if href:
                            out.setdefault((href, plain(e)), (href, plain(e), with_marks(p)))
        return list(out.values())

    return _rows(docs, parse, "href string, link_text string, surrounding_text string")


def references_of(docs: DataFrame) -> DataFrame:
    """key, ref_idx, label, text, ids (kind to value) and links of each entry of the reference list."""

    def xml(root: ET.Element) -> list[tuple[Any, ...]]:
        out = []
        for k, ref in enumerate(root.iter("ref")):
            body = next((e for e in ref.iter() if e.tag in ("mixed-citation", "element-citation", "citation")), ref)
            ids = [(i.get("pub-id-type") or "other", plain(i)) for i in ref.iter("pub-id")]
            out.append((k, plain(ref.find("label")), plain(body), list(dict(ids).items()), [e.get(XLINK + "href") or "" for e in ref.iter("ext-link")]))
        return out

    def html(root: ET.Element) -> list[tuple[Any, ...]]:
        out = []
        for s in root.iter():
            if "ref-list" in (s.get("class") or "") and s.tag in ("section", "div"):
                for li in s.iter("li"):
                    label = next((plain(e) for e in li.iter("span") if "label" in (e.get("class") or "")), "")
                    out.append((len(out), label, plain(next(li.iter("cite"), li)), [], [a.get("href") or "" for a in li.iter("a")]))
        return out

    return _rows(docs, lambda content, kind: html(html_tree(content)) if kind == "HTML" else xml(xml_tree(content)), "ref_idx int, label string, text string, ids map<string,string>, links array<string>")


def titles(docs: DataFrame) -> DataFrame:
    """key and pub_title of every document that has one, by its format."""

    def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
        if kind == "HTML":
            root = html_tree(content)
            found = next((plain(h) for h in root.iter("h1") if "article-title" in (h.get("class") or "")), "") or plain(next(root.iter("title"), None))
        else:
            root = xml_tree(content)
            found = plain(root.find(f".//{TEI}analytic/{TEI}title")) or plain(root.find(f".//{TEI}monogr/{TEI}title")) or plain(root.find(".//title-group/article-title")) or plain(next(root.iter("article-title"), None))
        return [(found,)] if found else []

    return _rows(docs, parse, "pub_title string")


# --- embedded dataset metadata ----------------------------------------------------------------------------------------

METADATA = ("name", "description", "identifier", "url", "creator", "publisher", "license", "keywords", "datePublished", "dateModified", "version", "distribution", "isPartOf", "citation")


def is_dataset_type(kind: Any) -> bool:
    if isinstance(kind, list):
        return any(map(is_dataset_type, kind))
    return isinstance(kind, str) and (kind == "Dataset" or kind.endswith(("/Dataset", "#Dataset")))


def _entity(value: Any) -> Any:
    if isinstance(value, list):
        return [_entity(v) for v in value]
    if isinstance(value, dict):
        return {k: value[k] for k in ("@type", "name", "url", "identifier") if value.get(k)}
    return {"name": value} if isinstance(value, str) else value


def schema_org(html: str) -> dict[str, str]:
    """The fields of a page's dataset description (JSON-LD, else Microdata, else its meta title); values as strings or JSON."""
    root = html_tree(html)
    for script in root.iter("script"):
        if "ld+json" in (script.get("type") or ""):
            try:
                data = json.loads("".join(script.itertext()))
            except ValueError:
                continue
            every = data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []
            for item in every:
                if isinstance(item, dict) and is_dataset_type(item.get("@type")):
                    found = {k: _entity(item[k]) if k in ("creator", "publisher") else item[k] for k in METADATA if item.get(k)}
                    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()}
    for e in root.iter():
        if is_dataset_type(e.get("itemtype")):
            props = {p.get("itemprop", ""): p.get("content") or p.get("href") or plain(p) for p in e.iter() if p.get("itemprop")}
            return {k: v for k, v in props.items() if k in METADATA and v}
    for m in root.iter("meta"):
        if (m.get("property") or m.get("name") or "").lower() in ("og:title", "citation_title", "dc.title") and m.get("content"):
            return {"name": m.get("content", "")}
    return {}


def dataset_metadata(docs: DataFrame, with_content: bool = False) -> DataFrame:
    """key and metadata, a map, of every page that describes a dataset; with_content all pages, with their content and null where they don't."""
    if with_content:

        def parse(content: str, kind: str) -> list[tuple[Any, ...]]:
            try:
                found = schema_org(content)
            except _BROKEN:
                found = {}
            return [(content, list(found.items()) or None)]

        return _rows(docs, parse, "content string, metadata map<string,string>", empty=(None, None))
    return _rows(docs, lambda content, kind: [(list(found.items()),)] if (found := schema_org(content)) else [], "metadata map<string,string>")
