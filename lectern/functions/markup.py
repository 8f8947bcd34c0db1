"""Markup as blocks of runs, and references in prose."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,depth:int,runs:array<struct<t:string,b:boolean,i:boolean,href:string>>>>"


class _Blocks(HTMLParser):
    """Paragraphs, headings, items and quotes with bold, italic and linked runs."""

    KINDS = {"p": "p", "div": "p", "li": "li", "blockquote": "q"} | {f"h{k}": "h" for k in range(1, 7)}

    def __init__(self):
        super().__init__()
        self.out, self.open, self.depth, self.skip = [], None, 0, 0
        self.bold = self.italic = 0
        self.href = None

    def begin(self, kind):
        self.open = {"kind": kind, "depth": self.depth, "runs": []}
        self.out.append(self.open)

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.depth += tag in ("ul", "ol")
        self.bold += tag in ("b", "strong")
        self.italic += tag in ("i", "em")
        if tag == "a":
            self.href = dict(attrs).get("href")
        if tag in self.KINDS:
            self.begin(self.KINDS[tag])

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        self.depth = max(0, self.depth - (tag in ("ul", "ol")))
        self.bold = max(0, self.bold - (tag in ("b", "strong")))
        self.italic = max(0, self.italic - (tag in ("i", "em")))
        if tag == "a":
            self.href = None
        if tag in self.KINDS:
            self.open = None

    def handle_data(self, data):
        text = " ".join(data.split())
        if self.skip or not data:
            return
        if not text:
            if self.open and self.open["runs"]:
                self.open["runs"][-1]["t"] = self.open["runs"][-1]["t"].rstrip() + " "
            return
        if self.open is None:
            self.begin("p")
        text = (" " if data[:1].isspace() and self.open["runs"] else "") + text + (" " if data[-1:].isspace() else "")
        run = {"t": text, "b": self.bold > 0, "i": self.italic > 0, "href": self.href}
        runs = self.open["runs"]
        if runs and all(runs[-1][k] == run[k] for k in ("b", "i", "href")):
            runs[-1]["t"] = (runs[-1]["t"] + text).replace("  ", " ")
        else:
            runs.append(run)


def _parse(markup):
    if markup is None:
        return None
    parser = _Blocks()
    parser.feed(markup)
    parser.close()
    return [b for b in parser.out if b["runs"]]


def blocks(markup: Column) -> Column:
    return F.udf(_parse, BLOCKS, useArrow=True)(markup)


def block_text(found: Column) -> Column:
    """One line a block."""
    return F.array_join(F.transform(found, lambda b: F.trim(F.array_join(F.transform(b["runs"], lambda r: r["t"]), ""))), "\n")


def links(found: Column) -> Column:
    """Targets of linked runs in order, each once."""
    return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda b: F.transform(b["runs"], lambda r: r["href"]))), lambda h: h.isNotNull()))


def prose_references(text: Column, names: list[str]) -> Column:
    """References such as ``Gen. 1:1-3`` in a text, by the given book names, in order."""
    listed = "|".join(sorted((n.replace(".", r"\.") for n in names), key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])((?:{listed})\.?\s*\d+(?::\d+(?:[-–]\d+(?::\d+)?)?)?)"), F.lit(1))


def markdown_blocks(text: Column) -> Column:
    """array<struct<kind,depth,text>> of simple markdown: headings (h, depth 1 to 6), items (li), quotes (q) and paragraphs (p).

    Blank lines end a block; lines of a paragraph or quote are joined by spaces, an item is a line with its indented ones.
    """
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*\n|(?=\n#{1,6} )|(?=\n[ \t]*[-*] )"), lambda p: F.trim(F.translate(p, "\n\t", "  ")) != "")
    squeezed = lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))

    def read(part: Column) -> Column:
        body = F.regexp_replace(part, r"^\n+", "")
        marks = F.regexp_extract(body, "^(#{1,6}) ", 1)
        heading, item, quote = marks != "", body.rlike(r"^[ \t]*[-*] "), body.startswith("> ")
        indent = F.length(F.regexp_extract(body, "^[ \t]*", 0))
        kind = F.when(heading, "h").when(item, "li").when(quote, "q").otherwise("p")
        depth = F.when(heading, F.length(marks)).when(item, F.floor(indent / 2).cast("int") + 1).otherwise(0)
        plain = F.when(heading | item, F.regexp_replace(body, r"^[ \t]*(?:#{1,6}|[-*]) ", "")).when(quote, F.regexp_replace(body, r"(?m)^> ?", "")).otherwise(body)
        return F.struct(kind.alias("kind"), depth.alias("depth"), squeezed(plain).alias("text"))

    return F.transform(parts, read)


def links_kept(found: Column, valid: Column) -> Column:
    """blocks whose runs keep only links to one of the valid targets (an array)."""

    def run(r: Column) -> Column:
        return F.struct(r["t"].alias("t"), r["b"].alias("b"), r["i"].alias("i"), F.when(F.array_contains(valid, r["href"]), r["href"]).alias("href"))

    return F.transform(found, lambda b: F.struct(b["kind"].alias("kind"), b["depth"].alias("depth"), F.transform(b["runs"], run).alias("runs")))
