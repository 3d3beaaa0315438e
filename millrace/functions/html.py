"""Pages as text: a walk over the tags in document order, by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What is dropped with its content, and what starts a block.
DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "button"}
BLOCKS = {"p", "div", "section", "article", "main", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "blockquote", "dl", "dt", "dd", "pre", "hr"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Walk(HTMLParser):
    """Tag events to blocks. A list or a table is one block of lines, which ends with its outermost tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.title, self.trail, self.out, self.line, self.heading = [], "", [], [], "", 0
        self.events: list[tuple[int, str]] = []  # (level, title) of headings, (0, text) of blocks
        self.group: list[str] = []  # lines of the open list or table
        self.lists: list[list] = []  # [is it numbered, items so far] of each open list
        self.tables, self.cells, self.open_cell, self.first_row, self.pre, self.term = 0, None, False, True, False, ""

    def crumb(self) -> str:
        return " > ".join(x[1] for x in self.trail)

    def emit(self, block: str) -> None:
        self.out.append((self.crumb(), block))
        self.events.append((0, block))

    def flush(self, prefix: str = "") -> None:
        if self.pre:
            text = f"```\n{self.line}\n```" if self.line.strip() else ""
        else:
            text = " ".join(self.line.split())
        self.line = ""
        if not text or text in ("-", ">"):
            return
        if self.heading:
            self.trail = [x for x in self.trail if x[0] < self.heading] + [(self.heading, text)]
            self.events.append((self.heading, text))
        elif self.lists and not self.pre:
            self._item(text)
        else:
            self.emit(prefix + text)

    def _item(self, text: str) -> None:
        numbered, n, fresh = self.lists[-1]
        depth = len(self.lists) - 1
        self.group.append("  " * depth + (f"{n}. " if numbered else "- ") + text if fresh else "  " * (depth + 1) + text)
        self.lists[-1][2] = False

    def close_group(self) -> None:
        if self.group and not self.lists and not self.tables:
            self.emit("\n".join(self.group))
            self.group = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip.append(tag)
        elif self.skip:
            return
        elif tag == "br":
            self.line += "\n" if self.pre else " "
        elif tag == "img":
            self.line += f" {dict(attrs).get('alt') or ''} "
        elif tag in ("td", "th"):
            self._cell()
            self.cells = [] if self.cells is None else self.cells
            self.line = ""
        elif tag == "title":
            self.flush()
        elif self.tables and tag not in ("table", "tr"):
            self.line += " "  # blocks inside a cell are its text
        elif tag in HEADINGS or tag in BLOCKS:
            self.flush()
            self.heading = HEADINGS.get(tag, 0)
            if tag in ("ul", "ol"):
                self.lists.append([tag == "ol", 0, True])
            elif tag == "li" and self.lists:
                self.lists[-1][1] += 1
                self.lists[-1][2] = True
            elif tag == "table":
                self.tables += 1
                self.first_row = True
            elif tag == "tr":
                self._row()
            elif tag == "hr":
                self.emit("---")
            self.pre = tag == "pre" or (self.pre and tag not in BLOCKS)
            self.line = "> " if tag == "blockquote" else ""

    def _cell(self) -> None:
        if self.cells is not None:
            text = " ".join(self.line.split())
            if text or self.open_cell:
                self.cells.append(text.replace("|", "\\|") or " ")
        self.open_cell, self.line = True, ""

    def _row(self) -> None:
        if self.cells is not None:
            self._cell()
            if self.cells:
                self.group.append("| " + " | ".join(self.cells) + " |")
                if self.first_row:
                    self.group.append("| " + " | ".join(["---"] * len(self.cells)) + " |")
                    self.first_row = False
        self.cells, self.open_cell, self.line = None, False, ""

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
        elif self.skip:
            return
        elif tag == "title":
            self.title, self.line = " ".join(self.line.split("|")[0].split()), ""
        elif tag == "tr" or tag == "table":
            self._row()
            if tag == "table" and self.tables:
                self.tables -= 1
                self.close_group()
        elif self.tables:
            return
        elif tag == "dt":
            self.term, self.line = " ".join(self.line.split()), ""
        elif tag == "dd":
            self.emit(f"- **{self.term}**: {' '.join(self.line.split())}")
            self.line = ""
        elif tag in HEADINGS or tag in BLOCKS:
            self.flush()
            self.heading, self.pre = 0, False
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.close_group()

    def handle_data(self, data):
        if not self.skip:
            self.line += data

    def finish(self) -> None:
        self._row()
        self.flush()
        self.lists, self.tables = [], 0
        self.close_group()


def walk(html: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(title, [(breadcrumb, block)]); the breadcrumb is the title where no heading is open."""
    w = _Walk()
    w.feed(html or "")
    w.close()
    w.finish()
    return w.title, [(crumb or w.title, block) for crumb, block in w.out]


@F.udtf(returnType="seq int, level int, text string")
class PageEvents:
    """A page's headings (level 1 to 6), blocks (level 0) and title (level -1, first), in their order."""

    def eval(self, html: str):
        w = _Walk()
        w.feed(html or "")
        w.close()
        w.finish()
        yield 0, -1, w.title
        for seq, (level, text) in enumerate(w.events, 1):
            yield seq, level, text


def page_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, level, text, breadcrumb) of the headings and blocks of pages (key, html), from a lateral join with the pages' events.

    The breadcrumb: of each level the last title so far, if none of a level above came after it; the page's title where no heading is open.
    """
    events = pages.select(key, "html").lateralJoin(PageEvents(F.col("html").outer())).drop("html")
    so_far = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = {k: F.max(F.when(F.col("level") == k, F.struct("seq", "text"))).over(so_far) for k in (-1, *HEADINGS.values())}
    rows = events.withColumns({f"_{k}": c for k, c in at.items() if k > 0} | {"_title": at[-1]})
    trail, above = [], F.lit(-1)
    for k in HEADINGS.values():
        mine = F.coalesce(F.col(f"_{k}").seq, F.lit(-1))
        trail.append(F.when(mine > above, F.col(f"_{k}").text))
        above = F.greatest(above, mine)
    trail = F.array_compact(F.array(*trail))
    crumb = F.when(F.size(trail) > 0, F.array_join(trail, " > ")).otherwise(F.col("_title").text)
    return rows.where("level >= 0").select(key, "seq", "level", "text", crumb.alias("breadcrumb"))


def packed(blocks: list[tuple[str, str]], target: int = 1000, hard: int = 1500) -> list[tuple[str, str]]:
    """Blocks under one breadcrumb joined up to the target; longer ones cut at the hard limit."""
    out: list[tuple[str, str]] = []
    for crumb, block in blocks:
        for part in (block[i : i + hard] for i in range(0, len(block), hard)):
            if out and out[-1][0] == crumb and len(out[-1][1]) + len(part) < target:
                out[-1] = (crumb, out[-1][1] + "\n" + part)
            else:
                out.append((crumb, part))
    return out


def pages_to_chunks(pages: DataFrame) -> DataFrame:
    """page_id, title, seq, breadcrumb, chunk of pages (page_id, html)."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"]):
                title, blocks = walk(html)
                rows += [(page, title, i, crumb, text) for i, (crumb, text) in enumerate(packed(blocks))]
            yield pd.DataFrame(rows, columns=["page_id", "title", "seq", "breadcrumb", "chunk"])

    return pages.mapInPandas(chunks, "page_id long, title string, seq int, breadcrumb string, chunk string")
