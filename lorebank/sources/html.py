"""Text and sentences of pages: the fetch step's extraction over a table of pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Elements whose text is dropped.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript"))


class _Reader(HTMLParser):
    """Collects text by element, so that the best container can be chosen: article, main, a named one, or the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.text: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: [], 4: []}

    @staticmethod
    def rank(tag: str, attrs: dict[str, str | None]) -> int:
        if tag in ("article", "main"):
            return 0 if tag == "article" else 1
        if re.search("content|body|article", attrs.get("id") or ""):
            return 2
        return 3 if re.search("content|body|article|post", attrs.get("class") or "") else 4

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.open.append((tag, self.rank(tag, dict(attrs))))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not any(t in DROPPED for t, _ in self.open):
            for r in {4, *(r for _, r in self.open)}:
                self.text[r].append(data)

    def best(self) -> str:
        return next((x for x in (" ".join(" ".join(self.text[r]).split()) for r in range(5)) if x), "")


def read(page: str | None) -> str:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader.best()


def _text(x: pd.Series) -> pd.Series:
    return x.map(read)


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the whitespace-collapsed text of the page's main container; empty for a null page."""
    return pages.select("page_id", "url", F.pandas_udf(_text, "string")("html").alias("text"))


#: Fixed value: sentences taken of one page, a feature of the fetch step.
PER_PAGE = 15


def page_sentences(pages: DataFrame) -> DataFrame:
    """page_id, pos, sentence, hash: the first sentences of pages on hosts that are not blocked; the first of equal ones stays."""
    rows = page_text(pages).where(~T.blocked(F.col("url"))).select("page_id", F.posexplode(T.sentences(F.col("text"), cap=PER_PAGE)).alias("pos", "sentence"))
    rows = rows.withColumn("hash", F.substring(F.md5("sentence"), 1, 12))
    first = Window.partitionBy("hash").orderBy("page_id", "pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
