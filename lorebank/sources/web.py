"""Web search and page fetching over injected functions: this library has no network of its own.

An engine is a function of (query, language) that gives urls, a fetcher one of a url that gives its html; both may raise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.model import Limited
from . import html

#: Urls taken of one query, tries of an engine, and its first pauses after a refusal and after another error.
PER_QUERY, TRIES, REFUSED, FAILED = 5, 3, 3.0, 2.0
Engine = Callable[[str, str], Iterable[str]]


def found(query: str, lang: str, engines: tuple[Engine, ...], sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """The first PER_QUERY urls of the first engine that gives any. Each is tried TRIES times, with doubled pauses; the error
    of the last one is raised if all failed."""
    error: Exception | None = None
    for engine in engines:
        for k in range(TRIES):
            try:
                urls = list(islice(engine(query, lang), PER_QUERY))
                error = None
                break
            except Exception as e:
                urls, error = [], e
                if k < TRIES - 1:
                    sleep((REFUSED if isinstance(e, Limited) else FAILED) * 2**k)
        if urls:
            return urls
    if error is not None:
        raise error
    return []


def search(queries: DataFrame, *engines: Engine, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(query, lang, rank, url, error) of queries (q, lang): the first PER_QUERY urls of each; a query that fails has one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for q, lang in zip(frame["q"], frame["lang"], strict=True):
                try:
                    rows += [(q, lang, i, u, None) for i, u in enumerate(found(q, lang, engines, sleep))]
                except Exception as e:
                    rows.append((q, lang, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["query", "lang", "rank", "url", "error"])

    return queries.select("q", "lang").distinct().mapInPandas(run, "query string, lang string, rank int, url string, error string")


def fetch(urls: DataFrame, fetcher: Callable[[str], str]) -> DataFrame:
    """(url, html, error) of each different url that is not on a blocked host; a page that fails has its error and no html."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for u in frame["url"]:
                try:
                    rows.append((u, fetcher(u), None))
                except Exception as e:
                    rows.append((u, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    some = urls.select("url").where(F.col("url").isNotNull() & ~T.blocked(F.col("url"))).distinct()
    return some.mapInPandas(run, "url string, html string, error string")


def facts_of(queries: DataFrame, fetcher: Callable[[str], str], *engines: Engine, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, pos, sentence, hash) of all that a search finds, each sentence once, at its first url and place."""
    pages = fetch(search(queries, *engines, sleep=sleep).select("url"), fetcher).select(F.col("url").alias("page_id"), "url", "html")
    return html.page_sentences(pages).select(F.col("page_id").alias("url"), "pos", "sentence", "hash")
