"""Papers from a public Atom feed: listing by subject, download, and the checks that a file must pass."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.pages import Extract, extractors, page_texts

Fetch = Callable[[str], bytes]
# The feed's public address and name space, its subjects, and the pages above which a paper is left out.
FEED = "http://export.arxiv.org/api/query"
ATOM = "{http://www.w3.org/2005/Atom}"
CATEGORIES = ("cs.AI", "cs.CL", "cs.LG", "cs.IR")
PER_REQUEST, MAX_PAGES, PAUSE = 50, 30, 3.0


def fetch(url: str) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": "quire/1"})
    with urllib.request.urlopen(request, timeout=30) as answer:
        return answer.read()


def entries(feed: bytes) -> list[tuple[str, str, str]]:
    """``(arxiv_id, title, url)`` of a feed's entries; an entry without a PDF link gets the usual address."""
    found = []
    for entry in ElementTree.fromstring(feed).iter(f"{ATOM}entry"):
        name = (entry.findtext(f"{ATOM}id") or "").rpartition("/abs/")[2].replace("/", "_")
        title = " ".join((entry.findtext(f"{ATOM}title") or "").split())
        links = (link.get("href") for link in entry.iter(f"{ATOM}link") if link.get("type") == "application/pdf")
        found.append((name, title, next(links, None) or f"https://arxiv.org/pdf/{name}"))
    return found


def list_papers(spark: SparkSession, count: int, categories: tuple[str, ...] = CATEGORIES, get: Fetch = fetch, pause: float = PAUSE) -> DataFrame:
    """``(category, arxiv_id, title, url, error)``: the latest papers of each category, ``PER_REQUEST`` a request.

    The requests run in one task, a pause behind each, as the service asks; one that fails is a row
    with ``error``. A paper in several categories comes out under each.
    """
    asked = [(c, at, f"{FEED}?search_query=cat:{c}&start={at}&max_results={min(PER_REQUEST, count - at)}&sortBy=submittedDate&sortOrder=descending") for c in categories for at in range(0, count, PER_REQUEST)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for category, url in zip(batch["category"], batch["url"]):
                try:
                    rows = [(category, *entry, None) for entry in entries(get(url))]
                except Exception as error:
                    rows = [(category, None, None, None, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["category", "arxiv_id", "title", "url", "error"])
                time.sleep(pause)

    pages = spark.createDataFrame(asked, "category string, at int, url string").coalesce(1)
    return pages.mapInPandas(run, "category string, arxiv_id string, title string, url string, error string")


def download(
    papers: DataFrame, get: Fetch = fetch, pause: float = PAUSE, max_pages: int = MAX_PAGES, readers: Callable[[], list[Extract]] = extractors, tasks: int = 1
) -> DataFrame:
    """``(arxiv_id, content, pages, error)`` of ``papers(arxiv_id, url)``, each id once.

    ``tasks`` downloads run side by side. What is no PDF by its first bytes, has more than ``max_pages``
    pages or cannot be fetched has ``error`` and no content; a PDF that no reader opens has 0 pages.
    Write the result to a table before it is used twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, url in zip(batch["arxiv_id"], batch["url"]):
                content, pages, problem = None, None, None
                try:
                    content = get(url)
                    if b"%PDF" not in content[:10]:
                        raise ValueError("not a PDF file")
                    try:
                        pages = len(page_texts(content, readers()))
                    except Exception:
                        pages = 0
                    if pages > max_pages:
                        raise ValueError(f"more than {max_pages} pages")
                except Exception as error:
                    content, problem = None, f"{type(error).__name__}: {error}"
                frame = pd.DataFrame([(name, content, pages, problem)], columns=["arxiv_id", "content", "pages", "error"])
                yield frame.astype({"pages": "Int32"})
                time.sleep(pause)

    once = papers.where("arxiv_id is not null and url is not null").groupBy("arxiv_id").agg(F.min("url").alias("url"))
    return once.repartition(tasks).mapInPandas(run, "arxiv_id string, content binary, pages int, error string")
