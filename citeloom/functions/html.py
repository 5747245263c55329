"""STR20: metadata of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Meta elements that are read, by name and by property.
NAMES = ["description", "keywords", "author"]
PROPERTIES = ["og:title", "og:description", "og:type"]
MOST = 1_000_000


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.got: dict[str, str] = {}
        self.links: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.in_title = "title" not in self.got
        elif tag == "meta":
            key = a.get("name", "").lower() if a.get("name", "").lower() in NAMES else a.get("property", "").lower()
            if key in NAMES + PROPERTIES and a.get("content"):
                self.got.setdefault(key.replace(":", "_"), a["content"])
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            self.got.setdefault("canonical", a["href"])
        elif tag == "html" and a.get("lang"):
            self.got.setdefault("lang", a["lang"])
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])

    def handle_endtag(self, tag: str) -> None:
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.got["title"] = (self.got.get("title", "") + data).strip()


def read_page(html: str | None) -> dict:
    """Metadata and links of the first million characters; an empty map for null or no HTML."""
    reader = _Reader()
    reader.feed((html or "")[:MOST])
    return {"meta": list(reader.got.items()), "links": reader.links}


@F.pandas_udf(T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))]))
def page_metadata(html: pd.Series) -> pd.DataFrame:
    """Over a column."""
    got = [read_page(h) for h in html]
    return pd.DataFrame({"meta": [dict(g["meta"]) for g in got], "links": [g["links"] for g in got]})
