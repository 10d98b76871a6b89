"""RDF/XML record files: one file is one record; what can't be parsed becomes a row with an error.

Elements are matched by local name. Well-formed records could be read by Spark's `xpath`, but that fails the
job on the first malformed file, so files are parsed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
import re
from pyspark.sql import DataFrame, SparkSession

from .io import LISTS, RECORD

LANG = "{http://www.w3.org/XML/1998/namespace}lang"
TITLE = "{http://purl.org/dc/elements/1.1/}title"
PUBLICATION = {
    "journal": "publicationName",
    "publisher": "publisher",
    "publication_date": "publicationDate",
    "volume": "volume",
    "issue": "number",
    "start_page": "startingPage",
    "end_page": "endingPage",
}


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ElementTree.Element | None) -> str | None:
    return e.text.strip() or None if e is not None and e.text else None


def plain(text: str | None) -> str | None:
    """References resolved, then tags out, then one spacing; None if nothing is left."""
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", unescape(text))).strip() or None if text else None


def parse(content: bytes) -> dict:
    """The fields of one record; raises on malformed XML."""
    by_name: dict[str, list[ElementTree.Element]] = {}
    root = ElementTree.fromstring(content)
    for e in root.iter():
        by_name.setdefault(_name(e.tag), []).append(e)
    row: dict = dict.fromkeys(f.name for f in RECORD)
    titles = [e for e in by_name.get("title", ()) if e.tag == TITLE]
    titles.sort(key=lambda e: e.get(LANG) == "en")  # stable: the first that isn't declared English, else the first
    row["title"] = _text(titles[0]) if titles else None
    typed = []  # notations of the descriptions that are abstracts
    for d in by_name.get("description", ()):
        kinds = [(_text(c) or "").lower() for c in d if _name(c.tag) == "type"]
        if "abstract" in kinds[-1:]:
            typed += [c for c in d if _name(c.tag) == "notation"][-1:]
    notations = by_name.get("notation", [])
    row["abstract"] = next((plain(e.text) for e in [*typed, *notations] if e.text), None)
    languages = [(_text(e) or "").lower() for e in by_name.get("language", ())]
    languages += [(e.get(LANG) or "").lower() for e in [*typed, *notations]]
    row["language"] = next(filter(None, languages), None)
    for column, name in (("created_at", "createdAt"), ("modified_at", "modifiedAt")):
        found = [_text(e) for e in by_name.get(name, ()) if e.text]
        row[column] = found[-1] if found else None
    names, places = [], []
    for creator in by_name.get("creator", ()):
        for e in creator.iter():
            local, value = _name(e.tag), _text(e)
            if value and local == "personName":
                names.append(value)
            elif value and local == "affiliationName":
                places.append(value)
    row["authors"], row["affiliations"] = names or None, places or None
    for e in by_name.get("identifier", ()):
        kind = next((v for k, v in e.attrib.items() if _name(k) == "datatype"), "")
        if "DOI" in kind and _text(e):
            row["doi"] = _text(e)
            break
    for p in by_name.get("publication", [])[:1]:
        for column, name in PUBLICATION.items():
            row[column] = next((_text(e) for e in p.iter() if _name(e.tag) == name and _text(e)), None)
    topics = [v for e in by_name.get("topic", ()) for k, v in e.attrib.items() if _name(k) == "title" and v]
    row["topics"] = topics or None
    row["related_titles"] = [t for t in map(_text, by_name.get("relatedTitle", ())) if t] or None
    return row


def parse_or_error(path: str, content: bytes) -> dict:
    try:
        row = parse(bytes(content))
    except Exception as e:  # an unreadable record is data: its row says why
        row = dict.fromkeys(f.name for f in RECORD) | {"error": f"{type(e).__name__}: {e}"}
    return row | {"file": path}


def parse_records(files: DataFrame) -> DataFrame:
    """Rows of RECORD from (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_or_error(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[f.name for f in RECORD])

    return files.select("path", "content").mapInPandas(run, RECORD)


def read_records(spark: SparkSession, root: str, pattern: str = "*.rdf") -> DataFrame:
    """All record files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return parse_records(files)


__all__ = ["LISTS", "parse", "parse_or_error", "parse_records", "plain", "read_records"]
