"""Text of files: HTML by a small block scorer in an Arrow UDF, PDF by a pluggable extractor."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausesearch.functions.text import normalize_text

#: Elements that hold no text of the page's own.
CHROME = frozenset(["script", "style", "noscript", "nav", "header", "footer", "aside"])
BLOCKS = frozenset("p div section article main li ul ol table tr td th h1 h2 h3 h4 h5 h6 br body html blockquote pre dl dt dd form".split())
HEADER_LINE = re.compile(r"(?i)^\s*(?:art[íi]culo|art\.)\s*\d+")


class _Blocks(HTMLParser):
    """Text blocks outside chrome elements, with their lengths of link text and their container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.link, self.path = [], 0, [0]
        self.blocks: list[list] = []  # text nodes, characters in links, container
        self.count, self.fresh = 0, True

    def handle_starttag(self, tag, attrs):
        if tag in CHROME:
            self.skip.append(tag)
        if tag == "a":
            self.link += 1
        if tag in BLOCKS:
            self.fresh = True
            if tag not in ("br", "p", "td", "th", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.count += 1
                self.path.append(self.count)

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
        if tag == "a" and self.link:
            self.link -= 1
        if tag in BLOCKS:
            self.fresh = True
            if tag not in ("br", "p", "td", "th", "li", "h1", "h2", "h3", "h4", "h5", "h6") and len(self.path) > 1:
                self.path.pop()

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        if self.fresh:
            self.blocks.append([[], 0, self.path[-1]])
            self.fresh = False
        self.blocks[-1][0].append(data.strip())
        self.blocks[-1][1] += len(data.strip()) * (self.link > 0)


def html_main_text(html: str | None) -> str | None:
    """The main text of a page: blocks of the containers that hold most of the running text.

    Falls back to all text outside chrome elements where no container stands out. Null stays null.
    """
    if html is None:
        return None
    parser = _Blocks()
    parser.feed(re.sub(r"\s+", " ", html))
    parser.close()
    every = "\n".join(t for b in parser.blocks for t in b[0])
    weight: dict[int, float] = {}
    for parts, linked, where in parser.blocks:
        text = " ".join(parts)
        running = len(text) - 2 * linked
        if running > 0 and (len(text) >= 60 or HEADER_LINE.match(text)):
            weight[where] = weight.get(where, 0) + running
    if not weight:
        return every
    most = max(weight.values())
    chosen = {w for w, s in weight.items() if s >= 0.15 * most}
    kept = [" ".join(p) for p, linked, where in parser.blocks if where in chosen and 2 * linked <= len(" ".join(p))]
    return "\n".join(kept) or every


def _map_text(f: Callable, kind: str) -> Callable[[Column], Column]:
    @F.arrow_udf(T.StringType())
    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in c.to_pylist()], pa.string())

    return run


def html_text(c: Column) -> Column:
    """Normalised main text of an HTML column."""
    return normalize_text(_map_text(html_main_text, "html")(c))


def extract_files(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text and error of files (path, content), dispatched by suffix.

    html and htm are decoded as UTF-8, undecodable bytes ignored; pdf goes to ``pdf`` (page texts joined by
    newlines), or to an error where none is given; other types and failing files give an error and no text.
    """

    def read(batches):
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                suffix = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
                text = error = None
                try:
                    if suffix in ("html", "htm"):
                        text = html_main_text(content.decode("utf-8", "ignore"))
                    elif suffix == "pdf" and pdf:
                        text = pdf(content)
                    else:
                        error = f"unsupported type: {suffix}"
                except Exception as failure:  # one bad file must not stop the others
                    error = f"{type(failure).__name__}: {failure}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    found = files.select("path", "content").mapInArrow(read, "path string, text string, error string")
    return found.withColumn("text", normalize_text(F.col("text")))
