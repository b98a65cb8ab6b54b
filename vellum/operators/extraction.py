"""Content from text: overlapping chunks and chunk vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.checks import low_text, low_text_type

MARKS = (". ", "! ", "? ", "\n\n", "\n")
REACH = 100


def cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Pieces of a text with their places; each ends at a mark near its end if there is one. A text of up to ``size`` is one piece as it is. The overlap must leave at
    least ``REACH`` characters of a piece to itself, and a last piece that lies within the one before is left out."""
    if overlap >= size - REACH:
        raise ValueError(f"an overlap of {overlap} is too much for pieces of {size}")
    if len(text) <= size:
        if text.strip():
            yield 0, text
        return
    start, end = 0, 0
    while end < len(text):
        before, end = end, min(start + size, len(text))
        if end < len(text):
            ends = ((text.rfind(m, max(start, end - REACH), end), len(m)) for m in MARKS)
            end = next((at + n for at, n in ends if at >= 0), end)
        whole = text[start:end].lstrip()
        if end > before and (piece := whole.rstrip()):
            yield end - len(whole), piece
        start = max(end - overlap, start + 1)


@F.udtf(returnType="chunk_index bigint, start bigint, chunk string", useArrow=True)
class Cuts:
    """Table function over (text, size, overlap): a row for each piece. A cut depends on the one before, so it is a loop over one text; a text's pieces are
    handed over as they come."""

    def eval(self, text: str, size: int, overlap: int):
        for n, (start, piece) in enumerate(cuts(text or "", size, overlap)):
            yield n, start, piece


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, start, chunk) of (id, text), by a lateral join with the table function; a null or blank text gives no chunk. ``start`` counts the characters before the chunk."""
    if overlap >= size - REACH:
        raise ValueError(f"an overlap of {overlap} is too much for pieces of {size}")
    rows = docs.select(F.col("id").cast("bigint").alias("id"), "text")
    return rows.lateralJoin(Cuts(F.col("text").outer(), F.lit(size), F.lit(overlap))).drop("text")


def strides(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, start, chunk) of (id, text), cut every ``size - overlap`` characters whatever stands there, by expressions only. Chunks are trimmed and blank ones
    left out, as is a last one that lies within the one before; a text of up to ``size`` is one chunk as it is. The text is cut once, and each piece takes its overlap from the next."""
    if not 0 <= overlap < size - overlap:
        raise ValueError(f"an overlap of {overlap} is too much for pieces of {size}")
    step = size - overlap
    whole = F.length("text") <= size
    pieces = F.when(whole, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    cut = docs.filter("trim(BOTH ' \t\n\r' FROM text) <> ''").select(F.col("id").cast("bigint").alias("id"), whole.alias("whole"), pieces.alias("pieces"))
    full = F.transform("pieces", lambda p, i: F.concat(p, F.substring(F.coalesce(F.get("pieces", i + 1), F.lit("")), 1, overlap)))
    rows = cut.select("id", "whole", F.posexplode(full).alias("n", "chunk")).filter((F.col("n") == 0) | (F.length("chunk") > overlap))
    chunk = F.when(F.col("whole"), F.col("chunk")).otherwise(F.trim("chunk", F.lit(" \t\n\r")))
    return rows.select("id", F.col("n").cast("bigint").alias("chunk_index"), (F.col("n") * step).cast("bigint").alias("start"), chunk.alias("chunk")).filter("chunk <> ''")


def extracted(docs: DataFrame) -> DataFrame:
    """(id, value, product_type) of documents (id, markdown, pages, total_pages, method, product_type) for ``write_texts``: a JSON document of the text with the pages that were read
    (first, last), the number of pages, the method and the number of characters. A text too short for its pages is flagged, and its product becomes art
    where it has no type. Rows without a text (the extraction failed) are left out."""
    given = docs.filter("markdown is not null")
    pages = F.greatest(F.coalesce("total_pages", F.lit(1)), F.lit(1))
    chars = F.length(F.trim("markdown", F.lit(" \t\n\r")))
    flag = F.when(low_text(chars, pages), F.lit(True))
    value = F.struct("markdown", "total_pages", F.concat_ws("-", "pages.first", "pages.last").alias("pages_extracted"), "method", F.length("markdown").alias("char_count"), flag.alias("is_low_text"), flag.alias("auto_marked_art"))
    return given.select("id", F.to_json(value).alias("value"), low_text_type(chars, pages, F.col("product_type")).alias("product_type"))


def hashed_words(texts: list[str], width: int = 64) -> list[list[float]]:
    """Unit vectors of word counts by hash; a stand-in where no encoder is given. The first 32 bits of a word's MD5 give its place and, by the highest bit, its sign; a text
    without words is a zero vector."""
    import hashlib
    from itertools import chain

    import numpy as np

    words = [t.lower().split() for t in texts]
    flat = list(chain.from_iterable(words))
    codes = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in set(flat)}
    h = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    out = np.zeros((len(texts), width))
    np.add.at(out, (np.repeat(np.arange(len(words)), [len(w) for w in words]), h % width), np.where(h >> 31, 1, -1))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1, norms)).tolist()


def encode(rows: DataFrame, column: str = "chunk", encoder: Callable[[list[str]], list[list[float]]] = hashed_words) -> DataFrame:
    """Rows with an ``embedding`` of a text column, batch by batch."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(texts.fillna("").tolist()))

    return rows.withColumn("embedding", run(column))
