"""Media columns: interleaved sequences of text and media references.

An HTML page is parsed into an ordered array of items (text, or a reference with digest and caption).  Payloads live
once in a content-addressed store (PNG, 8-bit grey samples); references resolve by a join on the digest, in which a
payload never travels: what is computed from it does.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_text

_ITEMS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def _chunk(tag: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(tag)))


def png_of(payload: bytes) -> bytes:
    """Lossless 8-bit grey image of 64 samples a row; the payload's length is a positive multiple of 64."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # filter byte 0 before each row
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples_of(png: bytes) -> np.ndarray:
    """The samples (rows, width) of an image written by png_of."""
    at, data, shape = 8, [], (0, 0)
    while at < len(png):
        size, tag = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif tag == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 if data else 64)


def features_of(samples: np.ndarray) -> str:
    """Shape, mean, deviation, mean step between neighbours, and an 8-bin histogram, as text."""
    x = samples.astype(np.int64).ravel()
    hist = np.bincount(x >> 5, minlength=8)
    steps = int(np.abs(np.diff(x)).sum())
    mean, square = x.sum() / len(x), (x * x).sum() / len(x)
    return f"{samples.shape[1]}x{samples.shape[0]};{mean:.6f};{max(square - mean * mean, 0) ** 0.5:.6f};{steps / max(1, len(x) - 1):.6f};" + ",".join(map(str, hist.tolist()))


class _Sequence(HTMLParser):
    """Text and references in document order; a figcaption, or else the alternative text, is a reference's caption."""

    _BREAKS = {"p", "div", "h1", "h2", "h3", "li", "br", "figure", "article", "section", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self._text, self._skip, self._caption, self._figure = [], [], 0, None, None

    def _flush(self):
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.items.append([len(self.items), "text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "figure":
            self._flush()
            self._figure = len(self.items)
        elif tag == "figcaption":
            self._caption = []
        elif tag in ("img", "audio", "video"):
            a = dict(attrs)
            self._flush()
            digest = (a.get("src") or "").removeprefix("media:")
            self.items.append([len(self.items), "media", None, digest, a.get("alt")])
        elif tag in self._BREAKS:
            self._flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag == "figcaption" and self._caption is not None:
            caption, self._caption = " ".join("".join(self._caption).split()), None
            for item in self.items[self._figure or 0 :]:
                if item[1] == "media":
                    item[4] = caption
        elif tag in self._BREAKS:
            self._flush()

    def handle_data(self, data):
        if self._caption is not None:
            self._caption.append(data)
        elif not self._skip:
            self._text.append(data)

    def done(self):
        self.close()
        self._flush()
        return [tuple(i) for i in self.items]


def sequence_of(page: str | None) -> list[tuple]:
    parser = _Sequence()
    parser.feed(page or "")
    return parser.done()


def parse_pages(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """(key, items): the ordered items of each page.  Null or empty pages have no items; repeated rows stay."""

    def run(batches):
        for b in batches:
            items = [[{"pos": i[0], "kind": i[1], "text": i[2], "digest": i[3], "caption": i[4]} for i in sequence_of(p)] for p in b[html_col]]
            yield pd.DataFrame({key: b[key], "items": items})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html_col).mapInPandas(run, f"{key} {kind}, items {_ITEMS}")


def store_features(store: DataFrame) -> DataFrame:
    """Reads each stored image back: one row of figures per digest.  A digest stored twice gives equal figures."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, media in zip(b["digest"], b["media"], strict=True):
                samples = samples_of(media)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features_of(samples)))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = store.mapInPandas(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*[F.min(c).alias(c) for c in read.columns[1:]])


def resolve(sequences: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, pos, caption, digest, and the figures of its payload (null if unknown)."""
    refs = sequences.select(key, F.explode("items").alias("i")).filter("i.kind = 'media'")
    refs = refs.select(key, F.col("i.pos").alias("pos"), F.col("i.caption").alias("caption"), F.col("i.digest").alias("digest"))
    return refs.join(figures, "digest", "left")


def media_columns(documents: DataFrame) -> DataFrame:
    """The op5 query: each text becomes a page with one figure; its payload goes to the store and is read back.

    One row per row of documents; null text is empty (64 zero bytes); repeated rows give equal rows; an empty table
    gives an empty result.
    """

    def write(batches):
        for b in batches:
            rows, seen = [], set()
            for text, doc in zip(b["text"], b["doc_id"].astype("Int64"), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                page = f'<article><h1>{doc}</h1><figure><img src="media:{digest}"><figcaption>{html.escape(str(len(data)))}</figcaption></figure></article>'
                rows.append((doc, page, digest, None if digest in seen else png_of(payload)))
                seen.add(digest)
            out = pd.DataFrame(rows, columns=["doc_id", "page", "digest", "media"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    made = documents.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(write, "doc_id long, page string, digest string, media binary")
    stored = materialize(made, "media")
    figures = store_features(stored.filter("media IS NOT NULL").select("digest", "media"))
    pages = stored.select("doc_id", "page")
    refs = resolve(parse_pages(pages, "doc_id", "page"), figures, "doc_id")
    return refs.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
