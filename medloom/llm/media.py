"""Media columns: interleaved sequences of text and media.

`sequences` parses HTML to an ordered array of items: pieces of text, and references to media by
digest with a caption. `store` keeps bytes as an image of 8-bit samples (a P6 pixel map, 64 pixels
of three samples a row, so 192 bytes are a row) and `load` reads them back. `resolve` joins the
references with a table of media by digest and puts each result at its item's position, so text,
media and captions stay aligned.

The query stores each whole text as an image, refers to it from a small page and resolves the
reference. Payloads never enter a shuffle: images are described where they are read, and one
description for each digest meets the references. Copies share a digest; their descriptions are
merged before the join, and the join's hot side can be split by Spark.

Edge cases: a null text is an empty text and has one row of 192 spaces; a reference without a
known digest keeps its item with a null payload; a null page has no items; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medloom.llm.common import arrow_map, prepare

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
PREFIX = "sha256:"
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEM_DDL = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "td", "tr", "article", "section", "figure", "header", "footer", "nav", "ul", "ol", "table", "blockquote", "pre", "body", "title"}
MEDIA = {"img", "video", "audio", "source"}


class _Sequence(HTMLParser):
    """Collects the items of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag == "figure":
            self.flush()
            self.figures.append({"media": [], "caption": None})
        elif tag in MEDIA:
            given = dict(attrs)
            source = given.get("src") or ""
            self.flush()
            item = {"kind": "media", "digest": source.removeprefix(PREFIX) if source.startswith(PREFIX) else source or None, "caption": given.get("alt") or None}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split()) or None
            self.caption = None
            if self.figures:
                self.figures[-1]["caption"] = caption
        elif tag == "figure" and self.figures:
            self.flush()
            figure = self.figures.pop()
            for item in figure["media"]:
                item["caption"] = figure["caption"] or item["caption"]
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page in order; a figure's caption goes to the media in it."""
    if not html:
        return []
    page = _Sequence()
    page.feed(html)
    page.close()
    page.flush()
    while page.figures:
        figure = page.figures.pop()
        for item in figure["media"]:
            item["caption"] = figure["caption"] or item["caption"]
    return [{"position": i, "kind": x["kind"], "text": x.get("text"), "digest": x.get("digest"), "caption": x.get("caption")} for i, x in enumerate(page.items)]


def sequences(pages: DataFrame, key: str = "doc_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in carry, and items: the ordered array of the page's text and media."""
    kinds = dict(pages.dtypes)

    def run(batch):
        items = pa.array([parse(x) for x in batch.column(1).to_pylist()], pa.list_(ITEM))
        return {key: batch.column(0), "items": items} | {c: batch.column(2 + i) for i, c in enumerate(carry)}

    more = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return arrow_map(pages.select(key, F.col(html).alias("_html"), *carry), run, f"`{key}` {kinds[key]}, items array<{ITEM_DDL}>{more}")


def references(found: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each media item of the sequences: key, position, digest, caption."""
    item = F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item")
    return found.select(key, *carry, item).select(key, *carry, "item.position", "item.digest", "item.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """Each reference with the columns of the media of its digest, nulls where there is none.
    media may hold a digest several times; one row of each is used."""
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return refs.join(media.dropDuplicates(["digest"]).repartition(n), "digest", "left")


def interleave(found: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and items of each row of found, each item with `media`, a struct of its resolved media's
    columns. A sequence is told by its key, null or not, and a hash of its items: rows with one key
    and different items stay apart, equal rows give equal rows."""
    columns = [c for c in media.columns if c != "digest"]
    shown = F.to_json(F.struct("items"))
    rows = found.select(F.col(key).alias("_key"), "items", F.xxhash64(shown).alias("_s1"), F.xxhash64(F.lit("items"), shown).alias("_s2"))
    at = ["_key", "_s1", "_s2"]
    each = rows.dropDuplicates(at).select(*at, F.explode("items").alias("item")).select(*at, "item", F.col("item.digest").alias("digest"))
    renamed = media.select("digest", *[F.col(c).alias(f"_media_{i}") for i, c in enumerate(columns)])
    payload = F.struct(*[F.col(f"_media_{i}").alias(c) for i, c in enumerate(columns)])
    resolved = resolve(each, renamed).withColumn("media", F.when(F.col("item.kind") == "media", payload))
    ordered = resolved.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(F.col("item.position").alias("position"), "item", "media"))).alias("_items"))
    ordered = ordered.select(*[F.col(c).alias(f"_o{c}") for c in at], "_items")
    same = F.col("_key").eqNullSafe(F.col("_o_key")) & (F.col("_s1") == F.col("_o_s1")) & (F.col("_s2") == F.col("_o_s2"))
    return rows.join(ordered, same, "left").select(F.col("_key").alias(key), F.coalesce("_items", F.array()).alias("items"))


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of a row."""
    rows = max(1, -(-len(data) // ROW))
    return data + b" " * (rows * ROW - len(data))


def store(payload: bytes) -> bytes:
    """A pixel map whose samples are the payload's bytes."""
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW) + payload


def load(media: bytes) -> bytes:
    """The samples of a pixel map."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or most != b"255" or len(samples) != width * height * CHANNELS:
        raise ValueError("not a pixel map of 8-bit samples")
    return samples


def feature(payload: bytes) -> str:
    """Mean of each channel and entropy of the samples, to four places."""
    samples = np.frombuffer(payload, np.uint8)
    mean = samples.reshape(-1, CHANNELS).mean(0)
    share = np.bincount(samples, minlength=256)
    share = share[share > 0] / len(samples)
    return ",".join(f"{x:.4f}" for x in (*mean, float(-(share * np.log2(share)).sum()) + 0.0))


def stored_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """For each row a page that refers to the stored text, and what reading the stored form back
    gives; the stored form itself as `media` if keep_media."""

    def run(batch):
        out: dict[str, list] = {c: [] for c in ("html", "digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            media = store(pad(data))
            back = load(media)
            digest = hashlib.sha256(media).hexdigest()
            caption = f"text of document {doc_id}"
            row = {
                "html": f'<article><h1>{escape(caption)}</h1><figure><img src="{PREFIX}{digest}" alt="stored text"><figcaption>{escape(caption)}</figcaption></figure></article>',
                "digest": digest, "n_bytes": len(data), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]),
                "media_bytes": len(media), "media_sha256": digest, "feature": feature(back), "media": media if keep_media else None,
            }
            for c, own in out.items():
                own.append(row[c])
        made = {c: pa.array(v, pa.binary() if c == "media" else pa.string() if isinstance(v[0], str) else pa.int64()) for c, v in out.items() if c != "media" or keep_media}
        return {"doc_id": batch.column(0)} | made

    ddl = "doc_id bigint, html string, digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, ddl + ", media binary" * keep_media)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as media, referred to from its page and resolved by digest."""
    prepare(docs.sparkSession)
    stored = stored_texts(docs).checkpoint()
    refs = references(sequences(stored, carry=("n_bytes",)), carry=("n_bytes",))
    media = stored.select("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return resolve(refs, media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def illustrated_pages(pages: DataFrame, docs: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages as interleaved sequences: each raw page shows, after its own content, the stored text of
    the document with its key (a reference that leads nowhere if there is none, and to the least of
    several). The sequence's items are resolved by digest and stay in order: key, number of items, of
    media and of resolved media, characters of text, and a digest of the whole sequence (kind, text
    or payload, caption of each item)."""
    prepare(pages.sparkSession)
    stored = stored_texts(docs).select("doc_id", "digest", "payload_sha256", "media_bytes").checkpoint()
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shown = stored.groupBy("doc_id").agg(F.min("digest").alias("_digest")).where("doc_id is not null").repartition(n)
    rows = pages.select(F.col(key).cast("bigint").alias(key), F.col(html).alias("_page"))
    figure = F.concat(F.lit(f'<figure><img src="{PREFIX}'), F.coalesce("_digest", F.lit("none")), F.lit('"><figcaption>text of page '), F.coalesce(F.col(key).cast("string"), F.lit("none")), F.lit("</figcaption></figure>"))
    whole = rows.join(shown, F.col(key) == F.col("doc_id"), "left").select(key, F.concat(F.coalesce("_page", F.lit("")), figure).alias("html"))
    items = interleave(sequences(whole, key), stored.drop("doc_id"), key)
    media = F.filter("items", lambda x: x["item"]["kind"] == "media")
    line = F.transform("items", lambda x: F.concat_ws("\t", x["item"]["kind"], F.coalesce(x["item"]["text"], x["media"]["payload_sha256"], F.lit("")), F.coalesce(x["item"]["caption"], F.lit(""))))
    return items.select(
        key, F.size("items").cast("bigint").alias("n_items"), F.size(media).cast("bigint").alias("n_media"), F.size(F.filter(media, lambda x: x["media"]["payload_sha256"].isNotNull())).cast("bigint").alias("n_resolved"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x["item"]["text"]), F.lit(0))).alias("n_chars"), F.sha2(F.array_join(line, "\n"), 256).alias("sequence_sha256"),
    )
