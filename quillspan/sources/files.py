"""Files as sources: discovery, text extraction by suffix, sidecars and archives.

Files are listed without their content; sizes are checked before content is read, and
extraction runs per file in Arrow batches with budgets on what an archive expands to.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import universal_newlines
from quillspan.operators.web import read_page, visible_text

MAX_BYTES, MAX_TEXT = 256 << 20, 16 << 20
SUFFIXES = (".txt", ".md", ".html", ".htm", ".xhtml", ".docx", ".odt", ".epub", ".pdf")
# What a sidecar may hold.
SIDECAR_FIELDS = (
    "ignore title source source_uri trust trust_class language rights_note version version_label stale_after supersedes supersedes_item_id tags"
).split()


def list_files(spark: SparkSession, folder: str, hidden: bool = False, any_suffix: bool = False) -> DataFrame:
    """(path, length, modificationTime) of supported files, without their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    f = f.filter(~name.endswith(".meta.json"))
    if not hidden:
        f = f.filter(~F.col("path").rlike(r"/\.[^/]+"))
    if not any_suffix:
        f = f.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES))
    return f


def _member(z: zipfile.ZipFile, name: str, budget: int) -> bytes:
    info = z.getinfo(name)
    if info.file_size > budget:
        raise ValueError("archive member over its budget")
    return z.read(info)


def _blocks(xml: bytes, names: tuple[str, ...]) -> str:
    root = ElementTree.fromstring(xml)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    return "\n".join(t for e in root.iter() if local(e) in names and (t := "".join(e.itertext()).strip()))


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _blocks(_member(z, "word/document.xml", 2 * MAX_TEXT), ("p",))


def odt_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _blocks(_member(z, "content.xml", 2 * MAX_TEXT), ("p", "h"))


def epub_text(data: bytes) -> str:
    """The spine of a book in order, else its pages by name."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        pages: list[str] = []
        try:
            box = ElementTree.fromstring(_member(z, "META-INF/container.xml", 1 << 20))
            opf = next(e.attrib["full-path"] for e in box.iter() if local(e) == "rootfile")
            book = ElementTree.fromstring(_member(z, opf, 4 << 20))
            base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
            at = {e.attrib["id"]: base + e.attrib["href"] for e in book.iter() if local(e) == "item"}
            pages = [at[e.attrib["idref"]] for e in book.iter() if local(e) == "itemref" and e.attrib.get("idref") in at]
        except (KeyError, StopIteration, ElementTree.ParseError):
            pass
        pages = [p for p in pages if p in names] or sorted(n for n in names if n.lower().endswith((".html", ".xhtml", ".htm")))
        out, left = [], 6 * MAX_TEXT
        for p in pages:
            raw = _member(z, p, left)
            left -= len(raw)
            out.append(visible_text(raw.decode("utf-8", "replace")) or "")
        return "\n".join(t for t in out if t)


#: Extractors by suffix; a site may add its own (PDF and images need a library).
EXTRACTORS: dict[str, Callable[[bytes], str | None]] = {
    ".txt": lambda b: b.decode("utf-8", "replace"),
    ".md": lambda b: b.decode("utf-8", "replace"),
    ".html": lambda b: visible_text(b.decode("utf-8", "replace")),
    ".htm": lambda b: visible_text(b.decode("utf-8", "replace")),
    ".xhtml": lambda b: visible_text(b.decode("utf-8", "replace")),
    ".docx": docx_text,
    ".odt": odt_text,
    ".epub": epub_text,
}


def extract(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file; blank and oversized texts are none."""
    suffix = ".pdf" if data[:5] == b"%PDF-" else (re.search(r"\.[^./]+$", path) or [""])[0].lower()
    f = EXTRACTORS.get(suffix)
    if f is None:
        return None, None
    try:
        text = f(data)
    except Exception as e:
        return None, type(e).__name__
    if not text or not text.strip() or len(text.encode("utf-8", "replace")) > MAX_TEXT:
        return None, None
    return re.sub(r"\r\n?", "\n", text), None


def read_documents(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, sha256, bytes, text, error) of every supported file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.filter(F.col("length") <= max_bytes).filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [extract(a, bytes(c)) for a, c in zip(p.path, p.content)]
            yield pd.DataFrame({"path": p.path, "sha256": p.sha256, "bytes": p.length, "text": [t for t, _ in got], "error": [e for _, e in got]})

    rows = small.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")
    return rows.mapInPandas(run, "path string, sha256 string, bytes long, text string, error string")


def read_sidecars(spark: SparkSession, folder: str, suffix: str = ".meta.json") -> DataFrame:
    """(path of the file described, raw, unknown fields) of JSON sidecars."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("path").endswith(suffix))
    text = F.col("content").cast("string")
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, SIDECAR_FIELDS))))
    return raw.select(F.expr(f"substring(path, 1, length(path) - {len(suffix)})").alias("path"), text.alias("raw"), unknown.alias("unknown_fields"))


def described(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files (path, ...) with what their sidecars (path, raw) say, as side_* columns; a
    sidecar that can't be read says nothing and has ``side_error``."""
    fields = [f for f in SIDECAR_FIELDS if f not in ("tags", "ignore")]
    schema = ", ".join([*(f"{f} string" for f in fields), "tags array<string>", "ignore boolean", "_corrupt string"])
    said = F.from_json("raw", schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    s = sidecars.withColumn("said", said).select(
        "path", *[F.col(f"said.{f}").alias(f"side_{f}") for f in (*fields, "tags", "ignore")], (F.col("raw").isNotNull() & F.col("said._corrupt").isNotNull()).alias("side_error")
    )
    out = files.join(s, "path", "left").withColumn("ignore", F.coalesce("side_ignore", F.lit(False)))
    return out.withColumn("side_trust", F.coalesce("side_trust_class", "side_trust"))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is none has nulls and its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_entities(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, rows of the schema): one JSON document a file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    return raw.select("path", F.from_json(F.col("content").cast("string"), schema).alias("e")).select("path", "e.*")


def pack_payload_codes(spark: SparkSession, folder: str) -> DataFrame:
    """(code, sha256) of an exported pack folder: a manifest that is missing or none, and
    members whose payload is missing or not what its name says. Payloads are hashed where
    they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    manifest = files.filter(F.col("path").rlike(r"/manifest\.json$")).select(
        F.from_json(F.col("content").cast("string"), "members array<struct<item_id: string, sha256: string>>").alias("m")
    )
    stored = files.filter(F.col("path").rlike(r"/objects/sha256/[0-9a-f]{2}/[0-9a-f]{64}$")).select(
        F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("sha256"), F.sha2("content", 256).alias("real")
    )
    wanted = manifest.select(F.explode("m.members").alias("x")).select("x.sha256").filter("sha256 rlike '^[0-9a-f]{64}$'").distinct()
    code = F.when(F.col("real").isNull(), "missing_export_payload").when(F.col("real") != F.col("sha256"), "export_payload_checksum_mismatch")
    bad = wanted.join(stored, "sha256", "left").select(code.alias("code"), "sha256").filter("code is not null")
    none = F.when(F.col("n") == 0, "missing_manifest").when(F.col("ok") == 0, "invalid_manifest_json")
    whole = manifest.agg(F.count("*").alias("n"), F.count("m.members").alias("ok")).select(none.alias("code"), F.lit(None).cast("string").alias("sha256"))
    return bad.unionByName(whole.filter("code is not null"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _first_text(node: ElementTree.Element, names: tuple[str, ...]) -> str:
    texts = (" ".join("".join(x.itertext()).split()) for x in node.iter() if _local(x.tag) in names)
    return next((t for t in texts if t), "")


def shelf_results(xml: str, endpoint: str) -> list[tuple[str, str, str]]:
    """(title, address, summary) of the entries of an XML search response that have both."""
    out = []
    for node in ElementTree.fromstring(xml).iter():
        if _local(node.tag) not in ("entry", "item", "result"):
            continue
        links = (x.attrib.get("href", "").strip() or " ".join("".join(x.itertext()).split()) for x in node.iter() if _local(x.tag) == "link")
        title, href = _first_text(node, ("title",)), next((h for h in links if h), "") or _first_text(node, ("url", "uri"))
        if title and href:
            out.append((title, urljoin(endpoint.rstrip("/") + "/", href), _first_text(node, ("summary", "description", "snippet", "content"))))
    return out


def read_shelf_results(raw: DataFrame, endpoint: str) -> DataFrame:
    """(book, position, title, uri, summary) of XML responses (book, body); a body that
    can't be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for book, body in zip(p.book, p.body):
                try:
                    rows += [(book, i, *r) for i, r in enumerate(shelf_results(body, endpoint))]
                except (ElementTree.ParseError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["book", "position", "title", "uri", "summary"])

    return raw.select("book", "body").mapInPandas(run, "book string, position int, title string, uri string, summary string")


# Where a format keeps its own title, author and language.
_CORE = {"title": "emb_title", "creator": "emb_author", "language": "emb_language"}


def embedded_metadata(path: str, data: bytes) -> dict[str, str | None]:
    """emb_title, emb_author and emb_language of a file; null where it has none."""
    out: dict[str, str | None] = {k: None for k in _CORE.values()}
    suffix = (re.search(r"\.[^./]+$", path) or [""])[0].lower()
    try:
        if suffix in (".html", ".htm", ".xhtml"):
            out["emb_title"] = read_page(data.decode("utf-8", "replace"))[1]
            return out
        part = {".docx": "docProps/core.xml", ".odt": "meta.xml"}.get(suffix)
        if suffix not in (".docx", ".odt", ".epub"):
            return out
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if suffix == ".epub":
                box = ElementTree.fromstring(_member(z, "META-INF/container.xml", 1 << 20))
                part = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
            root = ElementTree.fromstring(_member(z, part, 4 << 20))
        for e in root.iter():
            name = _CORE.get(_local(e.tag))
            if name and out[name] is None:
                out[name] = " ".join("".join(e.itertext()).split()) or None
    except (KeyError, StopIteration, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        pass
    return out


def read_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, emb_title, emb_author, emb_language) of every supported file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.filter(F.col("length") <= MAX_BYTES).filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [embedded_metadata(a, bytes(c)) for a, c in zip(p.path, p.content)]
            yield pd.DataFrame({"path": p.path, **{k: [g[k] for g in got] for k in _CORE.values()}})

    return small.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{k} string" for k in _CORE.values()))


def group_archives(files: DataFrame) -> DataFrame:
    """(archive, split, n_parts, bytes) of archive files, parts of one together."""
    split = F.col("path").rlike(r"\.zim[a-z]{2}$")
    name = F.when(split, F.expr("substring(path, 1, length(path) - 2)")).otherwise(F.col("path"))
    return files.filter(F.col("path").rlike(r"\.zim([a-z]{2})?$")).groupBy(name.alias("archive"), split.alias("split")).agg(F.count("*").alias("n_parts"), F.sum("size").alias("bytes"))


def search_results(raw: DataFrame, limit: int) -> DataFrame:
    """(response_id, title, url, content) of JSON search responses: the first rows with
    a web address."""
    schema = "struct<results: array<struct<title: string, url: string, content: string>>>"
    r = raw.select("response_id", F.posexplode(F.from_json("body", schema)["results"]).alias("k", "r")).select("response_id", "k", "r.*")
    ok = r.filter(F.lower("url").rlike("^https?://"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("response_id").orderBy("k"))
    return ok.withColumn("n", n).filter(F.col("n") <= limit).drop("n", "k")
