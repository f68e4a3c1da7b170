"""Identities over whole documents of JSON: snapshots and packs, byte for byte.

An id is a digest of one canonical JSON text (keys in order, no blanks, letters as they
are, nulls kept). The text is never built: the records of a document are hashed one after
another in order, in one pass of constant memory over rows sorted by disk. A digest is
sequential by its nature, so the records of one document pass through one task; what is
sent there is its records alone, made in parallel, and different documents spread over
tasks.

Defined results: a document without records has the digest of its empty lists; null texts
are the JSON null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.audit import candidate_records, snapshot_records
from quillspan.operators.packs import MEMBER_FIELDS

# Control characters are escaped in small letters, after an even number of backslashes.
_CONTROL = re.compile(r"((?:^|[^\\])(?:\\\\)*\\u00)([0-9A-F]{2})")


def canonical(value: object) -> bytes:
    """Canonical JSON of a parsed document."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")


def document_digests(records: DataFrame, between: list[str]) -> DataFrame:
    """(doc, digest, counts) of rows (doc, section, key, record, tail).

    A document is ``between[0]``, the records of section 0 joined by commas in order of key,
    ``between[1]``, those of section 1, and so on, then its tail. A row of section -1
    without a record stands for the document itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, tail, h, section, counts = None, "", None, 0, []

        def ended() -> tuple[str, str, list[int]]:
            for s in range(section + 1, len(between)):
                h.update(between[s].encode())
            h.update(tail.encode("utf-8", "surrogatepass"))
            return doc, h.hexdigest(), counts

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "digest", "counts"])

        for batch in batches:
            rows = []
            for d, s, record, t in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if h is None or d != doc:
                    if h is not None:
                        rows.append(ended())
                    doc, tail, section, counts = d, t, 0, [0] * (len(between) - 1)
                    h = hashlib.sha256(between[0].encode())
                if s < 0:
                    continue
                while section < s:
                    section += 1
                    h.update(between[section].encode())
                h.update(b"," if counts[s] else b"")
                h.update(_CONTROL.sub(lambda m: m[1] + m[2].lower(), record).encode("utf-8", "surrogatepass"))
                counts[s] += 1
            yield out(rows)
        if h is not None:
            yield out([ended()])

    order = records.repartition("doc").sortWithinPartitions("doc", "section", "key").select("doc", "section", "record", "tail")
    return order.mapInArrow(run, "doc string, digest string, counts array<long>")


def snapshot_ids(items: DataFrame, candidates: DataFrame | None, schema: str, prefix: str = "snap_", **root: str) -> DataFrame:
    """(snapshot_id, n_items, n_candidates): the id of a snapshot of the catalog as a
    document of the given schema name."""
    whole = candidates is not None
    rows = snapshot_records(items, **root).select(F.lit(1).alias("section"), F.col("item_id").alias("key"), "record")
    if whole:
        rows = rows.unionByName(candidate_records(candidates, **root).select(F.lit(0).alias("section"), F.col("candidate_id").alias("key"), "record"))
    itself = items.sparkSession.createDataFrame([(-1, "", None)], "section int, key string, record string")
    rows = rows.unionByName(itself).select(F.lit("snapshot").alias("doc"), "section", "key", "record", F.lit(json.dumps(schema, ensure_ascii=False) + "}").alias("tail"))
    flags = f'"canonical_bytes_embedded":false,"canonical_receipt":false,"include_candidates":{str(whole).lower()}'
    made = document_digests(rows, ['{"authority":"none","candidates":[', f'],{flags},"items":[', '],"schema":'])
    return made.select(F.concat(F.lit(prefix), "digest").alias("snapshot_id"), F.col("counts")[1].alias("n_items"), F.col("counts")[0].alias("n_candidates"))


def inspect_snapshots(payloads: DataFrame, prefix: str = "snap_") -> DataFrame:
    """(name, valid, snapshot_id, expected_snapshot_id, n_items, n_candidates) of written
    snapshots (name, body); a body that is none has only nulls and ``valid`` false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                try:
                    whole = json.loads(body)
                    core, said = whole["core"], whole.get("snapshot_id")
                    made = prefix + hashlib.sha256(canonical(core)).hexdigest()
                    rows.append((said == made, said, made, len(core.get("items", [])), len(core.get("candidates", []))))
                except (TypeError, ValueError, KeyError, AttributeError):
                    rows.append((False, None, None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["name", "valid", "snapshot_id", "expected_snapshot_id", "n_items", "n_candidates"],
            )

    schema = "name string, valid boolean, snapshot_id string, expected_snapshot_id string, n_items long, n_candidates long"
    return payloads.select("name", "body").mapInArrow(run, schema)


def manifest_digests(members: DataFrame, versions: DataFrame, schema: str) -> DataFrame:
    """(pack_name, pack_id, n_members) of packs of whole members (:func:`packs.members`);
    ``versions``: (pack_name, version, description). Members are in order of item_id; one
    without a sidecar has no field for it."""
    fields = sorted([*MEMBER_FIELDS, "payload_bytes"])
    bare = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    full = F.to_json(F.struct(*sorted([*fields, "source_provenance"])), {"ignoreNullFields": "false"})
    v = versions.select(
        "pack_name",
        F.concat(
            F.lit('],"name":'), json_value("pack_name"), F.lit(',"schema":' + json.dumps(schema, ensure_ascii=False) + ',"version":'), json_value("version"), F.lit("}")
        ).alias("tail"),
        F.concat(F.lit('{"description":'), json_value("description"), F.lit(',"members":[')).alias("lead"),
    )
    body = F.when(F.col("source_provenance").isNull(), bare).otherwise(full)
    rows = members.join(v, "pack_name").select(F.col("pack_name").alias("doc"), F.lit(1).alias("section"), F.col("item_id").alias("key"), body.alias("record"), "tail")
    # what stands before the members is the first record of its own section
    leads = v.select(F.col("pack_name").alias("doc"), F.lit(0).alias("section"), F.lit("").alias("key"), F.col("lead").alias("record"), "tail")
    made = document_digests(rows.unionByName(leads), ["", "", ""])
    return made.select(F.col("doc").alias("pack_name"), F.concat(F.lit("kpack_"), F.left("digest", F.lit(24))).alias("pack_id"), F.col("counts")[1].alias("n_members"))


def json_value(name: str) -> Column:
    """A text column as a JSON value."""
    whole = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)
