"""Deterministic chunks of texts: blocks of lines, or pages between form feeds.

Scale: all JVM-side, one narrow pass. Defined results: null, empty and blank texts
give no chunks; blank chunks are dropped without using up an ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import strip
from quillspan.functions.text import one_line_break, short_id, universal_newlines

CHUNK_LINES = 40


def chunk_texts(texts: DataFrame, lines: int = CHUNK_LINES, also: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, chunk_id, ordinal, body, location, text_sha256) of (item_id, sha256,
    text[, media_type]). Texts with form feeds, and PDFs, are cut by pages. Columns named in ``also`` go with each chunk."""
    paged = F.contains("text", F.lit("\f"))
    if "media_type" in texts.columns:
        paged = paged | (F.coalesce("media_type", F.lit("")) == "application/pdf")
    t = texts.withColumn("text", F.col("text").cast("string")).filter("text is not null")
    # blocks of lines are matched in one pass; nothing in a lambda looks back at the text
    flat = one_line_break(F.col("text"))
    ended = F.when((flat == "") | flat.endswith("\n"), flat).otherwise(F.concat(flat, F.lit("\n")))
    no = F.lit(None).cast("int")
    pieces = F.when(
        paged, F.transform(F.split(universal_newlines(F.col("text")), "\f"), lambda p, i: F.struct(strip(p).alias("body"), no.alias("a"), no.alias("b"), (i + 1).alias("page")))
    ).otherwise(
        F.transform(
            F.regexp_extract_all(ended, F.lit(f"(?:[^\n]*\n){{1,{lines}}}"), F.lit(0)),
            lambda b, i: F.struct(
                strip(b).alias("body"),
                (i * lines + 1).alias("a"),
                (i * lines + F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))).alias("b"),
                no.alias("page"),
            ),
        )
    )
    full = t.withColumn("p", F.filter(pieces, lambda x: x["body"] != ""))
    out = full.select("item_id", "sha256", *also, F.posexplode("p").alias("ordinal", "c"))
    sha = F.sha2(F.col("c.body"), 256)
    place = F.when(F.col("c.page").isNotNull(), F.concat(F.lit("page:"), "c.page")).otherwise(
        F.concat(F.lit("lines:"), "c.a", F.lit("-"), "c.b")
    )
    kind = F.when(F.col("c.page").isNotNull(), "page").otherwise("lines")
    return out.select(
        "item_id",
        short_id("chk_", F.col("sha256"), place, sha).alias("chunk_id"),
        "ordinal",
        F.col("c.body").alias("body"),
        F.struct(kind.alias("kind"), F.col("c.a").alias("start_line"), F.col("c.b").alias("end_line"), F.col("c.page").alias("page")).alias("location"),
        sha.alias("text_sha256"),
        *also,
    )
