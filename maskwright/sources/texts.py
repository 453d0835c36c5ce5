"""Plain text in: bytes to segments, and tables to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Share of unreadable characters from which a text is refused.
UNREADABLE = 0.30
#: What is read and what values can be restored into.
CAPABILITIES = {"read": (".docx", ".txt"), "restore_text": True, "restore_files": (".docx", ".xlsx", ".pptx")}

#: The upper half of two one-byte alphabets, by the standard library's own tables.
_UPPER_HALF = "".join(map(chr, range(128, 256)))
_WINDOWS_1251 = bytes(range(128, 256)).decode("cp1251", errors="replace")


def decode_text(content: Column) -> Column:
    """Text of bytes: UTF-16 or UTF-8 by their mark, UTF-8, else windows-1251; line ends become LF."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = (
        F.when(head.startswith("EFBBBF"), F.regexp_replace(content.cast("string"), "^\\uFEFF", ""))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.regexp_replace(F.decode(content, "UTF-16"), "^\\uFEFF", ""))
        .when(utf8, content.cast("string"))
        .otherwise(F.translate(F.decode(content, "ISO-8859-1"), _UPPER_HALF, _WINDOWS_1251))
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def unreadable_share(text: Column) -> Column:
    """Share of replacement and control characters, tab and line ends aside."""
    odd = F.length(text) - F.length(F.regexp_replace(text, "[\\uFFFD\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F-\\u009F]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(odd / F.length(text))


def lines(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One segment per line: doc_id, seg_ord, seg_id (l0, l1, ...), text, source_type. One empty last line is dropped; null has no lines."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.posexplode(kept).alias("seg_ord", "text"))
    return rows.select("doc_id", "seg_ord", F.concat(F.lit("l"), "seg_ord").alias("seg_id"), "text", F.lit("txt_line").alias("source_type"))


def read_text_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, refused) of .txt files: refused has path and reason (unsupported, unreadable, and too_large where most_bytes is set)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    named = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    too_large = F.lit(False) if most_bytes is None else F.col("length") > most_bytes
    text = named.withColumn("text", F.when((F.col("suffix") == ".txt") & ~too_large, decode_text(F.col("content"))))
    reason = F.when(F.col("suffix") != ".txt", "unsupported").when(too_large, "too_large").when(unreadable_share(F.col("text")) > UNREADABLE, "unreadable")
    judged = text.withColumn("reason", reason).withColumn("doc_id", F.xxhash64("path"))
    return lines(judged.where("reason is null")), judged.where("reason is not null").select("path", "reason")


def table_cells(df: DataFrame, doc_id: Column, table_index: Column, row_index: Column, columns: list[str]) -> DataFrame:
    """Cells of relational rows as segments t{table}_r{row}_c{col}; seg_ord follows table, row, column."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_index"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")) for i, c in enumerate(columns)])
    rows = df.select(doc_id.cast("bigint").alias("doc_id"), table_index.cast("int").alias("table_index"), row_index.cast("int").alias("row_index"), F.explode(cells).alias("c"))
    # Each table begins where those before it in its document end.
    heights = rows.groupBy("doc_id", "table_index").agg((F.max("row_index") + 1).alias("_height"))
    before = Window.partitionBy("doc_id").orderBy("table_index").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heights.select("doc_id", "table_index", F.coalesce(F.sum("_height").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(offsets, ["doc_id", "table_index"])
    order = ((F.col("_before") + F.col("row_index")) * len(columns) + F.col("c.col_index")).cast("int")
    return rows.select(
        "doc_id", order.alias("seg_ord"), F.concat(F.lit("t"), "table_index", F.lit("_r"), "row_index", F.lit("_c"), "c.col_index").alias("seg_id"), "c.text", F.lit("docx_table_cell").alias("source_type"),
        "table_index", "row_index", "c.col_index",
    )
