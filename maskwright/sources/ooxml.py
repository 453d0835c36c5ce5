"""Office files in and out with the standard library only: paragraphs and cells of .docx, zones that
reading does not reach, and tokens replaced by values in .docx, .xlsx and .pptx."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ----- fixed values ------------------------------------------------------------------------------
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_PARTS, MOST_BYTES = 5000, 200 << 20
#: Elements whose runs belong to the text of a paragraph.
READ_THROUGH = ("ins", "hyperlink", "fldSimple", "smartTag", "sdt", "sdtContent")
PARTS = {
    ".docx": re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$"),
    ".xlsx": re.compile(r"xl/(sharedStrings|worksheets/sheet\d+)\.xml$"),
    ".pptx": re.compile(r"ppt/(slides/slide|notesSlides/notesSlide|slideLayouts/slideLayout|slideMasters/slideMaster)\d+\.xml$"),
}
#: For each kind of file: the element whose text elements belong together, and the text element.
GROUPS = {".docx": ((f"{W}p",), f"{W}t"), ".pptx": ((f"{A}p",), f"{A}t"), ".xlsx": ((f"{S}si", f"{S}is"), f"{S}t")}
ZONES = {"footnote": "word/footnotes.xml", "endnote": "word/endnotes.xml", "comment": "word/comments.xml"}
# ----- end of the fixed values -------------------------------------------------------------------

_TOKEN = re.compile(r"\[[A-Z_]+_\d+\]")


def unpack(data: bytes) -> dict[str, bytes]:
    """Parts of an office file; ValueError for what isn't one, or is larger than allowed."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > MOST_PARTS or sum(i.file_size for i in infos) > MOST_BYTES:
                raise ValueError("the archive is too large")
            parts = {i.filename: z.read(i) for i in infos if not i.is_dir()}
    except zipfile.BadZipFile as e:
        raise ValueError("not an archive") from e
    if "[Content_Types].xml" not in parts:
        raise ValueError("not an office file")
    return parts


def _text_of(node: ET.Element) -> str:
    """Text of a paragraph's readable runs."""
    out = []
    for child in node:
        name = child.tag.removeprefix(W)
        if name == "r":
            for x in child:
                out.append({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "‑"}.get(x.tag, ""))
        elif name in READ_THROUGH:
            out.append(_text_of(child))
    return "".join(out)


def _caps(paragraph: ET.Element) -> bool:
    """Every run with text is set in capitals by its own properties."""
    runs = [r for r in paragraph.iter(f"{W}r") if any(t.text for t in r.iter(f"{W}t"))]
    on = lambda r: any((p := r.find(f"{W}rPr/{W}{k}")) is not None and p.get(f"{W}val", "1") not in ("0", "false", "off") for k in ("caps", "smallCaps"))
    return bool(runs) and all(on(r) for r in runs)


def segments_of(data: bytes) -> list[dict]:
    """Paragraphs and cells of a .docx in order: the body, then headers, then footers. A merged cell has its text once."""
    parts = unpack(data)
    order = ["word/document.xml", *sorted(p for p in parts if re.match(r"word/header\d*\.xml$", p)), *sorted(p for p in parts if re.match(r"word/footer\d*\.xml$", p))]
    out: list[dict] = []
    table = -1
    for part in order:
        if part not in parts:
            continue
        root = ET.fromstring(parts[part])
        body = root.find(f"{W}body") if root.find(f"{W}body") is not None else root
        prefix = "" if part.endswith("document.xml") else re.search(r"(header|footer)\d*", part)[0] + ":"
        paragraph = 0
        blocks = [b for child in body for b in (child.iterfind(f"{W}sdtContent/*") if child.tag == f"{W}sdt" else [child])]
        for block in blocks:
            if block.tag == f"{W}p":
                text = _text_of(block)
                out.append({"seg_id": f"{prefix}p{paragraph}", "text": text, "source_type": "docx_paragraph", "part": part, "table_index": None, "row_index": None, "col_index": None, "caps": _caps(block)})
                paragraph += 1
            elif block.tag == f"{W}tbl":
                table += 1
                for r, row in enumerate(block.iterfind(f"{W}tr")):
                    c = 0
                    for cell in row.iterfind(f"{W}tc"):
                        span = cell.find(f"{W}tcPr/{W}gridSpan")
                        merged = cell.find(f"{W}tcPr/{W}vMerge")
                        lower = merged is not None and merged.get(f"{W}val") != "restart"
                        text = "" if lower else "\n".join(_text_of(p) for p in cell.iterfind(f"{W}p"))
                        for k in range(int(span.get(f"{W}val", 1)) if span is not None else 1):
                            out.append({"seg_id": f"{prefix}t{table}_r{r}_c{c}", "text": text if k == 0 else "", "source_type": "docx_table_cell", "part": part, "table_index": table, "row_index": r, "col_index": c, "caps": False})
                            c += 1
    return [{"seg_ord": i} | s for i, s in enumerate(out)]


def zones_of(data: bytes) -> list[dict]:
    """Text that reading doesn't reach: notes, comments, text boxes, tables in cells, and unknown blocks."""
    parts = unpack(data)
    out = []
    add = lambda kind, part, text: out.append({"kind": kind, "part": part, "char_count": len(text), "text": text}) if text.strip() else None
    for kind, part in ZONES.items():
        for note in ET.fromstring(parts[part]) if part in parts else ():
            if note.get(f"{W}type") is None:
                add(kind, part, "".join(t.text or "" for t in note.iter(f"{W}t")))
    for part in sorted(p for p in parts if re.match(r"word/(document|header\d*|footer\d*)\.xml$", p)):
        root = ET.fromstring(parts[part])
        for box in root.iter(f"{W}txbxContent"):
            add("textbox", part, "".join(t.text or "" for t in box.iter(f"{W}t")))
        for cell in root.iter(f"{W}tc"):
            for inner in cell.iterfind(f"{W}tbl"):
                add("nested_table", part, "".join(t.text or "" for t in inner.iter(f"{W}t")))
        body = root.find(f"{W}body")
        for block in body if body is not None else ():
            if block.tag not in (f"{W}p", f"{W}tbl", f"{W}sdt", f"{W}sectPr"):
                add("unknown_node", part, "".join(t.text or "" for t in block.iter(f"{W}t")))
    return out


def replace_in_group(texts: list[str], value_of: Callable[[str], str | None]) -> tuple[list[str], int, list[str]]:
    """Tokens in texts that read on from each other: the value goes where the token begins. Returns texts, replacements, unknown tokens."""
    whole = "".join(texts)
    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(t))
    out, done, unknown = list(texts), 0, []
    for m in reversed(list(_TOKEN.finditer(whole))):
        value = value_of(m[0])
        if value is None:
            unknown.append(m[0])
            continue
        value = re.sub(r"[\r\n]+", " ", value)
        for k in range(len(texts) - 1, -1, -1):
            a, b = max(m.start(), starts[k]), min(m.end(), starts[k + 1])
            if a < b:
                put = value if starts[k] <= m.start() < starts[k + 1] else ""
                out[k] = out[k][: a - starts[k]] + put + out[k][b - starts[k] :]
        done += 1
    return out, done, list(dict.fromkeys(reversed(unknown)))


def restore_file(data: bytes, suffix: str, values: dict[str, str]) -> tuple[bytes, int, list[str]]:
    """An office file with values for tokens; entries keep their order, dates and compression."""
    unpack(data)
    tops, text_tag = GROUPS[suffix]
    total, unknown = 0, []
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as new:
        for info in z.infolist():
            content = z.read(info)
            if PARTS[suffix].match(info.filename) and b"[" in content:
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(content), events=("start-ns",)):
                    if not re.match(r"ns\d+$", prefix):
                        ET.register_namespace(prefix, uri)
                root = ET.fromstring(content)
                for group in (g for tag in tops for g in root.iter(tag)):
                    nodes = list(group.iter(text_tag))
                    texts, n, odd = replace_in_group([t.text or "" for t in nodes], values.get)
                    total, unknown = total + n, unknown + odd
                    for node, text in zip(nodes, texts, strict=True):
                        node.text = text
                        if text != text.strip():
                            node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                content = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
            new.writestr(info, content)
    return out.getvalue(), total, list(dict.fromkeys(unknown))


_SEGMENT = "seg_ord int, seg_id string, text string, source_type string, part string, table_index int, row_index int, col_index int, caps boolean"
_ZONE = "kind string, part string, char_count int, text string"


def read_docx_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, zones, refused) of .docx files: segments and zones with doc_id and path; refused with path and reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append({"path": p, "segments": segments_of(data), "zones": zones_of(data), "reason": None})
                except (ValueError, ET.ParseError, KeyError) as e:
                    rows.append({"path": p, "segments": [], "zones": [], "reason": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    read = files.mapInArrow(run, f"path string, segments array<struct<{_colons(_SEGMENT)}>>, zones array<struct<{_colons(_ZONE)}>>, reason string").withColumn("doc_id", F.xxhash64("path"))
    good = read.where("reason is null")
    return good.select("doc_id", "path", F.inline("segments")), good.select("doc_id", "path", F.inline("zones")), read.where("reason is not null").select("path", "reason")


def _colons(fields: str) -> str:
    return ", ".join(":".join(f.split()) for f in fields.split(", "))


_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_struct = lambda fields: pa.list_(pa.struct([(f.split()[0], _TYPES[f.split()[1]]) for f in fields.split(", ")]))
_ARROW = pa.schema([("path", pa.string()), ("segments", _struct(_SEGMENT)), ("zones", _struct(_ZONE)), ("reason", pa.string())])


def complete_only(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Strict policy: segments of documents without unread text."""
    return segments.join(zones.select("doc_id").distinct(), "doc_id", "left_anti")


def restore_files(files: DataFrame, values: DataFrame) -> DataFrame:
    """files (doc_id, suffix, content) and values (doc_id, token, original_text) -> doc_id, content, replaced, unresolved."""
    table = values.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "original_text"))).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("replaced", pa.int32()), ("unresolved", pa.list_(pa.string()))])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                content, n, odd = restore_file(r["content"], r["suffix"], dict(r["values"] or []))
                rows.append({"doc_id": r["doc_id"], "content": content, "replaced": n, "unresolved": odd})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    joined = files.join(table, "doc_id", "left").select(F.col("doc_id").cast("bigint").alias("doc_id"), "suffix", "content", "values")
    return joined.mapInArrow(run, "doc_id bigint, content binary, replaced int, unresolved array<string>")
