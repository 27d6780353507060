"""Folders of documents as rows of text: plain, XML, RTF, DOCX, DOC and PDF files.

A file that can't be read gives a row with an empty text and a warning; it
never ends the job. Each file is opened by the task that reads it, and nothing
is written to a local disk.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.normalize import normalized
from ..operators.ranking import ranked

# The kinds of files that are read, and the headings of the elements of a resume in XML.
SUFFIXES = ("pdf", "docx", "doc", "txt", "md", "rtf", "xml")
HEADINGS = {
    "summary": "SUMMARY", "education": "EDUCATION", "technicalSkills": "TECHNICAL SKILLS", "experience": "EXPERIENCE", "projects": "PROJECTS", "certifications": "CERTIFICATIONS",
    "achievements": "ACHIEVEMENTS", "extracurricular": "ACTIVITIES",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _say(element: ET.Element) -> str:
    return " ".join(" ".join(element.itertext()).split())


def xml_text(raw: str) -> tuple[str, str, list[str]]:
    """(text, method, warnings) of a resume in XML: contact lines, then a heading and its lines for each block."""
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as error:
        return re.sub(r"<[^>]+>", "\n", raw), "xml-salvage", [f"xml could not be parsed: {error}"]
    out: list[str] = []
    for child in root:
        if child.tag == "applicant":
            out += [s for s in (_say(e) for e in child) if s]
            continue
        out += ["", HEADINGS.get(child.tag, child.tag.upper())]
        if not len(child):
            out.append(_say(child))
        for part in child:
            if part.tag == "skillGroup":
                out.append(f"{part.get('category', 'Skills')}: {_say(part)}")
                continue
            leaves = {e.tag: _say(e) for e in part if not len(e)}
            bullets = [_say(e) for e in part.iter("bullet")]
            if part.tag == "bullets" or part.tag == "bullet":
                out += [f"- {b}" for b in bullets or [_say(part)]]
            elif leaves:
                head = [leaves.pop(k) for k in ("title", "degree", "dates") if k in leaves]
                out.append(" | ".join(h for h in head if h))
                out += [v for k, v in leaves.items() if v and k != "bullet"] + [f"- {b}" for b in bullets]
            else:
                out.append(_say(part))
    text = "\n".join(out).strip()
    return (text, "xml", []) if len(text) >= 40 else ("\n".join(s.strip() for s in root.itertext() if s.strip()), "xml-generic", [])


def docx_text(content: bytes) -> str:
    """Paragraphs in order; a table row is one line, equal neighbouring cells once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            lines.append("".join(t.text or "" for t in block.iter(f"{_W}t")))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = ["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in row.iter(f"{_W}tc")]
                lines.append(" | ".join(c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])))
    return "\n".join(lines)


def rtf_text(raw: str) -> str:
    """The text of an RTF file; escaped letters are those of its usual code page, and of Unicode escapes the letter itself."""
    flat = re.sub(r"\\par[d]?\b ?", "\n", raw)
    flat = re.sub(r"\{\\\*[^{}]*\}", "", flat)
    flat = re.sub(r"\\u(-?\d+) ?(?:\\'[0-9a-f]{2}|\?)?", lambda m: chr(int(m[1]) % 65536), flat, flags=re.I)
    flat = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "ignore"), flat, flags=re.I)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", "", flat, flags=re.I)).strip()


def printable_runs(content: bytes, least: int = 6) -> str:
    return "\n".join(r.decode("latin-1") for r in re.findall(rb"[\x20-\x7e]{%d,}" % least, content))


def extract(suffix: str, content: bytes) -> tuple[str, str, list[str]]:
    try:
        if suffix in ("txt", "md"):
            return content.decode("utf-8", "replace"), "plaintext", []
        if suffix == "xml":
            return xml_text(content.decode("utf-8", "replace"))
        if suffix == "docx":
            return docx_text(content), "python-docx", []
        if suffix == "rtf":
            return rtf_text(content.decode("utf-8", "replace")), "rtf-strip", []
        if suffix == "doc":
            text = printable_runs(content)
            return (text, "doc-salvage", []) if len(text) > 200 else ("", "doc-salvage", ["no readable text in this file"])
        if suffix == "pdf":
            for name, read in (("pypdf", _pypdf),):
                try:
                    return read(content), name, []
                except ImportError:
                    pass
            text = "\n".join(t.decode("latin-1") for t in re.findall(rb"\(((?:[^()\\]|\\.)*)\) ?Tj", content))
            return text, "pdf-salvage", ["no PDF reader installed; text operators only"] + ([] if text else ["may be a scan"])
    except Exception as error:  # a bad file must not end the batch
        return "", "failed", [f"{type(error).__name__}: {error}"]
    return "", "unsupported", [f"unsupported file type .{suffix}"]


def _pypdf(content: bytes) -> str:
    import pypdf

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(pool_ord, doc_id, path, text, method, warnings) of all files below a folder, in order of their paths."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content", name.alias("doc_id"), suffix.alias("suffix"))
    files = files.where(F.col("suffix").isin(*SUFFIXES) & ~F.col("doc_id").startswith("~$") & ~F.col("doc_id").startswith("."))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [extract(s, c) for s, c in zip(f["suffix"], f["content"])]
            yield pd.DataFrame({"path": f["path"], "doc_id": f["doc_id"], "raw": [g[0] for g in got], "method": [g[1] for g in got], "found": [g[2] for g in got]})

    read = files.mapInPandas(run, "path string, doc_id string, raw string, method string, found array<string>")
    short = F.when(F.length(F.trim("raw")) < 40, F.array(F.lit("very little text extracted"))).otherwise(F.array().cast("array<string>"))
    return ranked(read, [F.col("path").asc()], name="pool_ord").select("pool_ord", "doc_id", "path", normalized(F.col("raw")).alias("text"), "method", F.concat("found", short).alias("warnings"))


def failed_files(docs: DataFrame) -> DataFrame:
    """(doc_id, reason, warnings) of the files without text; the others go on."""
    return docs.where(F.trim("text") == "").select("doc_id", F.coalesce(F.try_element_at("warnings", F.lit(1)), F.lit("no text")).alias("reason"), "warnings")


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = [(i + 1, k, "", v, "text", []) for i, (k, v) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "pool_ord int, doc_id string, path string, text string, method string, warnings array<string>")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file: an array of objects with skill_key, canonical, category, aliases, related, importance."""
    return spark.read.schema("skill_key string, canonical string, category string, aliases array<string>, related array<string>, importance double").option("multiLine", "true").json(path)
