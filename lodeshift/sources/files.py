"""Scans of files: listing with globs, sniffing, guards as reason codes, hashes; HTML and DOCX to text; readers and writers."""

from __future__ import annotations

import io
import os
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Limits of one file, and what is looked for.
MOST_BYTES = 25 * 1024 * 1024
INCLUDE = ("**/*.pdf", "**/*.docx", "**/*.doc", "**/*.rtf", "**/*.txt", "**/*.md", "**/*.html")
EXCLUDE = ("**/.*", "**/~$*")
MEDIA = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "rtf": "application/rtf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html",
}


def glob_pattern(glob: str) -> str:
    """A glob with ``**`` as an anchored regular expression over relative paths."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def media_type(path: Column, content: Column) -> Column:
    """Media type by leading bytes, else by extension."""
    head = F.upper(F.hex(F.substring(content, 1, 8)))
    by_name = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]
    return (
        F.when(head.startswith("25504446"), MEDIA["pdf"]).when(head.startswith("504B0304"), F.when(is_docx(content), MEDIA["docx"]).otherwise("application/zip"))
        .when(head.startswith("D0CF11E0"), MEDIA["doc"]).when(head.startswith("7B5C7274"), MEDIA["rtf"]).when(is_text(content), F.coalesce(by_name, F.lit("text/plain")))
        .otherwise(by_name)
    )


def is_text(content: Column) -> Column:
    """No NUL byte and valid UTF-8."""
    return (F.instr(F.hex(F.substring(content, 1, 8192)), "00") % 2 != 1) & F.is_valid_utf8(content.cast("string"))


@F.pandas_udf(BooleanType())
def is_docx(content: pd.Series) -> pd.Series:
    def test(data) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
            return "word/document.xml" in names and not any(n.startswith("/") or ".." in n.split("/") for n in names)
        except Exception:  # noqa: BLE001 - not an archive
            return False

    return content.map(test)


@F.pandas_udf(StringType())
def zip_risk(content: pd.Series) -> pd.Series:
    """Why an archive isn't opened: an entry over ten times the limit, a total over it, or a ratio over 100; NULL if it may be."""

    def test(data) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                sizes = [(i.file_size, i.compress_size) for i in z.infolist()]
        except Exception:  # noqa: BLE001
            return None
        if any(n > 10 * MOST_BYTES for n, _ in sizes):
            return "ENTRY_TOO_LARGE"
        if sum(n for n, _ in sizes) > 10 * MOST_BYTES:
            return "TOTAL_TOO_LARGE"
        return "RATIO" if any(c and n / c > 100 for n, c in sizes) else None

    return content.map(test)


def document_id(sha256: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(sha256, 1, 8))


def manifest(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) under a folder: path, candidate_id, content_sha256, bytes, mtime, media_type; reason for rejects.

    Files stream through as rows of one scan, none is opened on the driver. Spark's file scan itself leaves out files of
    no length; rows of no length that come from elsewhere are rejected as EMPTY.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    found = files.withColumn("path", relative).where(matches(F.col("path"), include) & ~matches(F.col("path"), exclude))
    kind = media_type(F.col("path"), F.col("content"))
    reason = F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > most_bytes, "TOO_LARGE").when(kind.isNull() | (kind == "application/zip"), "UNSUPPORTED").when(kind == MEDIA["docx"], zip_risk("content"))
    sha = F.sha2("content", 256)
    rows = found.select("path", document_id(sha).alias("candidate_id"), sha.alias("content_sha256"), F.col("length").alias("bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime"), kind.alias("media_type"), reason.alias("reason"), "content")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "bytes", "reason")


# What names a job description, not a candidate.
_JOB_NAME = r"(?i)(^|[^a-z])(jd|job)([^a-z]|$)|job[ _-]?(description|spec)"


def load_folder(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("txt", "md", "html", "htm", "docx")) -> DataFrame:
    """(path, candidate_id, media_type, content) of the candidates' files under a folder, as the command line takes them: by
    suffix, without hidden paths, files named as job descriptions, and folders that hold an earlier run (an audit or
    scores folder, or a manifest). An empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    found = files.withColumn("path", relative).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    earlier = found.where(F.col("name").rlike("^(manifest[.]json|scores[.]csv|audit[.]jsonl)$")).select("folder").distinct()
    kept = found.where(F.lower("name").rlike("[.](" + "|".join(suffixes) + ")$") & ~F.col("path").rlike("(^|/)[.]") & ~F.col("name").rlike(_JOB_NAME)).join(earlier, "folder", "left_anti")
    sha = F.sha2("content", 256)
    return kept.select("path", document_id(sha).alias("candidate_id"), media_type(F.col("path"), F.col("content")).alias("media_type"), "content")


def contained(root: str, path: str) -> bool:
    """Whether a path, its links followed, stays within a folder; for paths that a user names, on the driver."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return full == base or full.startswith(base + os.sep)


class _Text(HTMLParser):
    SKIP, BREAK = {"script", "style", "noscript", "template"}, {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skipped = max(0, self.skipped - (tag in self.SKIP))
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(page: str | None) -> str | None:
    """Visible text: blocks on lines of their own, scripts and styles gone, entities decoded, blanks collapsed."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


@F.pandas_udf(StringType())
def docx_to_text(content: pd.Series) -> pd.Series:
    """Paragraphs, then tables as rows of cells joined by bars; NULL where the archive can't be read."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{w}t"))

    def read(data) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
            lines = [text(p) for p in body.findall(f"{w}p")]
            rows = [" | ".join(text(c) for c in r.findall(f"{w}tc")) for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")]
            return "\n".join(x for x in [*lines, *rows] if x.strip())
        except Exception:  # noqa: BLE001
            return None

    return content.map(read)


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def extract(documents: DataFrame) -> DataFrame:
    """(path, candidate_id, media_type, text, code) of a manifest: each media type by its own reader, codes for what has none."""
    kind = F.col("media_type")
    text = F.when(kind.isin("text/plain", "text/markdown"), decode_text(F.col("content"))).when(kind == "text/html", html_to_text(decode_text(F.col("content")))).when(kind == MEDIA["docx"], docx_to_text("content"))
    code = F.when(kind.isin(MEDIA["pdf"], MEDIA["doc"], MEDIA["rtf"]), "NO_READER").when(text.isNull(), "CORRUPT")
    return documents.select("path", "candidate_id", "media_type", text.alias("text"), code.alias("code"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Demographics (candidate_id, group) from CSV files; blank rows dropped, of repeated ids the last line of the last file by
    name wins. Files are read whole, one row each, so that lines keep their place whatever the splits."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "row")).where("line > 0 and row <> ''")
    cells = texts.select(F.struct("file", "line").alias("_o"), F.from_csv("row", F.lit("candidate_id string, group string")).alias("x")).select("_o", "x.*")
    return cells.where("candidate_id is not null and trim(candidate_id) <> ''").groupBy("candidate_id").agg(F.max_by("group", "_o").alias("group"))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Saved score cards (JSON lines); unreadable ones are left out."""
    schema = "job_id string, candidate_id string, composite double, band string, rank int, selected boolean, _corrupt string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null and candidate_id is not null").drop("_corrupt")


def write_scores(frame: DataFrame, folder: str) -> None:
    """Score rows as CSV parts with a header, by the committer's rename."""
    frame.write.mode("overwrite").option("header", True).csv(folder)


def hash_of(text: Column) -> Column:
    """The hash of a job description that audit records carry; blanks and line ends don't matter."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def write_audit(cards: DataFrame, folder: str, job_hash: str | None = None) -> None:
    """One JSON record per card, with the hash of its requirements: a column that ``cards`` bring, or one hash for all."""
    if job_hash is not None:
        cards = cards.withColumn("jobspec_sha256", F.lit(job_hash))
    cards.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]+", "_"), r"^[._]+|[._]+$", "")


def settings(defaults: dict, file: dict | None = None, env: dict | None = None, flags: dict | None = None, prefix: str = "LODESHIFT_") -> dict:
    """Settings by layers: flags over environment (``PREFIX_A__B``) over file over defaults, keys in any case."""
    nested: dict = {}
    for key, value in (env if env is not None else dict(os.environ)).items():
        if key.upper().startswith(prefix):
            node = nested
            *path, last = key[len(prefix) :].lower().split("__")
            for part in path:
                node = node.setdefault(part, {})
            node[last] = value
    out: dict = {}
    for layer in (defaults, file or {}, nested, flags or {}):
        out = _merged(out, layer)
    return out


def _merged(low: dict, high: dict) -> dict:
    out = dict(low)
    names = {k.lower(): k for k in out}
    for k, v in high.items():
        name = names.get(k.lower(), k)
        old = out.get(name)
        if isinstance(old, dict) and isinstance(v, dict):
            out[name] = _merged(old, v)
        elif isinstance(v, str) and isinstance(old, bool):
            out[name] = v.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(v, str) and isinstance(old, (int, float)):
            out[name] = type(old)(float(v))
        else:
            out[name] = v
    return out
