"""Documents -> text, and per-row combined unstructured text.

Documents are a table (path -> content): the ``binaryFile`` source for real
files, or any DataFrame with ``path`` and ``text``.  Rows reference them by
path; a join replaces the reference's per-row file reads, so documents are
read once, in parallel, however many rows point at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (BINARY_EXTENSIONS, MAX_CHARS, TEXT_EXTENSIONS, extension, normalize_text,
                              parse_document_paths, parse_path_array)

UNSTRUCTURED_TEXT_COL = "unstructured_text"


def read_document_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Every file under ``path`` as (path, ext, text).

    Bytes are decoded as UTF-8 with undecodable bytes dropped (the reference
    reads with ``errors='ignore'``): ``make_valid_utf8`` marks them with U+FFFD,
    which is then removed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return files.select(F.col("path"), extension(F.col("path")).alias("ext"), text.alias("text"))


def resolved_path(path: Column, base_path: str | Column | None = None) -> Column:
    """A path as the file source names it: relative ones below ``base_path``, ``.`` and ``..`` taken out.

    Local paths have no scheme, whether they came with ``file:`` or not; other
    schemes (``s3://bucket/...``) are kept.  Without a base relative paths stay relative.
    """
    plain = F.regexp_replace(path, "^file:/+", "/")
    if base_path is not None:
        base = F.regexp_replace(base_path if isinstance(base_path, Column) else F.lit(base_path), "^file:/+|(?<=[^/])/+$", "")
        base = F.when(base.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), base).otherwise(F.concat(F.lit("/"), base))
        plain = F.when(plain.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), plain).otherwise(F.concat(base, F.lit("/"), plain))
    root = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*|)(/?)", 0)
    steps = F.filter(F.split(F.substring(plain, F.length(root) + 1, F.length(plain)), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(
        x != "..", F.concat(done, F.array(x))).when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array().cast("array<string>")))
    return F.concat(root, F.array_join(kept, "/"))


def document_status(ref: DataFrame, files: DataFrame, path_col: str = "path", base_path: str | Column | None = None) -> DataFrame:
    """Join referenced paths to files and classify them.

    ``status``: ok | missing | unsupported (not a text
    format).  Adds ``doc_text`` (normalised, only for ok).  With ``base_path``, both sides
    are compared as resolved paths.
    """
    named, wanted = F.col("path"), F.col(path_col)
    if base_path is not None:
        named, wanted = resolved_path(named), resolved_path(wanted, base_path)
    f = files.select(named.alias("_fpath"), F.col("text").alias("_ftext"))
    j = ref.withColumn("_wanted", wanted).join(f, F.col("_wanted") == F.col("_fpath"), "left")
    ext = extension(F.col(path_col))
    status = (F.when(F.col("_fpath").isNull(), F.lit("missing"))
              .when(~ext.isin(*TEXT_EXTENSIONS), F.lit("unsupported"))
              .otherwise(F.lit("ok")))
    message = (F.when(status == "missing", F.concat(F.lit("no such document: "), F.col(path_col)))
               .when(status == "unsupported",
                     F.concat(F.lit("not a text format: "),
                              F.when(ext == "", F.lit("(no extension)")).otherwise(ext))))
    return j.select(*[c for c in ref.columns], status.alias("status"), message.alias("status_message"),
                    F.when(status == "ok", normalize_text(F.col("_ftext"))).alias("doc_text"),
                    ext.isin(*BINARY_EXTENSIONS).alias("binary_format"))


def combine_text(rows: DataFrame, files: DataFrame, key: str, inline_col: str | None, paths_col: str | None,
                 strict: bool = False, max_chars: int = MAX_CHARS,
                 output_col: str = UNSTRUCTURED_TEXT_COL, base_path: str | Column | None = None) -> DataFrame:
    """Inline text first, then documents in list order, joined by one space.

    Only the first ``max_chars`` characters are kept.  Each document is cut to
    ``max_chars`` before it is collected (that never changes the final
    prefix), so a group holds at most ``n_paths * max_chars`` characters.
    Lenient mode skips bad documents; strict mode marks the row with
    ``text_error`` (to be quarantined) instead of raising.
    """
    inline = normalize_text(F.col(inline_col)) if inline_col and inline_col in rows.columns else F.lit("")
    if paths_col and paths_col in rows.columns:
        is_list = isinstance(rows.schema[paths_col].dataType, T.ArrayType)
        paths = parse_path_array(F.col(paths_col)) if is_list else parse_document_paths(F.col(paths_col))
    else:
        paths = F.array().cast("array<string>")
    base = rows.select(key, inline.alias("_inline"), paths.alias("_paths"))
    refs = base.select(key, F.posexplode("_paths").alias("_pos", "path"))
    st = document_status(refs, files, base_path=base_path)
    chunks = st.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when((F.col("status") == "ok") & (F.col("doc_text") != ""),
                                           F.struct(F.col("_pos"), F.substring("doc_text", 1, max_chars)
                                                    .alias("t"))))).alias("_chunks"),
        F.count(F.lit(1)).alias("n_paths"),
        F.count_if(F.col("status") == "ok").alias("n_docs_ok"),
        F.min_by("status_message", F.when(F.col("status") != "ok", F.col("_pos"))).alias("_first_err"),
    )
    out = base.join(chunks, key, "left")
    pieces = F.concat(F.array(F.col("_inline")),
                      F.transform(F.coalesce(F.col("_chunks"), F.array().cast("array<struct<_pos:int,t:string>>")),
                                  lambda s: s["t"]))
    combined = F.substring(F.array_join(F.filter(pieces, lambda x: x != ""), " "), 1, max_chars)
    res = out.select(key, combined.alias(output_col), F.coalesce("n_paths", F.lit(0)).alias("n_paths"),
                     F.coalesce("n_docs_ok", F.lit(0)).alias("n_docs_ok"), "_first_err")
    if strict:
        res = res.withColumn("text_error", F.col("_first_err"))
    return res.drop("_first_err")


def ensure_text(df: DataFrame, files: DataFrame, key: str, notes_col: str = "deal_notes", paths_col: str = "document_paths",
                output_col: str = UNSTRUCTURED_TEXT_COL, base_path: str | Column | None = None) -> DataFrame:
    """``df`` with ``output_col`` and without the raw columns.

    A text column that is there is only normalised; otherwise it's made from notes and
    documents, and a column that isn't there counts as empty.
    """
    raw = [c for c in (notes_col, paths_col) if c in df.columns]
    if output_col in df.columns:
        return df.withColumn(output_col, normalize_text(F.col(output_col))).drop(*raw)
    text = combine_text(df, files, key, notes_col, paths_col, output_col=output_col, base_path=base_path)
    return df.drop(*raw).join(text.select(key, output_col), key, "left")


def request_text(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``unstructured_text`` + newline + ``deal_notes`` (falsy parts skipped), then documents, strict."""
    parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("unstructured_text", "deal_notes") if c in df.columns]
    merged = df.withColumn("_inline_raw", F.concat_ws("\n", *parts) if parts else F.lit(""))
    combined = combine_text(merged, files, key, "_inline_raw",
                            "document_paths" if "document_paths" in df.columns else None, strict=True)
    return (df.drop(*[c for c in ("unstructured_text", "deal_notes", "document_paths") if c in df.columns])
            .join(combined.select(key, UNSTRUCTURED_TEXT_COL, "text_error"), key, "left"))
