"""Document tables as file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.paths import dir_of, name_of


def files_from(df: DataFrame, path: Column, content: Column, inode: Column | None = None, dev: Column | None = None, ctime: Column | None = None, root: str = "/") -> DataFrame:
    """A FILES table, with ``content`` (binary), of any table with a path and a content. Null content is an unreadable file of size null."""
    raw = content.cast("binary")
    out = df.select(path.alias("path"), raw.alias("content"), (inode if inode is not None else F.xxhash64(path)).cast("long").alias("inode"), (dev if dev is not None else F.lit(1)).cast("long").alias("dev"), (ctime if ctime is not None else F.lit(0)).cast("long").alias("ctime"))
    return out.select(F.lit(root).alias("root"), "path", dir_of(F.col("path")).alias("dir"), name_of(F.col("path")).alias("name"), F.lit("file").alias("kind"), F.octet_length("content").cast("long").alias("size"), "inode", "dev", "ctime", "content")


def document_path() -> Column:
    return F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.when(F.col("lang") == "de", ".de").otherwise(F.col("lang")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def document_files(docs: DataFrame, hard_links: bool = False, content: Column | None = None) -> DataFrame:
    """The corpus adapter. ``hard_links`` derives inodes that some equal documents share, from each row alone, so that no content moves."""
    inode = F.xxhash64(F.lit(1), "text", F.col("doc_id") % 2) if hard_links else F.col("doc_id")
    return files_from(docs, document_path(), F.col("text") if content is None else content, inode=inode)
