"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def py_crc_mod(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def worker_cache(key, make):
    """A value made once per Python worker: Spark reuses workers, so later tasks find it again."""
    kept = sys.modules.setdefault("_panelspark_worker_cache", types.ModuleType("_panelspark_worker_cache")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null becomes empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the texts of an Arrow column; null becomes empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path behind a folder name, with or without a scheme."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
