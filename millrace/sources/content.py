"""A content-addressed store: each distinct content once, in a file named by its SHA-256, under a folder named by the digest's first two digits."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests that a task remembers, so that copies among its rows ask the store once.
REMEMBERED = 100_000


def store(df: DataFrame, content: str, path: str, suffix: str = ".bin") -> DataFrame:
    """Write df's contents (binary, or text as UTF-8) to path; gives sha256, bytes and `written` for each row, whether this row's task wrote the file.

    Tasks write where the rows are, so contents aren't shuffled.  A file appears under its name by a rename, when it is whole; one that
    is there already isn't written again, and if two tasks write one content at once, both write the same.  Null contents have a null
    digest and no file; empty ones have an empty file.  The result is lazy: what reads it runs the writing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for x in batch.column(0):
                raw = x.as_py()
                if raw is None:
                    rows.append((None, None, False))
                    continue
                digest = hashlib.sha256(raw).hexdigest()
                name = f"{folder}/{digest[:2]}/{digest}{suffix}"
                new = digest not in seen and fs.get_file_info(name).type == pafs.FileType.NotFound
                if new:
                    fs.create_dir(f"{folder}/{digest[:2]}", recursive=True)
                    draft = f"{folder}/{digest[:2]}/_{uuid.uuid4().hex}"
                    with fs.open_output_stream(draft) as out:
                        out.write(raw)
                    try:
                        fs.move(draft, name)
                    except OSError:
                        fs.delete_file(draft)
                        if fs.get_file_info(name).type == pafs.FileType.NotFound:
                            raise
                        new = False
                if len(seen) < REMEMBERED:
                    seen.add(digest)
                rows.append((digest, len(raw), new))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["sha256", "bytes", "written"])

    return df.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, "sha256 string, bytes long, written boolean")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, bytes, intact, path) of the store's files; intact: a file's content has the digest that its name says."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[0-9a-f]*").load(path)
    name = F.regexp_extract("path", "([0-9a-f]{64})[^/]*$", 1)
    return f.select(name.alias("sha256"), F.col("length").alias("bytes"), (F.sha2("content", 256) == name).alias("intact"), "path")
