"""Token ids in binary files: one concatenated array of ids a shard, document boundaries and document ids as Elias-Fano lists.

A shard is a range of document ids, in ascending order.  Its file holds, one after the other:

    ids         unsigned little-endian, 2 bytes each if the vocabulary has at most 65,536 entries, else 4
    boundaries  Elias-Fano list: where each document starts, and where the last one ends, in ids
    doc ids     Elias-Fano list of (doc id + 2^63) of the documents that have one; those without come first
    footer      magic, version, bytes of an id, documents without doc id, and the lengths of the three parts

so a trainer can map the ids into memory as they are, and one that wants document i reads two select()s' worth of index and
the document's own ids.  `manifest` lists the shards with the first document and the first id of each.

Tasks write their shards side by side, streaming: a task holds lengths and doc ids, never the ids of more than one text.  A file's name
is its attempt's own and only what the manifest lists is ever read, so a lost or repeated attempt does no harm.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.eliasfano import EliasFano, encode
from millrace.llm.packing import encoder

END_ID = 0
MANIFEST = "shard long, file string, docs long, tokens long, first_doc long, first_token long"
_FOOTER = "<8sHHQQQQ"
_MAGIC, _VERSION = b"TOKENIDS", 1
_SHIFT = 1 << 63
#: Bytes of ids that a reader holds, about.
READ_BYTES = 4 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the ids of all documents, each with end_id behind it, in ascending order of doc id; returns the manifest.

    vocabulary: a `tokenizers` file.  Null or empty text: end_id alone.  Rows without id come first; rows with one id
    stand in the order of their texts; repeated rows are written each.  Extra columns are ignored; an empty table
    gives no shards.  shards: as many ranges of ids; by default the session's shuffle partitions, joined where small.
    path: a folder that doesn't exist, in a store that the driver and all executors share and pyarrow can write to.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        kind = np.dtype("<u2" if enc.n_vocab <= 1 << 16 else "<u4")
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        ends, ids, none, out = array("Q", [0]), array("Q"), 0, None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    fs, folder = _opened(path)
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
                tokens = enc.encode(text.as_py() or "", allowed_special="all")
                tokens.append(end_id)
                out.write(np.array(tokens, dtype=kind).tobytes())
                ends.append(ends[-1] + len(tokens))
                if doc is None:
                    none += 1
                else:
                    ids.append(doc + _SHIFT)
        if out is not None:
            bounds, names = encode(np.frombuffer(ends, np.uint64)), encode(np.frombuffer(ids, np.uint64) if ids else np.zeros(0, np.uint64))
            out.write(bounds)
            out.write(names)
            out.write(struct.pack(_FOOTER, _MAGIC, _VERSION, kind.itemsize, none, kind.itemsize * ends[-1], len(bounds), len(names)))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard]), "file": [name], "docs": pa.array([len(ends) - 1]), "tokens": pa.array([ends[-1]], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    # One row a shard comes back; the ids themselves went from the tasks to the files.
    made = sorted(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard long, file string, docs long, tokens long").collect())
    listed, doc, token = [], 0, 0
    for r in made:
        listed.append((r.shard, r.file, r.docs, r.tokens, doc, token))
        doc, token = doc + r.docs, token + r.tokens
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


class Shard:
    """One file: documents by rank or by doc id, each by a read of its own ids."""

    def __init__(self, file: pa.NativeFile) -> None:
        self._file, size = file, file.size()
        raw = file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER))
        magic, version, width, self.without_id, self._upto, bounds, names = struct.unpack(_FOOTER, raw)
        if magic != _MAGIC or version != _VERSION or self._upto + bounds + names + struct.calcsize(_FOOTER) != size:
            raise ValueError("not a whole file of token ids")
        self.kind = np.dtype(f"<u{width}")
        self.bounds = EliasFano(file.read_at(bounds, self._upto))
        self.ids = EliasFano(file.read_at(names, self._upto + bounds))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def between(self, first: int, last: int) -> np.ndarray:
        """The ids from place first to before last."""
        return np.frombuffer(self._file.read_at((last - first) * self.kind.itemsize, first * self.kind.itemsize), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.between(self.bounds[i], self.bounds[i + 1])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.without_id else self.ids[i - self.without_id] - _SHIFT

    def find(self, doc_id: int) -> int | None:
        """The rank of the first document with this id."""
        i = self.ids.first_not_below(doc_id + _SHIFT)
        return self.without_id + i if i < len(self.ids) and self.ids[i] == doc_id + _SHIFT else None


def open_shard(path: str, name: str) -> Shard:
    fs, folder = _opened(path)
    return Shard(fs.open_input_file(f"{folder}/{name}"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = open_shard(path, r["file"])
                bounds = shard.bounds.all().astype(np.int64)
                names = (shard.ids.all() ^ np.uint64(_SHIFT)).view(np.int64)
                at = 0
                while at < len(shard):
                    # Whole documents of READ_BYTES together, or one longer document.
                    upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + READ_BYTES // shard.kind.itemsize, side="right")) - 1)
                    ids = shard.between(int(bounds[at]), int(bounds[upto])).astype("<u4").tobytes()
                    cuts = (bounds[at : upto + 1] - bounds[at]) * 4
                    docs = [None if i < shard.without_id else int(names[i - shard.without_id]) for i in range(at, upto)]
                    raw = pa.array([ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(bounds[at:upto] + r["first_token"]), pa.array(np.diff(bounds[at : upto + 1])), raw], names=["doc_id", "start", "n_tokens", "ids"])
                    at = upto

    shards = manifest(spark, path)
    # One shard a task: the manifest is one small file.
    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
