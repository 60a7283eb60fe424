"""Corpora as files of token ids, written and read by tasks in parallel.

Tasks reach the folder through ``pyarrow.fs``, so it is a URI that all of them
share (file:, hdfs:, s3:, gs:).  A file has a name of its own for each attempt
of a task; the manifest, which Spark commits once, names the files that count.
A lost executor therefore leaves at most an unnamed file behind.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .frames import Reader, Writer
from .store import slices

FRAME_IDS = 1 << 16
MANIFEST = "part long, path string, frame long, n_documents long, n_tokens long, first_doc long, last_doc long"


def _open(uri: str):
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri(f"file://{uri}")
    return where, path


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order; returns the lazy manifest, a row per frame.

    Null texts are empty documents: the end id alone.  Null doc_ids come first;
    rows that repeat a doc_id are ordered by text and all written.  No rows give
    an empty manifest.  Other columns of ``docs`` are not read.  Keep the
    manifest before use: computing it again writes the files again.  A frame's
    ``first_doc`` and ``last_doc`` bound its doc_ids (null: it holds null ones only).
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )

    def run(batches):
        encode, part = encoder(tokenizer_path).ids, TaskContext.get().partitionId()
        end, sink, out = np.array([end_id], np.uint32), None, []
        names, held, size = [], [], 0

        def flush():
            nonlocal names, held, size
            if names:
                known = [d for d in names if d is not None] or [None]
                out.append((part, uri, writer.add(names, held), len(names), size, known[0], known[-1]))
            names, held, size = [], [], 0

        for batch in slices(batches):
            if sink is None:
                uri = f"{folder.rstrip('/')}/{part:06d}-{uuid.uuid4().hex}.ids.zst"
                where, path = _open(uri)
                where.create_dir(path.rpartition("/")[0], recursive=True)
                sink = where.open_output_stream(path, compression=None)
                writer = Writer(sink)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                names.append(doc_id)
                held.append(np.concatenate([ids, end]))
                size += len(held[-1])
                if size >= FRAME_IDS:
                    flush()
        if sink is not None:
            flush()
            writer.finish()
            sink.close()
        fields = [("part", pa.int64()), ("path", pa.string()), *[(c, pa.int64()) for c in ("frame", "n_documents", "n_tokens", "first_doc", "last_doc")]]
        yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in fields), row)) for row in out], pa.schema(fields))

    return ordered.mapInArrow(run, MANIFEST)


def read_token_files(manifest: DataFrame, frames_a_task: int = 64) -> DataFrame:
    """Every document of the manifest's frames: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before: sums by file first, then
    by frame inside its file, then by document inside its frame.
    """
    files = manifest.groupBy("part", "path").agg(F.sum("n_tokens").alias("file_tokens"), F.count("*").alias("n"))
    before = F.sum("file_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("path", F.coalesce(before, F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("path").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    frames = manifest.withColumn("frame_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    frames = frames.join(files, "path").select("path", "frame", (F.col("file_start") + F.col("frame_start")).alias("start"))

    def run(batches):
        path = reader = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path = row["path"]
                    where, name = _open(path)
                    file = where.open_input_file(name)
                    reader = Reader(file.read_at, file.size())
                docs = reader.frame(row["frame"])
                n = np.array([len(ids) for _, ids in docs], np.int64)
                crc = [zlib.crc32(ids.astype("<u4", copy=False).tobytes()) for _, ids in docs]
                start = row["start"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in docs], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # Neighbouring frames of one file share a task, and a large file goes to several.
    dealt = frames.repartition("path", F.floor(F.col("frame") / frames_a_task)).sortWithinPartitions("path", "frame")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested documents: ``doc_id, ids, path, frame, frame_bytes``, from the frames that hold them and no others.

    ``ids(doc_id)`` may be of any size; repeats count once, and null or unknown
    ones give no row.  A doc_id that several documents have gives them all.
    Files are ranges of doc_ids: a binary search names a request's file, and then
    it meets only that file's frames.  ``frame_bytes`` is what was decompressed.
    """
    wanted = ids.select(F.col("doc_id").cast("long").alias("want")).where("want IS NOT NULL").distinct()
    files = manifest.groupBy("path").agg(F.min("first_doc").alias("low"), F.max("last_doc").alias("high")).where("low IS NOT NULL")
    files = sorted(files.collect(), key=lambda f: f["low"])  # a row for each task that wrote
    low, high = (np.array([f[c] for f in files], np.int64) for c in ("low", "high"))
    names = np.array([f["path"] for f in files] or [""], object)

    def find(batches):
        """The one file whose range holds a request: a binary search, as ranges of files are apart."""
        for batch in batches:
            want = batch.column("want").to_numpy()
            at = np.searchsorted(low, want, "right") - 1
            inside = np.flatnonzero((at >= 0) & (want <= high[np.maximum(at, 0)])) if len(low) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(want[inside], pa.int64()), pa.array(names[at[inside]], pa.string())], ["want", "path"])

    of_file = wanted.mapInArrow(find, "want long, path string")
    frames = manifest.select(F.col("path").alias("p"), "frame", "first_doc", "last_doc")
    hit = of_file.join(frames, (F.col("path") == F.col("p")) & (F.col("want") >= F.col("first_doc")) & (F.col("want") <= F.col("last_doc")))
    asked = hit.select("path", "frame", "want").repartition("path", "frame").sortWithinPartitions("path", "frame")
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("path", pa.string()), ("frame", pa.int64()), ("frame_bytes", pa.int64())]

    def run(batches):
        path = reader = at = docs = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, at = row["path"], None
                    where, name = _open(path)
                    file = where.open_input_file(name)
                    reader = Reader(file.read_at, file.size())
                if row["frame"] != at:
                    at, docs = row["frame"], reader.frame(row["frame"])
                held = [
                    {"doc_id": d, "ids": x.astype(np.int64), "path": path, "frame": at, "frame_bytes": int(reader.table[at, 0])}
                    for d, x in docs
                    if d == row["want"]
                ]
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(fields))

    return asked.mapInArrow(run, "doc_id long, ids array<long>, path string, frame long, frame_bytes long")
