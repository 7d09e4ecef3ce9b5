"""Line dedup on hashes: lines travel as digests with document and position, texts meet only a compressed keep bitmap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import SPACE, packed, scratch, small_batches, stored, text_key, unpacked, without

BLANK = SPACE.encode()


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line: stripped of the six blanks at both ends, A-Z in lower case, as UTF-8."""
    return [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "replace").split(b"\n")]


def code_points(key: bytes) -> int:
    return sum(1 for b in key if b & 0xC0 != 0x80)


def _digests(min_chars: int):
    """Rows (doc_id, th, text) -> one row per distinct line of a document with the positions it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, positions = [], [], []
            for i, text in enumerate(batch.column("text")):
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate(line_keys(text.as_py())):
                    if line and (min_chars <= 1 or code_points(line) >= min_chars):
                        own.setdefault(line, []).append(at)
                for line, at in own.items():
                    row.append(i)
                    key.append(blake2b(line, digest_size=16).digest())
                    positions.append(at)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.binary()), batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(positions, pa.list_(pa.int32()))],
                ["key", "doc_id", "th", "positions"],
            )

    return run


def _stream(min_docs: int):
    """Rows sorted by (key, doc_id, th) -> the lines that go, as far as this part of the range can tell.

    kind 0: the positions go. kind 1: they go if all parts together hold enough
    documents of the key. kind 2: how many documents of the key this part holds,
    for the first and the last key only; other keys lie whole inside the part.
    ``first`` marks a key's first position here. At most ``min_docs`` rows wait.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, docs, waiting, opening, last = None, 0, [], True, None

        def leave(kind: int, row: tuple, first: bool) -> None:
            k, doc, th, positions = row
            if first:  # the first position stands alone, so that a caller may spare it
                out.append((1 if opening else kind, k, doc, th, positions[:1], True, 0))
                positions = positions[1:]
            if positions:
                out.append((kind, k, doc, th, positions, False, 0))

        def close(edge: bool) -> None:
            if key is None:
                return
            if edge:
                for i, row in enumerate(waiting):
                    leave(1, row, i == 0)
                out.append((2, key, None, None, None, False, docs))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.int64()]
            names = ["kind", "key", "doc_id", "th", "positions", "first", "n"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    close(opening)
                    opening = key is None
                    key, docs, waiting, last = row[0], 0, [], None
                if row[1:3] == last:  # the same row once more
                    continue
                last = row[1:3]
                docs += 1
                if docs < min_docs:
                    waiting.append(row)
                elif docs == min_docs:
                    for i, w in enumerate([*waiting, row]):
                        leave(0, w, i == 0)
                    waiting = []
                else:
                    leave(0, row, False)
            yield batch_of(out)
            out.clear()
        close(True)
        yield batch_of(out)

    return run


@F.pandas_udf(T.BinaryType())
def packed_keep(positions):
    """Sorted positions that go -> compressed bitmap, 1 keeps; lines beyond its end stay."""

    def pack(at):
        bits = np.ones(max(at) // 8 * 8 + 8, dtype=np.uint8)  # whole bytes
        bits[np.asarray(at)] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

    return positions.map(pack)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, keep): the bitmap of every document that loses lines.

    A line goes if its key has ``min_chars`` code points and is found in
    ``min_docs`` documents; with ``keep_first`` its first position (by doc_id,
    then position) stays. A document is a distinct (doc_id, text).

    Digests are dealt out by range of (key, document), so a line that every
    document holds lies across as many parts as it needs, and are sorted and
    streamed there. Only a key that reaches the edge of a part can go on in
    another; two counts per part settle those.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text")
    lines = stored(rows.mapInArrow(_digests(min_chars), "key binary, doc_id long, th long, positions array<int>"), "lines")
    order = ["key", "doc_id", "th"]
    sorted_lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "kind int, key binary, doc_id long, th long, positions array<int>, first boolean, n long"
    marks = stored(sorted_lines.mapInArrow(_stream(min_docs), kinds).withColumn("part", F.spark_partition_id()), "marks")
    edges = marks.where("kind = 2").groupBy("key").agg(F.sum("n").alias("total"), F.min("part").alias("first_part"))
    going = marks.where("kind < 2").join(F.broadcast(edges), "key", "left")  # at most two keys per part are edges
    going = going.where(F.expr(f"kind = 0 OR total >= {min_docs}"))
    if keep_first:
        going = going.where("NOT (first AND part = coalesce(first_part, part))")
    positions = F.array_sort(F.flatten(F.collect_list("positions")))  # bounded by the lines of one document
    return going.groupBy("doc_id", "th").agg(positions.alias("gone")).select("doc_id", "th", packed_keep("gone").alias("keep"))


@F.pandas_udf(T.StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long"))
def kept_lines(text, keep):
    """Apply bitmaps to texts."""
    import pandas as pd

    out = []
    for t, k in zip(text, keep):
        lines = (t or "").split("\n")
        if k is None:
            out.append(("\n".join(lines), len(lines), 0))
            continue
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little")
        left = [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Documents (doc_id, text, ...) with the lines of ``keep_bitmaps`` taken out; adds n_lines and n_dropped.

    Every row stays. Null text is one empty line and comes back as an empty
    text; a null doc_id is an id like another; rows repeated whole count as one
    document and lose the same lines; other columns come through, n_lines and
    n_dropped of the input are replaced.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, ["n_lines", "n_dropped"])
    with scratch(docs.sparkSession):
        bitmaps = stored(keep_bitmaps(docs, min_docs, min_chars, keep_first), "bitmaps", keep=True)
    keyed = packed(docs).withColumn("_id", F.col("_row.doc_id").cast("long")).withColumn("_th", text_key(F.col("_row.text")))
    maps = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_text"), F.col("keep").alias("_keep"))
    met = keyed.join(maps, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_text")), "left")
    done = met.withColumn("_new", kept_lines("_row.text", "_keep"))
    return done.select(*unpacked(docs.columns, text=F.col("_new.text")), "_new.n_lines", "_new.n_dropped")
