"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests of the chunks find repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import packed, stored, text_key, unpacked, without

WINDOW = 16  # bytes that decide whether a cut follows


def gear_table(seed: int = 11) -> np.ndarray:
    """A random number for every byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(raw: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[raw[i]] over the last ``WINDOW`` bytes, for all i at once by doubling the window."""
    h = gear[raw]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def cut_points(raw: bytes, gear: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text, in bytes.

    A cut follows a byte whose hash has zeros in the ``bits`` bits that all of
    the window's bytes reach, at the next beginning of a character, once the
    chunk has ``least`` bytes; a chunk of ``most`` bytes is cut anyway. A cut
    depends on the bytes just before it, so after an insertion the cuts soon
    fall where they fell before.
    """
    if not raw:
        return []
    array = np.frombuffer(raw, np.uint8)
    mask = np.uint32(((1 << bits) - 1) << (WINDOW - bits))
    starts = np.append(np.nonzero(array & 0xC0 != 0x80)[0], len(raw))
    wanted = np.nonzero(gear_hashes(array, gear) & mask == 0)[0] + 1
    wanted = np.unique(starts[np.searchsorted(starts, wanted)]).tolist() if len(wanted) else []
    out, last = [], 0
    for at in [*wanted, len(raw)]:
        while at - last > most:
            last = int(starts[np.searchsorted(starts, last + most)])
            out.append(last)
        if at - last >= least or (at == len(raw) and at > last):
            out.append(at)
            last = at
    return out


def _digests(options: tuple):
    """Rows (doc_id, th, text) -> a row per chunk: two numbers of its digest, its document, its start and end in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()

        def rows_of(batch, row, digests, start, end) -> pa.RecordBatch:
            words = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            where = [pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), batch.column("doc_id").take(at), batch.column("th").take(at), *where], ["h1", "h2", "doc_id", "th", "start", "end"])

        for batch in batches:
            row, digests, start, end = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                cuts = cut_points(raw, gear, *options)
                begins = [0, *cuts[:-1]] if cuts else []
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins, cuts)]
                row += [i] * len(cuts)
                start += begins
                end += cuts
                if len(row) > 200_000:
                    yield rows_of(batch, row, digests, start, end)
                    row, digests, start, end = [], [], [], []
            yield rows_of(batch, row, digests, start, end)

    return run


_MARKS = "kind int, h1 long, h2 long, doc_id long, th long, start int, end int, first_doc long"


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc_id, start, th) -> those whose digest came before.

    kind 0: a repeat, with the document of the first occurrence. kind 1: rows of
    the part's first digest, which may have begun in the part before. kind 2:
    the last digest of the part, for that question.
    """
    names = [c.split()[0] for c in _MARKS.split(", ")]
    key, holder, origin, opening = None, None, None, True
    columns = ["h1", "h2", "doc_id", "th", "start", "end"]

    def marks(kind, batch, rows, holders) -> pa.RecordBatch:
        at = pa.array(rows)
        kinds = pa.array(np.full(len(rows), kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, *(batch.column(c).take(at) for c in columns), holders], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (h1[0], h2[0])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))  # -1: begun in an earlier batch
        if key is None:
            first_end = int(np.nonzero(new)[0][1]) if new.sum() > 1 else len(h1)
        elif opening:
            first_end = int(np.nonzero(new)[0][0]) if new.any() else len(h1)
        else:
            first_end = 0
        docs = batch.column("doc_id")
        holders = docs.take(pa.array(np.maximum(begins, 0)))
        if begins[0] < 0:
            own = pa.array([holder] * int((begins < 0).sum()), pa.int64())
            holders = pa.concat_arrays([own, holders.slice(len(own))])
        edge = np.arange(first_end)
        yield marks(1, batch, edge, holders.take(pa.array(edge)))
        # A row repeated whole stands beside itself; what equals its digest's first row is that row.
        place = np.stack([docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False), batch.column("start").to_numpy(), batch.column("th").to_numpy()])
        firsts = place[:, np.maximum(begins, 0)]
        if begins[0] < 0:
            firsts[:, begins < 0] = origin[:, None]
        rest = np.nonzero(~new[first_end:] & (place != firsts).any(0)[first_end:])[0] + first_end
        yield marks(0, batch, rest, holders.take(pa.array(rest)))
        opening = opening and first_end == len(h1)
        key, holder, origin = (h1[-1], h2[-1]), holders[len(h1) - 1].as_py(), firsts[:, -1].copy()
    if key is not None:
        last = [2, *map(int, key), None, None, None, None, holder]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds)], names)


def repeated_spans(docs: DataFrame, bits: int = 4, least: int = 16, most: int = 128, run_bytes: int = 128) -> DataFrame:
    """(doc_id, th, spans, holders): where a document repeats passages that stand earlier in the corpus.

    spans: array of (start, end) in bytes of the UTF-8 text; holders: ids of the
    documents that hold the first occurrence of the spans' chunks (a document
    may be its own). A chunk repeats if its digest stands in an earlier document
    (by doc_id, place, then text) or earlier in the same one. Neighbouring
    repeats form a run; runs shorter than ``run_bytes`` are left, as short
    chunks meet by chance. The first occurrence of every chunk stays.

    Digests are dealt out by range of (digest, document, place), so that a chunk
    of any share of the corpus lies across as many parts as it needs, and
    streamed in order. Only a part's first digest can have begun elsewhere; one
    row per part settles that.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text")
    chunks = rows.mapInArrow(_digests((bits, least, most)), "h1 long, h2 long, doc_id long, th long, start int, end int")
    order = ["h1", "h2", "doc_id", "start", "th"]
    dealt = chunks.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = stored(dealt.mapInArrow(_later, _MARKS).withColumn("part", F.spark_partition_id()), "marks")
    edges = marks.where("kind = 2").groupBy("h1", "h2").agg(F.min("part").alias("first_part"), F.min_by("first_doc", "part").alias("edge_doc"))
    again = marks.where("kind < 2").join(F.broadcast(edges), ["h1", "h2"], "left")  # one row per part at most
    # The very first occurrence of an edge digest: the first row of its first part.
    lead = marks.where("kind = 1").groupBy("part").agg(F.min(F.struct("h1", "h2", F.col("doc_id").isNotNull(), "doc_id", "start", "th")).alias("lead"))
    same = [F.col(c).eqNullSafe(F.col(f"lead.{c}")) for c in ("doc_id", "start", "th")]
    again = again.join(F.broadcast(lead), "part", "left")
    leads = (F.col("kind") == 1) & (F.coalesce("first_part", F.col("part")) == F.col("part")) & same[0] & same[1] & same[2]
    again = again.where(~F.coalesce(leads, F.lit(False)))
    again = again.withColumn("first_doc", F.when((F.col("kind") == 1) & (F.col("first_part") < F.col("part")), F.col("edge_doc")).otherwise(F.col("first_doc")))
    place = ["doc_id", "th", "start"]
    dealt = again.select(*place, "end", "first_doc").repartition("doc_id", "th").sortWithinPartitions(*place)
    runs = dealt.mapInArrow(_runs(run_bytes), "doc_id long, th long, start int, end int, holders array<long>")
    spans = F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    holders = F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("holders")
    return runs.groupBy("doc_id", "th").agg(spans, holders)


def _runs(run_bytes: int):
    """Repeated chunks sorted by document and start -> the runs of neighbours that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the run that the next batch may go on with: at most a document's

        def runs_of(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            docs = table.column("doc_id").combine_chunks()
            named, doc = docs.is_valid().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
            th, start, end = (table.column(c).to_numpy() for c in ("th", "start", "end"))
            fresh = np.ones(len(doc), bool)
            same = (named[1:] == named[:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1])
            fresh[1:] = ~(same & (start[1:] <= end[:-1]))  # a row repeated whole gives a chunk again
            begins = np.nonzero(fresh)[0]
            ends = np.append(begins[1:], len(doc))
            left = table.slice(0, 0) if last else table.slice(begins[-1])
            whole = len(begins) if last else len(begins) - 1
            long = [i for i in range(whole) if end[ends[i] - 1] - start[begins[i]] >= run_bytes]
            first = table.column("first_doc").combine_chunks()
            holders = [sorted({d for d in first.slice(begins[i], ends[i] - begins[i]).to_pylist() if d is not None}) for i in long]
            at = pa.array(begins[long] if long else [], pa.int64())
            ending = pa.array(end[ends[long] - 1] if long else [], pa.int32())
            return pa.RecordBatch.from_arrays([docs.take(at), pa.array(th).take(at), pa.array(start).take(at), ending, pa.array(holders, pa.list_(pa.int64()))], ["doc_id", "th", "start", "end", "holders"]), left

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                found, rest = runs_of(pa.concat_tables([rest, table]) if rest is not None else table, False)
                yield found
        if rest is not None and rest.num_rows:
            yield runs_of(rest, True)[0]

    return run


def cut_spans(text: str | None, spans) -> str | None:
    if spans is None:
        return text
    raw = (text or "").encode("utf-8", "replace")
    out, last = [], 0
    for s in spans:
        out.append(raw[last : s["start"]])
        last = s["end"]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """Documents (doc_id, text, ...) without their repeated passages; adds n_spans, dropped_bytes, spans, holders.

    Every row stays; where nothing repeats the text is as it was, the counts are
    0 and the arrays empty. Null texts have no chunks and stay null; rows
    repeated whole count as one document and lose the same passages; a null
    doc_id comes before all others. Columns of the added names are replaced.
    """
    docs = without(docs, ["n_spans", "dropped_bytes", "spans", "holders"])
    found = stored(repeated_spans(docs, **options), "spans")
    keyed = packed(docs).withColumn("_id", F.col("_row.doc_id").cast("long")).withColumn("_th", text_key(F.col("_row.text")))
    known = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_text"), F.col("spans").alias("_spans"), F.col("holders").alias("_holders"))
    met = keyed.join(known, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_th") == F.col("_text")), "left")
    cut = F.udf(cut_spans, T.StringType(), useArrow=True)
    done = met.withColumn("_new", cut("_row.text", "_spans"))
    spans = F.coalesce("_spans", F.array().cast(known.schema["_spans"].dataType))
    return done.select(
        *unpacked(docs.columns, text=F.col("_new")),
        F.size(spans).alias("n_spans"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("dropped_bytes"),
        spans.alias("spans"),
        F.coalesce("_holders", F.array().cast("array<long>")).alias("holders"),
    )
