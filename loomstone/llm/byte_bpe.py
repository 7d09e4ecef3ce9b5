"""Byte-level BPE by recursive DuckDB queries inside the tasks: token rows meet a merge table until nothing merges."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomstone.llm.common import give_back, small_batches

ROUNDS = 64  # merges of a word in one recursive query; what is still open then starts the next query
KNOWN = 200_000  # distinct words a task remembers before it forgets all but the half it met most often
CHUNK = 500_000  # code points of texts taken together
ROWS = 100_000  # token rows of one ordered aggregation; a longer text is one alone
BATCH = 250_000  # bytes of new words in one recursive query

# A round unnests the tokens of every open word into rows of neighbours, joins them with the merge table, and contracts
# the leftmost pair of the smallest rank. A word without such a pair is closed and leaves the recursion.
MERGE = f"""
WITH RECURSIVE step AS (
  SELECT word, toks, 0 AS round, true AS open FROM start
  UNION ALL (
    WITH live AS (SELECT word, toks, round FROM step WHERE open AND round < {ROUNDS}),
    neighbours AS (
      SELECT word, unnest(toks[:-2]) AS left_tok, unnest(toks[2:]) AS right_tok, generate_subscripts(toks[2:], 1) AS pos FROM live),
    first AS (
      SELECT n.word, min(CAST(m.merged AS BIGINT) * 4294967296 + n.pos) AS best
      FROM neighbours n JOIN merges m ON m.pair = CAST(n.left_tok AS BIGINT) * 4294967296 + n.right_tok GROUP BY n.word)
    SELECT l.word, CASE WHEN best IS NULL THEN toks
      ELSE list_concat(toks[:best % 4294967296 - 1], [CAST(best // 4294967296 AS INTEGER)], toks[best % 4294967296 + 2:]) END,
      round + 1, best IS NOT NULL
    FROM live l LEFT JOIN first f ON f.word = l.word))
SELECT word, toks, open FROM step WHERE NOT open OR round = {ROUNDS}"""

# Ordered aggregation: token rows sorted by row and position meet the vocabulary, and their spellings stand one after the other.
# The one thread of a task's database hands the sorted rows to the aggregate as they come.
SPELL = """
SELECT row, unhex(string_agg(spelling, '')) AS spelled
FROM (SELECT t.row, v.spelling FROM tokens t JOIN vocabulary v ON v.tok = t.tok ORDER BY t.row, t.pos) GROUP BY row"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merger:
    """A DuckDB database in the memory of one task: vocabulary, merge table, and the queries over them."""

    def __init__(self, ranks: dict[bytes, int], memory_mb: int = 400):
        import duckdb

        self.ranks = ranks
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{memory_mb}MB'")
        self.db.execute("SET allocator_flush_threshold = '16MB'")
        pair, merged = [], []
        for token, rank in ranks.items():  # any two tokens that spell a third merge into it, with its rank
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair.append(a << 32 | b)
                    merged.append(rank)
        self._table("merges", {"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int32())})
        self._table("vocabulary", {"tok": pa.array(ranks.values(), pa.int32()), "spelling": pa.array([t.hex() for t in ranks], pa.string())})
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if self.of_byte.min() < 0:
            raise ValueError("a byte-level vocabulary holds all 256 bytes")

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def merge(self, words: list[bytes]) -> "Pieces":
        """Ids of every word. A word of the vocabulary is its own token."""
        whole = [(i, self.ranks[w]) for i, w in enumerate(words) if w in self.ranks]
        skip = {i for i, _ in whole}
        cut = [i for i in range(len(words)) if i not in skip]
        tokens = self.of_byte[np.frombuffer(b"".join(words[i] for i in cut), np.uint8)]
        ends = np.cumsum([0, *(len(words[i]) for i in cut)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))
        self._table("start", {"word": pa.array(cut, pa.int32()), "toks": lists})
        self._table("done", {"word": pa.array([i for i, _ in whole], pa.int32()), "toks": pa.array([[r] for _, r in whole], pa.list_(pa.int32()))})
        while self.db.execute("SELECT count(*) FROM start").fetchall()[0][0]:
            self.db.execute(f"CREATE OR REPLACE TABLE reached AS {MERGE}")
            self.db.execute("INSERT INTO done SELECT word, toks FROM reached WHERE NOT open")
            self.db.execute("CREATE OR REPLACE TABLE start AS SELECT word, toks FROM reached WHERE open")
        found = self.db.sql("SELECT toks FROM done ORDER BY word").to_arrow_table().column("toks").combine_chunks()
        return Pieces(found.flatten().to_numpy(), found.value_lengths().to_numpy())

    def spell(self, tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of every list of ids: ``tokens`` holds them one after the other, ``sizes`` their lengths."""
        out, ends = [b""] * len(sizes), np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + ROWS, "right")) - 1)
            own = tokens[ends[at] : ends[end]]
            row = np.repeat(np.arange(at, end, dtype=np.int32), sizes[at:end])
            self.db.register("tokens", pa.table({"row": pa.array(row), "pos": pa.array(np.arange(len(own), dtype=np.int32)), "tok": pa.array(own)}))
            for i, spelled in self.db.execute(SPELL).fetchall() if len(own) else ():
                out[i] = spelled
            self.db.unregister("tokens")
            at = end
        return out


class Pieces:
    """Runs of values, one after the other in one array; words are numbers of runs."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, np.asarray(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, words: np.ndarray) -> np.ndarray:
        """The values of these runs in this order."""
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.values[np.repeat(self.starts[words], sizes) + inside]


def _encoded(ranks_of, pattern: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, merger = regex.compile(pattern), Merger(ranks_of.value)
        nothing = Pieces(np.empty(0, np.int32), [])
        known: dict[str, int] = {}
        ids, met = nothing, np.empty(0, np.int64)  # the ids of known words, and how often each was met

        def forget() -> None:
            nonlocal known, ids, met
            kept = np.sort(np.argsort(-met, kind="stable")[: KNOWN // 2])
            words = list(known)
            known = {words[i]: n for n, i in enumerate(kept)}
            ids, met = Pieces(ids.take(kept), ids.sizes[kept]), met[kept] // 2

        def learn(words: list[str]) -> None:
            nonlocal ids
            found = [ids]
            raw = [w.encode("utf-8", "replace") for w in words]
            ends = np.cumsum([len(w) for w in raw]) // BATCH
            for part in np.split(np.arange(len(raw)), np.nonzero(np.diff(ends))[0] + 1):
                found.append(merger.merge([raw[i] for i in part]))
            known.update(zip(words, range(len(known), len(known) + len(words))))
            ids = Pieces(np.concatenate([f.values for f in found]), np.concatenate([f.sizes for f in found]))

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                words = [cut.findall(t) for t in texts[at:end]]
                every = set().union(*words)
                new = every.difference(known)
                if known and len(known) + len(new) > KNOWN:
                    forget()
                    new = every.difference(known)
                if new:
                    learn(sorted(new))
                counts = np.array([len(w) for w in words])
                flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
                met = np.bincount(flat, minlength=len(known)) + np.pad(met, (0, len(known) - len(met)))
                row = np.repeat(np.arange(len(words)), counts)
                columns = [batch.slice(at, end - at).column(c) for c in keep]
                sizes = np.bincount(row, weights=ids.sizes[flat], minlength=len(words)).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                tokens = ids.take(flat)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)))
                columns.append(pa.array(merger.spell(tokens, sizes), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])
                at = end
        merger.db.close()
        known.clear()
        ids, met = nothing, met[:0]
        give_back()

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row of (doc_id, text).

    ``vocabulary`` is the path of a rank file, read by the driver and sent to
    the tasks (its size does not depend on the data); ``pattern`` cuts a text
    into words, which are encoded separately and without special tokens.
    ``decoded`` comes from each row's own list: rows (row, position, id) join the
    vocabulary and are aggregated in order, a bounded number at a time.

    A task meets a word again and again, so it encodes a distinct word once and
    keeps its ids; what it remembers is bounded, words met often stay longest,
    and the words of one query are bounded too. A word
    merges once a round: a word of n bytes costs up to n rounds over its tokens.
    Null and empty texts have no ids and decode to nothing. Rows are independent:
    repeated rows and null ids are encoded like any other, other columns are not
    read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_encoded(ranks, pattern, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded binary) for rows (doc_id, ids); null or no ids decode to nothing."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = rows.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = part.column("ids")
                sizes = np.asarray(ids.value_lengths().fill_null(0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(merger.spell(ids.flatten().to_numpy(zero_copy_only=False), sizes), pa.binary())], ["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")
