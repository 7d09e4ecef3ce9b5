"""Best-fit packing: pieces of documents fill sequences, and a local search of moves and swaps empties sequences that are not full."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import packed, small_batches, stored, unpacked, without

SHARD = 32_768  # pieces that one task packs together
ROUNDS = 12  # times that the pieces of sequences which are not full are dealt anew
PASSES = 50  # passes of the local search over the open bins of a shard, should every one still find something
TOKENS = 8_000_000  # ids that a task gathers before it writes them
BLANKS = re.compile(r"\s{2000}")  # runs of blanks that overflow the fast encoder's stack


# ---------------------------------------------------------------- pieces of documents


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts by a tokenizer file, special tokens' strings read as plain text.

    A byte-level vocabulary whose ids follow its merges is the same as a table of
    ranks, which ``tiktoken`` applies faster; texts with very long runs of blanks,
    and files of any other kind, go through ``tokenizers``. Both give the same ids.
    """

    def __init__(self, given: str, pattern: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(given)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks := self.ranks(json.loads(given)):
            import tiktoken

            self.fast = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def ranks(file: dict) -> dict[bytes, int] | None:
        model, of = file["model"], byte_alphabet()
        pre = file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        special = {t["content"] for t in file.get("added_tokens", [])}
        own = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(c not in of for t in own for c in t) or sorted(own.values()) != list(range(256 + len(merges))):
            return None
        if any(own.get(a + b) != 256 + at for at, (a, b) in enumerate(merges)):
            return None
        return {bytes(of[c] for c in t): i for t, i in own.items()}

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or (len(text) > 2000 and BLANKS.search(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole if it fits, else full pieces behind a first one of what is left over."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(given, pattern: str, end: int, capacity: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(given.value, pattern)
        names = [*keep, "piece", "start", "length", "ids"]

        def made(batch: pa.RecordBatch, rows: list, out: list) -> pa.RecordBatch:
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns += [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows, out, size = [], [], 0
            for i, text in enumerate(batch.column("_text")):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for at, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append(i)
                    out.append((at, start, length, ids[start : start + length].tobytes()))
                size += len(ids)
                if size >= TOKENS:
                    yield made(batch, rows, out)
                    rows, out, size = [], [], 0
            yield made(batch, rows, out)

    return run


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of every row of ``docs``: its other columns, piece (from 0), start, length and ids (binary, unsigned 32-bit, little-endian).

    A document is the ids of its text and ``end``. Only documents of more than
    ``capacity`` ids are cut, into pieces of that many; the first may be shorter.
    Null and empty texts are one piece that holds ``end`` alone. Rows are
    independent, so repeated rows are cut alike; columns named as one that is
    written are replaced. ``tokenizer`` is read by the driver and sent to the
    tasks: its size does not depend on the data.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        given = docs.sparkSession.sparkContext.broadcast(file.read())
    rest = without(docs, ["text", "piece", "start", "length", "ids"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("_row") if rest.columns else F.struct(F.lit(0).alias("_none")).alias("_row"), F.col("text").alias("_text"))
    kinds = f"_row {rows.schema['_row'].dataType.simpleString()}, piece long, start long, length long, ids binary"
    found = rows.mapInArrow(_pieces(given, pattern, end, capacity, ["_row"]), kinds)
    return found.select(*unpacked(rest.columns), "piece", "start", "length", "ids")


# ---------------------------------------------------------------- packing within a task


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: by falling size, each piece into the open bin that it fills most, or a new one.

    ``free`` has a bit for every room that some bin has left, so the tightest
    fit is its lowest bit at or above the size.
    """
    bins: list[list[int]] = []
    of_room: dict[int, list[int]] = {}
    free = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = of_room[room].pop()
            if not of_room[room]:
                free &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            of_room.setdefault(left, []).append(at)
            free |= 1 << left
    return bins


class Exchange:
    """The open bins of a shard, and what each could give: its sizes and the sums of two of its sizes.

    ``single`` and ``double`` name for every size or sum the bins that hold it,
    and a bit set names the sizes and sums there are, so the largest that is not
    above a limit is one look. A bin has few distinct sizes, as they add up to
    no more than its capacity.
    """

    def __init__(self, bins: list[dict[int, list[int]]], capacity: int):
        self.bins, self.capacity = bins, capacity  # a bin: size -> numbers of its pieces
        self.fill = [sum(n * len(who) for n, who in b.items()) for b in bins]
        self.single: dict[int, dict[int, None]] = {}
        self.double: dict[int, dict[int, int]] = {}  # sum -> bin -> the smaller of the two sizes
        self.singles = self.doubles = 0
        for at in range(len(bins)):
            self.offer(at)

    def pairs(self, at: int) -> Iterator[tuple[int, int]]:
        own = sorted(self.bins[at])
        for i, x in enumerate(own):
            for y in own[i + (len(self.bins[at][x]) < 2) :]:
                yield x, y

    def offer(self, at: int) -> None:
        for n in self.bins[at]:
            self.single.setdefault(n, {})[at] = None
            self.singles |= 1 << n
        for x, y in self.pairs(at):
            self.double.setdefault(x + y, {})[at] = x
            self.doubles |= 1 << (x + y)

    def withdraw(self, at: int) -> None:
        for n in self.bins[at]:
            held = self.single[n]
            held.pop(at, None)
            if not held:
                self.singles &= ~(1 << n)
        for x, y in self.pairs(at):
            held = self.double[x + y]
            held.pop(at, None)
            if not held:
                self.doubles &= ~(1 << (x + y))

    def shift(self, source: int, target: int, sizes: tuple[int, ...]) -> None:
        for n in sizes:
            who = self.bins[source][n]
            self.bins[target].setdefault(n, []).append(who.pop())
            if not who:
                del self.bins[source][n]
            self.fill[source] -= n
            self.fill[target] += n

    def best(self, at: int) -> tuple | None:
        """The exchange that fills this bin most: (gain, bin, what comes, what goes). All bins on offer are less full, so any gain adds to the squared fill."""
        room, found = self.capacity - self.fill[at], None

        def look(gone: tuple[int, ...], double: bool) -> None:
            nonlocal found
            out = sum(gone)
            held = (self.doubles if double else self.singles) & ((1 << (out + room + 1)) - 1)
            n = held.bit_length() - 1
            if n > out and (found is None or n - out > found[0]):
                if double:
                    other, x = next(iter(self.double[n].items()))
                    found = (n - out, other, (x, n - x), gone)
                else:
                    found = (n - out, next(iter(self.single[n])), (n,), gone)

        look((), False)
        for n in list(self.bins[at]):
            if found and found[0] == room:
                return found
            look((n,), False)
            look((n,), True)
        for pair in self.pairs(at):
            if found and found[0] == room:
                return found
            look(pair, False)
        return found

    def fill_up(self) -> bool:
        """One pass: every bin, the fullest first, takes the exchanges that fill it most, then leaves the offer. Whether anything changed."""
        changed = False
        for at in sorted(range(len(self.bins)), key=lambda i: -self.fill[i]):
            if not self.bins[at]:
                continue
            self.withdraw(at)
            while self.fill[at] < self.capacity and (step := self.best(at)):
                _, other, comes, goes = step
                self.withdraw(other)
                self.shift(other, at, comes)
                self.shift(at, other, goes)
                self.offer(other)
                changed = True
        return changed


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search on the bins that are not full: pieces move, or one or two of them change places with one, as long as the squared fill grows."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    done = [b for b, n in zip(bins, fill) if n == capacity]
    rest: list[dict[int, list[int]]] = []
    for b, n in zip(bins, fill):
        if n < capacity:
            rest.append({})
            for i in b:
                rest[-1].setdefault(sizes[i], []).append(i)
    for _ in range(PASSES):
        search = Exchange(rest, capacity)
        changed = search.fill_up()
        full = [n == capacity for n in search.fill]
        done += [[i for who in b.values() for i in who] for b, f in zip(rest, full) if f]
        rest = [b for b, f in zip(rest, full) if b and not f]
        if not changed:
            break
    return done + [[i for who in b.values() for i in who] for b in rest]


def packed_bins(sizes: list[int], bins: list[list[int]] | None, capacity: int) -> list[list[int]]:
    """Best fit and local search; bins that there are already are improved too, and stay where that gives fewer."""
    ways = [improve(best_fit(sizes, capacity), sizes, capacity)]
    if bins:
        ways.append(improve(bins, sizes, capacity))
    square = lambda way: sum(sum(sizes[i] for i in b) ** 2 for b in way)
    return min(ways, key=lambda way: (len(way), -square(way)))


# ---------------------------------------------------------------- packing on Spark


def _shard(capacity: int, turn: int, payload: list[str]):
    """All rows of a shard -> the same rows with the sequence, place and openness of their bin; a task holds one shard, which has a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        rows = pa.Table.from_batches(given).combine_chunks()
        order = np.argsort(rows.column("_id").to_numpy())  # whatever order the shuffle brought them in
        rows = rows.take(pa.array(order))
        sizes = rows.column("_n").to_pylist()
        shard = rows.column("_shard")[0].as_py()
        bins = None
        if turn:
            held: dict[int, list[int]] = {}
            for i, s in enumerate(rows.column("_sequence").to_pylist()):
                held.setdefault(s, []).append(i)
            bins = list(held.values())
        sequence, offset, still = (np.empty(len(sizes), t) for t in (np.int64, np.int64, bool))
        for at, members in enumerate(packed_bins(sizes, bins, capacity)):
            total = 0
            for i in sorted(members):
                sequence[i], offset[i] = turn + 1 << 58 | shard << 28 | at, total
                total += sizes[i]
            still[members] = total < capacity
        columns = [rows.column(c) for c in payload]
        columns += [pa.chunked_array([pa.array(c)]) for c in (sequence, offset, still)]
        yield from pa.table(columns, [*payload, "_sequence", "_offset", "_open"]).to_batches()

    return run


def pack(rows: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """``rows`` with sequence_id and offset: every row of length 1 to ``capacity`` lies in one sequence, gapless, no sequence holds more.

    Rows as long as a sequence have one of their own and never move. The others
    are dealt by hash to shards of about ``shard`` rows; a task packs its shard
    by best fit and improves it by moves and swaps between sequences that are
    not full. Sequences still not full are dealt anew, as wholes, to fewer
    shards and improved again, until one shard held them all or a round emptied
    none. A shard's size is a bound, whatever the input holds: equal rows are
    dealt apart by their number in the table that is written first.

    Rows with a length that is null, below 1 or above ``capacity`` have null in
    both columns; repeated rows are packed one by one; columns named sequence_id
    or offset are replaced. Over the same files every run gives the same result.
    """
    columns = without(rows, ["sequence_id", "offset"]).columns
    fits = F.col("_n").between(1, capacity)
    given = packed(rows).withColumn("_n", F.col("_row.length").cast("long")).withColumn("_id", F.monotonically_increasing_id())
    given = stored(given, "pieces")
    kind = given.schema["_row"].dataType.simpleString()
    none = F.lit(None).cast("long")
    whole = given.where(F.col("_n") == capacity).select("_row", F.col("_id").alias("_sequence"), F.lit(0).cast("long").alias("_offset"))
    parts = [whole, given.where(~F.coalesce(fits, F.lit(False))).select("_row", none.alias("_sequence"), none.alias("_offset"))]
    rest = given.where(F.col("_n").between(1, capacity - 1)).select("_row", "_n", "_id", none.alias("_sequence"))
    count, bins = rest.count(), None
    payload = ["_row", "_n", "_id"]
    for turn in range(ROUNDS):
        if not count:
            break
        shards = -(-count // shard)
        unit = F.col("_id") if not turn else F.col("_sequence")
        dealt = rest.withColumn("_shard", F.pmod(F.xxhash64(unit, F.lit(turn)), F.lit(shards)).cast("int")).repartitionById(shards, "_shard")
        placed = stored(dealt.mapInArrow(_shard(capacity, turn, payload), f"_row {kind}, _n long, _id long, _sequence long, _offset long, _open boolean"), "placed")
        sums = placed.agg(F.count_if("_open").alias("count"), F.count_if(F.col("_open") & (F.col("_offset") == 0)).alias("open"), F.count_if(F.col("_offset") == 0).alias("all")).collect()[0]
        over = shards == 1 or sums["count"] == 0 or turn + 1 == ROUNDS or (bins is not None and sums["all"] >= bins)
        parts.append((placed if over else placed.where("NOT _open")).select("_row", "_sequence", "_offset"))
        if over:
            break
        rest, count, bins = placed.where("_open").drop("_open", "_offset"), sums["count"], sums["open"]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select(*unpacked(columns), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces) of packed pieces: the ids of a sequence in order, at most a sequence's capacity in a row."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = placed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(members.alias("_members"))
    joined = F.aggregate("_members", F.lit(b""), lambda done, m: F.concat(done, m["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.size("_members").cast("long").alias("n_pieces"))
