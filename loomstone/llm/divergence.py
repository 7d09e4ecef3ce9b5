"""Quality rules by distribution: character classes and common words of a text against its language, by Jensen-Shannon distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE, packed, stored, unpacked

BLANK = SPACE.encode()
SYMBOLS = b"#*$%&|<>"  # fixed value of the base rule
# Character classes by the first UTF-8 byte of a character; bytes inside a character belong to none.
CLASSES = ["lower", "upper", "digit", "blank", "stop", "mark", "symbol", "other", "wide"]
_CLASS_OF = np.full(256, -1)
for _byte in range(256):
    _c = chr(_byte)
    if _byte >= 0xC0:
        _CLASS_OF[_byte] = 8
    elif _byte < 0x80:
        _CLASS_OF[_byte] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c in SPACE else 4 if _c in ".,;:" else 5 if _c in "!?'\"()-" else 6 if _c in SYMBOLS.decode() else 7


def class_counts(raw: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen = _CLASS_OF >= 0
    return np.bincount(_CLASS_OF[seen], weights=by_byte[seen], minlength=len(CLASSES)).astype(np.int64)


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(codes) < 4:
        return 0
    pairs = codes[:-1] * (codes.max() + 1) + codes[1:]
    if codes.max() > 1 << 20:  # a third factor would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * (codes.max() + 1) + codes[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.nonzero(times[which] > 1)[0]
    covered = np.zeros(len(codes), bool)
    for step in range(3):
        covered[again + step] = True
    return int(covered.sum())


def repeated_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANK):
            seen.add(line)
    return n


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 alike, 1 disjoint. An empty side is at distance 1."""
    if not counts.sum() or not reference.sum():
        return 1.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum()
        return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(row, lang, raw text, words) of a batch, one text at a time."""
    langs = batch.column("lang").to_pylist()
    for i, text in enumerate(batch.column("text")):
        raw = (text.as_py() or "").encode("utf-8", "replace")
        yield i, langs[i], raw, raw.split()  # bytes.split() knows just the six blanks


def _heavy(share: float, tokens: int):
    """Words that make up ``share`` of a run of at most about ``tokens`` words of a language, with their count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        sizes: Counter = Counter()

        def flush(lang) -> pa.RecordBatch:
            n, own = sizes.pop(lang), counts.pop(lang)
            rows = [(lang, w, c) for w, c in own.items() if c >= share * n]
            rows.append((lang, None, n))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for _, lang, _, words in _rows(batch):
                counts.setdefault(lang, Counter()).update(words)
                sizes[lang] += len(words)
                if sizes[lang] >= tokens:
                    yield flush(lang)
        for lang in list(counts):
            yield flush(lang)

    return run


def _sums(candidates: dict):
    """Per task and language: counts of the candidate words, of all words, and of the character classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {lang: np.zeros(len(words) + 1 + len(CLASSES), np.int64) for lang, words in candidates.items()}
        places = {lang: {w: i for i, w in enumerate(words)} for lang, words in candidates.items()}
        for batch in batches:
            for _, lang, raw, words in _rows(batch):
                if lang not in total:
                    continue
                sums, place = total[lang], places[lang]
                for w in words:
                    if (at := place.get(w)) is not None:
                        sums[at] += 1
                sums[len(place)] += len(words)
                sums[len(place) + 1 :] += class_counts(raw)
        rows = [(lang, i, int(n)) for lang, sums in total.items() for i, n in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "at", "n"])

    return run


def references(docs: DataFrame, share: float = 0.004, top: int = 32, lang_share: float = 0.001, tokens: int = 1_000_000) -> dict:
    """{lang: (common words, their counts and the rest, class counts)} over all documents.

    A word is common in a language if it makes up ``share`` of its words; the
    ``top`` commonest are kept. Such a word makes up half of that in runs of
    words that hold at least half of its count, so what the runs report with at
    least ``share / 2`` of all words contains every common word and has at most
    ``2 / share`` entries a language; a second pass counts those exactly.
    Languages with less than ``lang_share`` of all words get no reference, so
    there are at most ``1 / lang_share`` of them. What reaches the driver is
    bounded by these parameters.
    """
    some = docs.select("lang", "text")
    found = stored(some.mapInArrow(_heavy(share / 2, tokens), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "heavy")
    sizes = found.where("word IS NULL AND lang IS NOT NULL").select("lang", F.col("n").alias("size"))
    all_words = found.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    kept = sizes.where(F.col("size") >= max(1.0, lang_share * all_words))
    words = found.where("word IS NOT NULL").join(kept, "lang").where(F.col("n") >= F.lit(share / 2) * F.col("size"))
    candidates: dict = {r["lang"]: [] for r in kept.collect()}
    for r in words.select("lang", "word").orderBy("lang", "word").collect():
        candidates[r["lang"]].append(bytes(r["word"]))
    summed = some.mapInArrow(_sums(candidates), "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    sums = {lang: np.zeros(len(ws) + 1 + len(CLASSES), np.int64) for lang, ws in candidates.items()}
    for r in summed.collect():
        sums[r["lang"]][r["at"]] = r["n"]
    out = {}
    for lang, ws in candidates.items():
        n = int(sums[lang][len(ws)])
        best = sorted((i for i in range(len(ws)) if sums[lang][i] >= share * n), key=lambda i: (-sums[lang][i], ws[i]))[:top]
        counts = [int(sums[lang][i]) for i in best]
        out[lang] = ([ws[i] for i in best], np.array([*counts, n - sum(counts)]), sums[lang][len(ws) + 1 :].copy())
    return out


def measure(raw: bytes, words: list[bytes], lang, refs: dict, min_words: int, min_chars: int) -> tuple:
    """Counts and distances of one text; a distance below its minimum length is null.

    A text whose language has no reference is held against the nearest one.
    """
    place: dict[bytes, int] = {}
    codes = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64)
    blanks = len(raw) - len(raw.translate(None, BLANK))
    points = int((np.frombuffer(raw, np.uint8) & 0xC0 != 0x80).sum())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    classes, char_js, word_js = class_counts(raw), None, None
    times = np.bincount(codes, minlength=len(place)) if len(codes) else np.zeros(0, np.int64)
    near = [refs[lang]] if lang in refs else list(refs.values())
    if near and points >= min_chars:
        char_js = min(js_distance(classes, r[2]) for r in near)
    if near and len(words) >= min_words:
        own = [[int(times[place[w]]) if w in place else 0 for w in r[0]] for r in near]
        word_js = min(js_distance(np.array([*c, len(words) - sum(c)]), r[1]) for c, r in zip(own, near))
    return len(words), points - blanks, symbols, repeated_lines(raw), repeated_words(codes), char_js, word_js


SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_js double, word_js double"
NAMES = [c.split()[0] for c in SCORES.split(", ")]


def _measured(refs: dict, min_words: int, min_chars: int):
    types = [pa.int64()] * 5 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(raw, words, lang, refs, min_words, min_chars) for _, lang, raw, words in _rows(batch)]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], ["doc_id", *NAMES])

    return run


def judge(docs: DataFrame, refs: dict | None = None, char_limit: float = 0.25, word_limit: float = 0.2, char_slack: float = 0.5, word_slack: float = 1.0, min_words: int = 50, min_chars: int = 200) -> DataFrame:
    """Per document of (doc_id, lang, text): the base counts, char_js, word_js, base_failed, kept.

    base_failed: fewer than 50 words, or over half of the words in windows of
    three that come again. kept: not base_failed and no distance over its limit.
    A limit widens by its slack over the root of the size (code points of words;
    words), as histograms of short texts are
    far from any reference by chance; below the minimum lengths a distance is
    null and does not judge. References come from all documents unless given.

    Null and empty texts have no words and fail the base rule. A null or rare
    language is held against the nearest reference; with no reference at all
    (no words anywhere) the distances are null. Repeated rows are judged alike.
    """
    docs = docs.select("doc_id", "lang", "text")
    refs = references(docs) if refs is None else refs
    rows = docs.mapInArrow(_measured(refs, min_words, min_chars), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORES}")
    over = lambda d, limit, slack, size: F.coalesce(F.col(d) > F.lit(limit) + F.lit(slack) / F.sqrt(F.greatest(size, F.lit(1))), F.lit(False))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    far = over("char_js", char_limit, char_slack, F.col("word_chars")) | over("word_js", word_limit, word_slack, F.col("n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents of which a row of their id is kept by ``judge``, with the columns they came with."""
    good = stored(judge(docs, **options).where("kept").select(F.col("doc_id").alias("_good")).distinct(), "kept")
    return packed(docs).join(good, F.col("_row.doc_id").eqNullSafe(F.col("_good")), "left_semi").select(*unpacked(docs.columns))
