"""Toxicity by a weighted finite-state grammar over clauses, its insult lexicon and final weights learned from labelled rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import small_batches, stored

# Seed lexicon; the labels add to the insults.
INSULTS = frozenset("idiot idiots moron morons stupid imbecile loser losers scum trash garbage worthless pathetic disgusting clown clowns dumb fool filth dumm idiotisch idiota estúpido imbécil".split())
THREATS = frozenset("kill hurt destroy beat smash murder burn crush töten tuer matar".split())
INTENTS = frozenset("will shall gonna going must should werde werden vais voy".split())
TARGETS = frozenset("you your yours yourself they them their he she him her du dich dein ihr euch tu toi vous tú usted ustedes".split())
NEGATIONS = frozenset("not never no nobody none neither nicht kein keine nie pas jamais aucun nunca ningún ninguna".split())
CONTRACTED = frozenset("isn aren wasn weren don doesn didn".split())
REPORTS = frozenset("said says say wrote writes called calls quoted quote claimed claims alleged reportedly accused sagte schrieb nannte dit écrit dijo escribió llamó".split())

# Words, clause ends and quotation marks; a straight mark opens after a blank and before a word, and closes elsewhere (``symbols``).
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n“”„«»\"]")
LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)  # lengths of the beginnings that a learned entry may stand for
STATS = ["any_match", "log_mass", "strongest"]


def stems(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Lexicon:
    """Weights of insults: of whole words, and of beginnings of words."""

    def __init__(self, learned: dict[str, float], seed_weight: float = 3.0):
        self.whole = {w: seed_weight for w in INSULTS} | {w: x for w, x in learned.items() if not w.endswith("*")}
        self.begin = {w[:-1]: x for w, x in learned.items() if w.endswith("*")}
        self.cues = self.whole.keys() | THREATS

    def weight(self, word: str) -> float:
        own = [self.whole.get(word, 0.0)]
        own += [self.begin.get(word[:n], 0.0) for n in STEMS if len(word) > n]
        return max(own)

    def any_cue(self, words: set[str]) -> bool:
        if not words.isdisjoint(self.cues):
            return True
        return bool(self.begin) and any(w[:n] in self.begin for w in words for n in STEMS if len(w) > n)


# ---------------------------------------------------------------- the grammar

# Symbol classes. A word is of the first list that holds it; ``end`` closes a clause, ``line`` a clause and all that is open.
CLASSES = ["word", "intent", "threat", "target", "negation", "contracted", "report", "open", "close", "comma", "colon", "end", "line"]
SYMBOL = {w: c for c, words in (("report", REPORTS), ("contracted", CONTRACTED), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("intent", INTENTS)) for w in words}
SYMBOL |= {"“": "open", "„": "open", "«": "open", "”": "close", "»": "close", ",": "comma", ":": "colon", "\n": "line", **dict.fromkeys(".!?;", "end")}


class Transducer:
    """Arcs (state, symbol class, next state, weight) and a final weight per state; state 0 is the first.

    A class without an arc takes the state's arc for "*", and without that one
    stays. An arc's weight goes to the match it reads, a final weight to the
    clause that ends there.
    """

    def __init__(self, arcs: list[tuple[int, str, int, float]], final: dict[int, float] | None = None):
        self.arcs = {(state, symbol): (then, weight) for state, symbol, then, weight in arcs}
        self.states = 1 + max(max(a, b) for a, _, b, _ in arcs)
        self.final = final or {}

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "*")) or (state, 1.0)

    def last(self, state: int) -> float:
        return self.final.get(state, 1.0)


def countdown(first: int, words: int, weight: float, silent: set[str]) -> list[tuple[int, str, int, float]]:
    """Arcs of states that last ``words`` words: from ``first`` + words - 1 down to ``first``, then 0. What is silent passes without counting."""
    arcs = [(first + i, "*", first + i - 1 if i else 0, weight) for i in range(words)]
    return arcs + [(first + i, s, first + i, weight) for i in range(words) for s in silent]


CLOSERS = ("colon", "end", "line")
MARKS = {"open", "close", "comma"}
GRAMMAR = {
    # An insult is one state: the lexicon has its weight.
    "insult": Transducer([(0, "word", 0, 1.0)]),
    # Harm within three words of an intent weighs 4, harm alone 1.
    "threat": Transducer(
        [(0, "intent", 3, 1.0), *countdown(1, 3, 1.0, MARKS)]
        + [(s, "intent", 3, 1.0) for s in (1, 2, 3)] + [(s, "threat", s - 1, 4.0) for s in (1, 2, 3)] + [(s, c, 0, 1.0) for s in (1, 2, 3) for c in CLOSERS]
    ),
    # A clause that addresses or names somebody weighs half as much again.
    "target": Transducer([(0, "target", 1, 1.0), *((1, c, 0, 1.0) for c in CLOSERS)], {1: 1.5}),
    # Within three words of a denial a match weighs a third. State 0 is fresh, at the start of a clause or after a comma, where
    # a contracted form asks and does not deny; state 4 is any place further on.
    "negation": Transducer(
        [(0, "*", 4, 1.0), (0, "negation", 3, 1.0), (0, "contracted", 4, 1.0), *((0, m, 0, 1.0) for m in MARKS), *((0, c, 0, 1.0) for c in CLOSERS)]
        + [(4, "negation", 3, 1.0), (4, "contracted", 3, 1.0), (4, "comma", 0, 1.0), *((4, c, 0, 1.0) for c in CLOSERS)]
        + [(s, "*", s - 1 or 4, 1 / 3) for s in (1, 2, 3)] + [(s, m, s, 1.0) for s in (1, 2, 3) for m in MARKS]
        + [(s, c, 3, 1 / 3) for s in (1, 2, 3) for c in ("negation", "contracted")] + [(s, c, 0, 1.0) for s in (1, 2, 3) for c in CLOSERS]
    ),
    # After a verb of saying (1) the clause counts half; so does a quotation that follows (2), over several clauses, and the
    # clause behind a colon (4). Any other quotation (3) counts in full. The end of a line closes what is open.
    "report": Transducer(
        [(0, "report", 1, 1.0), (0, "open", 3, 1.0), (1, "open", 2, 1.0), (1, "colon", 4, 1.0), (1, "end", 0, 1.0), (2, "close", 1, 1.0), (3, "close", 0, 1.0), (4, "open", 2, 1.0), (4, "end", 0, 1.0), (4, "colon", 0, 1.0)]
        + [(s, "line", 0, 1.0) for s in (1, 2, 3, 4)], {1: 0.5, 2: 0.5, 4: 0.5}
    ),
}


class Composed:
    """The transducers as one: a state is one of each, an arc's weights are theirs. States are numbered as they are reached.

    ``arc[state][class]`` is (next state, weight of a threat here, weight on any
    match here); ``last[state]`` the product of the final weights.
    """

    def __init__(self, grammar: dict[str, Transducer]):
        names = list(grammar)
        number = {(0,) * len(names): 0}
        self.arc: list[dict[str, tuple[int, float, float]]] = []
        self.last: list[float] = []
        todo = list(number)
        for states in todo:  # grows while it is read
            self.last.append(math.prod(grammar[n].last(s) for n, s in zip(names, states)))
            out = {}
            for symbol in CLASSES:
                steps = {n: grammar[n].step(s, symbol) for n, s in zip(names, states)}
                then = tuple(steps[n][0] for n in names)
                if then not in number:
                    number[then] = len(number)
                    todo.append(then)
                harm = steps["threat"][1] if symbol == "threat" else 0.0
                out[symbol] = (number[then], harm, math.prod(w for n, (_, w) in steps.items() if n != "threat"))
            self.arc.append(out)


COMPOSED = Composed(GRAMMAR)


def symbols(text: str) -> Iterator[tuple[str, str]]:
    """(token, class) of a lower-cased text."""
    for m in TOKEN.finditer(text):
        token = m[0]
        if token == '"':
            at = m.start()
            opens = (at == 0 or text[at - 1].isspace() or text[at - 1] in "([:,") and text[at + 1 : at + 2].isalnum()
            yield token, "open" if opens else "close"
        else:
            yield token, SYMBOL.get(token, "word")


def clause_scores(text: str, lexicon: Lexicon) -> list[float]:
    """Weights of the matched clauses of a lower-cased text.

    One pass of the composed transducer: a word of the lexicon emits its weight,
    a verb of harm that of its arc, the larger where it is both; other arcs
    scale the match, final weights the clause.
    """
    scores, state, mass = [], 0, 0.0
    for token, symbol in symbols(text):
        then, harm, factor = COMPOSED.arc[state][symbol]
        if symbol in CLOSERS:
            if mass:
                scores.append(mass * COMPOSED.last[state])
            mass = 0.0
        elif symbol not in MARKS and (weight := max(lexicon.weight(token), harm)):
            mass += weight * factor
        state = then
    if mass:
        scores.append(mass * COMPOSED.last[state])
    return scores


def statistics(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    low = (text or "").lower()
    if not lexicon.any_cue(set(LETTERS.findall(low))):
        return 0.0, 0.0, 0.0
    scores = clause_scores(low, lexicon)
    return float(bool(scores)), math.log1p(sum(scores)), max(scores, default=0.0)


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> per document every stem once, with a digest of the word before its first occurrence."""
    for batch in batches:
        stem, context, label = [], [], []
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            seen: dict[str, str] = {}
            before = ""
            for word in LETTERS.findall((text.as_py() or "").lower()):
                if word not in seen:
                    for s in stems(word):
                        seen.setdefault(s, before)
                before = word
            stem += seen
            context += [int.from_bytes(blake2b(b.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for b in seen.values()]
            label += [toxic] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(context, pa.int64()), pa.array(label, pa.int32())], ["stem", "context", "toxic"])


def labelled_sample(labels: DataFrame, label: str, learn: Column, size: int | dict[int, int]) -> DataFrame:
    """(doc_id, label) of at most ``size`` rows, or so many of each class, by hash of the id.

    Ids labelled twice count once, with the larger label; null ids and labels
    other than 0 and 1 teach nothing.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(f"doc_id IS NOT NULL AND {label} IN (0, 1)")
    known = known.where(learn).groupBy("doc_id").agg(F.max(label).alias(label))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if isinstance(size, int):
        return stored(known.orderBy(*order).limit(size), "sample")
    parts = [known.where(F.col(label) == c).orderBy(*order).limit(n) for c, n in size.items()]
    return stored(reduce(DataFrame.unionByName, parts), "sample")


def learn_lexicon(texts: DataFrame, least_documents: int = 3, least_contexts: int = 5, least_ratio: float = 50.0, most: int = 2000) -> dict[str, float]:
    """Weights (log ratio of document rates) of stems that toxic texts hold and others do not.

    ``texts``: (toxic, text), a bounded sample. A stem must follow several
    different words: the words of one text and its copies always follow the
    same. The ``most`` best by documents are kept.
    """
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}
    rows = texts.mapInArrow(_stem_rows, "stem string, context long, toxic int")
    bad = rows.where("toxic = 1").groupBy("stem").agg(F.count("*").alias("bad"), F.size(F.collect_set("context")).alias("contexts"))
    bad = bad.where((F.col("bad") >= least_documents) & (F.col("contexts") >= least_contexts))
    good = rows.where("toxic = 0").groupBy("stem").agg(F.count("*").alias("good"))
    ratio = ((F.col("bad") + 0.5) / (n[1] + 1)) / ((F.coalesce("good", F.lit(0)) + 0.5) / (n[0] + 1))
    found = bad.join(good, "stem", "left").withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio)
    return {r["stem"]: math.log(r["ratio"]) for r in found.orderBy(F.desc("bad"), "stem").limit(most).collect()}


def _with_statistics(lexicon_words: dict[str, float], keep: list[str], weights: np.ndarray | None = None):
    """Add the three statistics, or the score where weights are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_words)
        for batch in batches:
            x = np.array([statistics(t.as_py(), lexicon) for t in batch.column("text")], dtype=float).reshape(-1, len(STATS))
            kept = [batch.column(c) for c in keep]
            if weights is None:
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x[:, i]) for i in range(len(STATS)))], [*keep, *STATS])
            else:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(probability(x, weights)), pa.array(x[:, 1])], [*keep, "score", "mass"])

    return run


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.clip(weights[0] + x @ weights[1:], -40, 40)
    return 1 / (1 + np.exp(-z))


# Weights where the labels hold only one class: a clause with two insults or one with a target is toxic.
DEFAULT_WEIGHTS = np.array([-4.0, 1.0, 2.0, 0.2])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge (not on the constant)."""
    if len(set(y.tolist())) < 2:
        return DEFAULT_WEIGHTS
    a = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, toxic: int = 2000, clean: int = 6000) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights from at most ``toxic`` + ``clean`` labelled rows; the bound keeps the join a broadcast.

    An id that stands for several rows teaches once, with its smallest text.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, "toxic", may_learn, {1: toxic, 0: clean})
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = stored(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "texts")
    lexicon = learn_lexicon(texts)
    kinds = "toxic int, " + ", ".join(f"{c} double" for c in STATS)
    rows = texts.mapInArrow(_with_statistics(lexicon, ["toxic"]), kinds).toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in STATS], axis=1) if rows.num_rows else np.zeros((0, len(STATS)))
    return lexicon, fit_weights(x, rows.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """(doc_id, score, mass) of every row of (doc_id, text).

    mass is the log of the summed clause weights. Null and empty texts match
    nothing and score as texts without a match; repeated rows score alike; null
    ids are scored like others. Nothing but the text enters the score.
    """
    lexicon, weights = model
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_with_statistics(lexicon, ["doc_id"], weights), f"doc_id {kind}, score double, mass double")


def drop_toxic(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], limit: float = 0.5) -> DataFrame:
    """The rows whose own text scores below ``limit``, with the columns they came with; nothing is shuffled."""
    lexicon, weights = model
    small_batches(docs.sparkSession)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon)
        for batch in batches:
            at = next(i for i, c in enumerate(columns) if c.lower() == "text")
            x = np.array([statistics(t.as_py(), words) for t in batch.column(at)], dtype=float).reshape(-1, len(STATS))
            yield batch.filter(pa.array(probability(x, weights) < limit))

    return docs.mapInArrow(run, docs.schema)
