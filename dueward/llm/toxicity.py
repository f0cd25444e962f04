"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark whole documents, so token labels come first: a word form (whole word, prefix or suffix) whose rate in toxic
training texts exceeds its rate in clean ones beyond doubt marks its tokens in toxic texts. A two-state chain over each
line is then fitted to the tagged tokens: form weights for emissions, a transition table, a start weight. Forward and
backward passes give each token's marginal; their sum, density and maximum go through a logistic calibration, fitted on
training rows that the chain has not seen. Tokens with a marginal of one half or more are the offending spans.

Training uses a bounded sample of labelled training rows: at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean rows,
chosen by a hash, with their whole texts; an id that several rows share gives one of its texts. Rows whose
``crc32(id as text) mod 5`` is 0 are held out. Forms are counted on the executors. The chain is fitted on the driver to at
most ``SEGMENTS`` sequences with a marked word and as many without one, both drawn by a hash from all lines of the sample;
a line is cut every ``SEGMENT_WORDS`` words. Those four bounds are all that limits training.
Scoring reads every whole text in one pass of map tasks: no shuffle, memory bounded by lines of one batch.

Null texts count as empty; a text without words gets the score of zero marginals. Null or repeated labels: a null counts
for nothing, a row is toxic if any of its labels says so. A null id is scored and counts as not held out. Without
both classes among the training labels every score is the share of toxic ones. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from dueward.llm.common import documents_of, stored, text_or_empty

SAMPLE_TOXIC = 2_000
SAMPLE_CLEAN = 4_000
SEGMENT_WORDS = 64
SEGMENTS = 6_000
ROUNDS = 60
TOKENS_AT_ONCE = 1 << 18
CACHE = 200_000
#: Texts whose forms are counted before the counts are handed on.
COUNTED_AT_ONCE = 200
_OUTSIDE = re.compile(r"^[\W_]+|[\W_]+$")


def forms(word: str) -> list[str]:
    """The word itself, its beginnings and its endings, without punctuation and case."""
    w = _OUTSIDE.sub("", word).lower()
    if not w:
        return []
    return [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k), *(f"{w[-k:]}$" for k in (3, 4, 5) if len(w) > k)]


@dataclass
class Model:
    """Chain weights by word form, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    start: float = 0.0
    #: Transition weights by (from, to); the first is fixed at zero.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in forms(word))


def _by_steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines by falling length; offsets of their first tokens; how many lines are alive at each step."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return order, first, alive


def _passes(e: np.ndarray, lengths: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds and backward odds of the toxic state at each token of lines laid end to end."""
    up = np.exp(np.clip(e, -30, 30))
    a = np.exp(moves)
    forward, backward = np.empty_like(up), np.ones_like(up)
    _, first, alive = _by_steps(lengths)
    for t in range(len(alive)):
        at = first[:alive[t]] + t
        if t == 0:
            forward[at] = np.exp(start) * up[at]
        else:
            r = forward[at - 1]
            forward[at] = np.clip(up[at] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r), 1e-100, 1e100)
    for t in range(len(alive) - 1, 0, -1):
        at = first[:alive[t]] + t
        x = up[at] * backward[at]
        backward[at - 1] = np.clip((a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x), 1e-100, 1e100)
    return forward, backward


def marginals(e: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Probability of the toxic state for each token."""
    if not len(e):
        return np.empty(0)
    forward, backward = _passes(e, lengths, model.start, model.moves)
    odds = forward * backward
    return odds / (1 + odds)


def _lines(text: str) -> list[list[str]]:
    return [w for w in (line.split() for line in text.split("\n")) if w]


def _counted(text: str) -> tuple[Counter, int]:
    """Tokens per form of a text, and its tokens."""
    own: Counter = Counter()
    words = Counter(text.split())
    for w, n in words.items():
        for f in forms(w):
            own[f] += n
    return own, words.total()


def form_counts(rows: DataFrame) -> DataFrame:
    """``(form, support, toxic, clean)`` over texts: texts that are toxic and have it, and its tokens by label.

    Each text counts a form three times at most; the form ``""`` carries the tokens of all texts.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_AT_ONCE):
                part = batch.slice(at, COUNTED_AT_ONCE)
                found: dict[str, list[int]] = {"": [0, 0, 0]}
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own, n = _counted(text)
                    found[""][1 if label else 2] += n
                    for f, k in own.items():
                        row = found.setdefault(f, [0, 0, 0])
                        row[0] += label
                        row[1 if label else 2] += min(k, 3)
                columns = zip(*found.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found)), *(pa.array(c, type=pa.int64()) for c in columns)], names=["form", "support", "toxic", "clean"])

    per_task = rows.select("text", "toxic").mapInArrow(counted, "form string, support long, toxic long, clean long")
    return per_task.groupBy("form").agg(*(F.sum(c).alias(c) for c in ("support", "toxic", "clean")))


def tagged_forms(rows: DataFrame, n_toxic: int) -> set[str]:
    """Forms that are far more frequent in toxic texts than in clean ones, and not in a few texts only."""
    counts = stored(form_counts(rows))
    words = counts.where("form = ''").first()
    if words is None:
        return set()
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(toxic / float(words["toxic"] + 1)) - F.log(clean / float(words["clean"] + 1))
    far = (odds >= float(np.log(8))) & (odds >= 3.5 * F.sqrt(1 / toxic + 1 / clean))
    least = max(2, min(5, n_toxic // 100))
    return {r.form for r in counts.where((F.col("form") != "") & (F.col("support") >= least) & far).select("form").collect()}


def sequences(rows: DataFrame, tagged: set[str]) -> DataFrame:
    """``(marked, toxic, words)``: every line of the texts, cut every ``SEGMENT_WORDS`` words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def is_tagged(w: str) -> bool:
            if w not in known:
                if len(known) > CACHE:
                    known.clear()
                known[w] = any(f in tagged for f in forms(w))
            return known[w]

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [line[k:k + SEGMENT_WORDS] for line in _lines(text) for k in range(0, len(line), SEGMENT_WORDS)]
                marked = [bool(label) and any(map(is_tagged, part)) for part in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marked, type=pa.bool_()), pa.array([label] * len(parts), type=pa.int32()),
                     pa.array([" ".join(part) for part in parts], type=pa.string())], names=["marked", "toxic", "words"])

    return rows.select("text", "toxic").mapInArrow(cut, "marked boolean, toxic int, words string")


def _drawn(rows: DataFrame, tagged: set[str]) -> list[tuple[list[str], int]]:
    """The sequences that the chain is fitted on: the first of each kind by a hash."""
    hashed = stored(sequences(rows, tagged).withColumn("h", F.xxhash64("words")))
    order = ("h", "words", "toxic")
    drawn = hashed.where("marked").orderBy(*order).limit(SEGMENTS).unionByName(
        hashed.where("NOT marked").orderBy(*order).limit(SEGMENTS))
    return sorted((r.words.split(), r.toxic) for r in drawn.collect())


def _fit_chain(drawn: list[tuple[list[str], int]], tagged: set[str]) -> Model:
    """Gradient ascent (Adam) on the chain's likelihood, with a quadratic penalty."""
    chosen = [words for words, _ in drawn]
    if not chosen:
        return Model()
    marks: dict[str, bool] = {w: any(f in tagged for f in forms(w)) for w in {w for words in chosen for w in words}}
    labels = [int(label == 1 and marks[w]) for words, label in drawn for w in words]
    seen: dict[str, int] = {}
    token = np.array([seen.setdefault(w, len(seen)) for line in chosen for w in line], dtype=np.int64)
    y = np.array(labels, dtype=np.float64)
    lengths = np.array([len(line) for line in chosen], dtype=np.int64)
    of_type = [forms(w) for w in seen]
    frequent = Counter(f for fs in of_type for f in dict.fromkeys(fs))
    index = {f: k for k, f in enumerate(f for f, n in frequent.items() if n >= 2 or f in tagged)}
    rows = np.array([k for k, fs in enumerate(of_type) for f in fs if f in index], dtype=np.int64)
    cols = np.array([index[f] for fs in of_type for f in fs if f in index], dtype=np.int64)
    nf, nt = len(index), len(seen)
    theta = np.zeros(nf + 5)
    theta[nf] = -3.0
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(token), dtype=bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    seen_moves = np.array([np.sum((y[later - 1] == i) & (y[later] == j)) for i in (0, 1) for j in (0, 1)], dtype=float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, moves = theta[:nf], np.append(0.0, theta[nf + 2:]).reshape(2, 2)
        by_type = np.bincount(rows, weights=weights[cols], minlength=nt) + theta[nf]
        e = by_type[token]
        forward, backward = _passes(e, lengths, theta[nf + 1], moves)
        p = forward * backward / (1 + forward * backward)
        grad = np.zeros_like(theta)
        gap = y - p
        grad[:nf] = np.bincount(cols, weights=np.bincount(token, weights=gap, minlength=nt)[rows], minlength=nf)
        grad[nf] = gap.sum()
        grad[nf + 1] = gap[first].sum()
        x = np.exp(np.clip(e[later], -30, 30)) * backward[later]
        r, a = forward[later - 1], np.exp(moves)
        joint = np.stack([np.full_like(r, a[0, 0]), a[0, 1] * x, a[1, 0] * r, a[1, 1] * r * x])
        grad[nf + 2:] = (seen_moves - (joint / joint.sum(axis=0)).sum(axis=1))[1:]
        grad -= 0.5 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    kept = {f: float(theta[k]) for f, k in index.items() if abs(theta[k]) > 0.02}
    return Model(kept, float(theta[nf]), float(theta[nf + 1]), np.append(0.0, theta[nf + 2:]).reshape(2, 2))


def _summary(p: np.ndarray) -> tuple[float, float, float]:
    """Of a text's marginals: their sum and density, and the largest."""
    if not len(p):
        return 0.0, 0.0, 0.0
    strong = float(p[p >= 0.05].sum())
    return float(np.log1p(strong)), float(np.log1p(200 * strong / (len(p) + 20))), float(p.max())


def _scores(x: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ calibration[:3] + calibration[3], -40, 40)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(4)
    penalty = np.diag([0.05, 0.05, 0.05, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
    return w


def fit(rows: DataFrame) -> Model:
    """A model from :func:`training_rows`: two of three rows for the chain, the third for the calibration."""
    count, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == count or toxic < 3:
        return Model(constant=(toxic / count if count else 0.0))
    chain, rest = rows.where("nth % 3 <> 0"), rows.where("nth % 3 = 0")
    tagged = tagged_forms(chain, toxic * 2 // 3)
    model = _fit_chain(_drawn(chain, tagged), tagged)
    found = sorted((r.x, r.toxic) for r in _summaries(rest, model).collect())
    model.calibration = _calibrate(np.array([x for x, _ in found]), np.array([y for _, y in found], dtype=float))
    return model


def _summaries(rows: DataFrame, model: Model) -> DataFrame:
    """``(x, toxic)``: the figures of each text that the calibration weighs."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = lru_cache(CACHE)(model.emission)
        for batch in batches:
            x = [_summary(_marginals_of(_lines(text), emission, model)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return rows.select("text", "toxic").mapInArrow(summed, "x array<double>, toxic int")


def _marginals_of(lines: list[list[str]], emission, model: Model) -> np.ndarray:
    e = np.array([emission(w) for line in lines for w in line])
    return marginals(e, np.array([len(line) for line in lines], dtype=np.int64), model)


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(text, toxic, nth)``: the first labels of each class by a hash of the id, with one whole text each.

    The sampled ids are the only thing that is broadcast; their number is bounded by the sample. The rows are stored.
    """
    known = labels.where("toxic IS NOT NULL").groupBy(id_column).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(id_column))
    chosen = known.withColumn("h", F.xxhash64(id_column))
    first = chosen.where("toxic = 1").orderBy("h", id_column).limit(SAMPLE_TOXIC).unionByName(
        chosen.where("toxic = 0").orderBy("h", id_column).limit(SAMPLE_CLEAN))
    texts = documents_of(docs, id_column, text_column).join(F.broadcast(first), id_column).select(
        "h", "toxic", text_or_empty(text_column).alias("text"))
    one = texts.groupBy("h", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    within = Window.partitionBy("toxic").orderBy("h")
    return stored(one.select("text", "toxic", F.row_number().over(within).alias("nth")))


def score(docs: DataFrame, model: Model, text_column: str = "text", score_name: str = "score", spans_name: str = "spans") -> DataFrame:
    """``docs`` with the score and the spans of every whole text; spans are (start, end, marginal) in code points."""
    text_at = docs.columns.index(text_column)
    schema = StructType([*docs.schema.fields, StructField(score_name, DoubleType()), StructField(spans_name, ArrayType(StructType([
        StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("marginal", DoubleType())])))])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}

        def emissions(words: list[str]) -> list[float]:
            found = list(map(held.get, words))
            if None in found:
                if len(held) > CACHE:
                    held.clear()
                for k, x in enumerate(found):
                    if x is None:
                        w = words[k]
                        found[k] = held[w] = model.emission(w)
            return found

        def done(texts: list[str]) -> tuple[list, list]:
            e, lengths, ends = [], [], []
            for text in texts:
                for line in _lines(text):
                    e.extend(emissions(line))
                    lengths.append(len(line))
                ends.append(len(e))
            p = marginals(np.array(e), np.array(lengths, dtype=np.int64), model)
            x, spans, first = [], [], 0
            for text, last in zip(texts, ends):
                own = p[first:last]
                first = last
                x.append(_summary(own))
                hit = np.flatnonzero(own >= 0.5)
                if len(hit):
                    places = list(re.finditer(r"\S+", text))
                    spans.append([{"start": places[k].start(), "end": places[k].end(), "marginal": float(own[k])} for k in hit])
                else:
                    spans.append([])
            return list(_scores(np.array(x), model.calibration)), spans

        for batch in batches:
            column, scores, spans, at = batch.column(text_at), [], [], 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at < batch.num_rows and size < 6 * TOKENS_AT_ONCE:
                    texts.append(column[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                if model.constant is None:
                    s, found = done(texts)
                else:
                    s, found = [model.constant] * len(texts), [[]] * len(texts)
                scores += s
                spans += found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, type=pa.float64()), pa.array(spans, type=span_type)], names=schema.names)

    return docs.mapInArrow(scored, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted, n_spans, spans)``, trained on the labelled rows that are not held out."""
    model = fit(training_rows(docs, labels, id_column, text_column))
    return score(documents_of(docs, id_column, text_column), model, text_column).select(
        id_column, held_out(id_column).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"), "spans")
