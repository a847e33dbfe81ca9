"""Toxic spans and document scores, by a linear-chain conditional random field.

Words, their beginnings and their endings that are far more frequent in toxic documents
than in others make the lexicon, with the log of that ratio as their grade; a word has
the best grade of its parts. In labelled toxic documents such words are taken as
toxic words and all others as clean ones; that is what the field is trained on. Its
features are a word's grade and its neighbour's tag. Words outside of the lexicon all
have the same potentials, so a stretch of them is one matrix power, and the forward and
backward passes run over whole texts at the cost of their lexicon words.

A document's score is a logistic function of the marginals, summed and at most, fitted to
the labels; offending words are those whose own marginal reaches a half.

Labels are learned from a sample of ``sample`` documents at most, without those of the
held-out fold. Word counts of the sample are made in Spark; the driver gets the lexicon
(``lexicon`` words at most) and the lexicon words of each document of the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from twinline.llm.flat import lean
from twinline.session import ship, written

SAMPLE = 20_000
LEXICON = 2_000
LEAST_DOCUMENTS = 5  # toxic documents that hold a word of the lexicon
LEAST_RATIO = 20.0  # times as frequent in toxic documents
PART_LETTERS = (3, 8)  # of a word's beginnings and endings
GRADES = 8
FOLDS = 5
TRAINED_WORDS = 3_000  # of a training document that the field is fitted on, at most
SAMPLE_CHAINS = 3_000  # training documents with lexicon words that the field is fitted on
COUNTED_ROWS = 250  # documents whose words are counted together before they are sent on
CACHE_WORDS = 200_000  # words that a worker remembers the grade of


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether an id belongs to the fold that nothing is learned from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def bare(word: str) -> str:
    """A word without what is not a letter or digit, in lower case."""
    return "".join(filter(str.isalnum, word.lower()))


def parts(word: str) -> list[str]:
    """What of a word can be in the lexicon: all of it, its beginnings and its endings."""
    word = bare(word)
    if not word:
        return []
    inner = range(PART_LETTERS[0], min(PART_LETTERS[1], len(word) - 1) + 1)
    return [word, *(word[:n] + "-" for n in inner), *("-" + word[-n:] for n in inner)]


def sample_documents(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, toxic, text)`` of the ``sample`` labelled documents of least id hash, but
    for those held out. Of contradicting labels of an id, toxic counts."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # No more than ``sample`` rows of two numbers, so the documents need no shuffle.
    return docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def lexicon(rows: DataFrame, most: int) -> dict[str, float]:
    """Words and parts of words, with the log of how many times as frequent they are in
    toxic documents. Documents of equal text count once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, COUNTED_ROWS) for b in batches for at in range(0, b.num_rows, COUNTED_ROWS)):
            counts: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for word in {p for w in set(text.split()) for p in parts(w)}:
                    counts[word, toxic] = counts.get((word, toxic), 0) + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([w for w, _ in counts], pa.string()),
                    "toxic": pa.array([int(t > 0) for _, t in counts], pa.int32()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                }
            )

    rows = rows.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counted = rows.select("text", "toxic").mapInArrow(lean(words), "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )
    # A word must also be beyond chance: its toxic documents, were it as frequent in all,
    # would be about n times the share of toxic documents, give or take a few roots of that.
    n, share = F.col("bad") + F.col("good"), bad / (bad + good)
    ratio = (F.col("bad") / F.lit(bad)) / ((F.col("good") + 0.5) / F.lit(good))
    sure = F.col("bad") >= n * share + 6 * F.sqrt(n * share * (1 - share)) + LEAST_DOCUMENTS - 1
    found = counted.filter(F.col("bad") >= LEAST_DOCUMENTS).withColumn("ratio", ratio).filter((F.col("ratio") >= LEAST_RATIO) & sure)
    rows_ = found.orderBy(F.desc("bad"), F.desc("ratio"), "word").limit(most).collect()
    return {r["word"]: math.log(r["ratio"]) for r in rows_}


class Field:
    """A chain of words tagged clean (0) or toxic (1), with the trained weights."""

    def __init__(self, grades: dict[str, int], weights: np.ndarray, head: np.ndarray):
        self.grades, self.head = grades, head
        emit, step = weights[: GRADES + 1], weights[GRADES + 1 :].reshape(2, 2)
        # A word of a grade: from each tag of the word before to each of its own. Grade 0
        # is a word outside of the lexicon.
        self.move = np.array([np.exp(step + np.array([0.0, e])) for e in emit])
        self.cache: dict[str, int] = {}

    def grade(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            found = self.cache[word] = max([self.grades.get(p, 0) for p in parts(word)], default=0)
        return found

    def features(self, text: str) -> tuple[list[float], list[tuple[int, float]]]:
        """What the score is made of, and the lexicon words' places with their marginals."""
        words = text.split()
        grades = list(map(self.grade, words))
        places = [i for i, g in enumerate(grades) if g]
        if not places:
            return [0.0, 0.0, 0.0], []
        found = marginals(self.move, places, [grades[i] for i in places], len(words))
        return summary(found, len(words)), list(zip(places, found.tolist()))

    def score(self, features: list[float]) -> float:
        z = float(self.head[0] + np.dot(self.head[1:], features))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def summary(found: np.ndarray, length: int) -> list[float]:
    """The largest marginal, the log of their sum, and their share of the words."""
    return [float(found.max()), math.log1p(float(found.sum())), float(found.sum()) / max(1, length)]


def _powers(matrix: np.ndarray, n: int) -> np.ndarray:
    """matrix ** n, scaled to a largest entry of one."""
    out, base = np.eye(2), matrix / matrix.max()
    while n:
        if n & 1:
            out = out @ base
            out /= out.max()
        base = base @ base
        base /= base.max()
        n >>= 1
    return out


def marginals(move: np.ndarray, places: list[int], grades: list[int], length: int) -> np.ndarray:
    """P(toxic) of each lexicon word, by forward-backward over a whole text, stretches of words without a grade at once.

    The text begins after a clean word, and any tag may end it.
    """
    gaps = np.diff([-1, *places]) - 1
    forward, backward = [], []
    state = np.array([1.0, 0.0])
    for gap, grade in zip(gaps.tolist(), grades):
        state = state @ _powers(move[0], gap) @ move[grade]
        state = state / state.sum()
        forward.append(state)
    state = _powers(move[0], length - 1 - places[-1]) @ np.ones(2)
    for gap, grade in zip(gaps[::-1].tolist(), grades[::-1]):
        state = state / state.sum()
        backward.append(state)
        state = _powers(move[0], gap) @ (move[grade] @ state)
    both = np.array(forward) * np.array(backward[::-1])
    both /= both.sum(1, keepdims=True)
    return both[:, 1]


def _graded(ratios: dict[str, float]) -> dict[str, int]:
    """Grades 1 to GRADES by the log ratio."""
    low, high = math.log(LEAST_RATIO), max([math.log(LEAST_RATIO) + 1, *ratios.values()])
    return {w: 1 + min(GRADES - 1, int((r - low) / (high - low) * GRADES)) for w, r in ratios.items()}


def _counts(weights: np.ndarray, grades: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expected counts, in the order of the weights, of chains of words (rows, padded).

    Forward and backward over all chains side by side: toxic words of each grade, and
    steps between neighbouring tags.
    """
    n, length = grades.shape
    emit, step = weights[: GRADES + 1], weights[GRADES + 1 :].reshape(2, 2)
    move = np.array([np.exp(step + np.array([0.0, e])) for e in emit])[grades]
    forward, backward = np.zeros((n, length + 1, 2)), np.ones((n, length + 1, 2))
    forward[:, 0, 0] = 1.0
    for t in range(length):
        ahead = np.einsum("na,nab->nb", forward[:, t], move[:, t])
        forward[:, t + 1] = ahead / ahead.sum(1, keepdims=True)
    for t in range(length - 1, -1, -1):
        back = np.einsum("nab,nb->na", move[:, t], backward[:, t + 1])
        back /= back.sum(1, keepdims=True)
        backward[:, t] = np.where((t < sizes)[:, None], back, 1.0)
    steps = forward[:, :-1, :, None] * move * backward[:, 1:, None, :]
    steps /= steps.sum((2, 3), keepdims=True)
    steps *= (np.arange(length) < sizes[:, None])[:, :, None, None]
    toxic = steps[:, :, :, 1].sum(2)
    by_grade = np.bincount(grades.ravel(), weights=toxic.ravel(), minlength=GRADES + 1)
    return np.concatenate((by_grade, steps.sum((0, 1)).ravel()))


def _observed(grades: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    tags = ((grades > 0) & (toxic[:, None] > 0)).astype(int)
    before = np.column_stack((np.zeros(len(tags), int), tags[:, :-1]))
    inside = np.arange(grades.shape[1]) < sizes[:, None]
    by_grade = np.bincount(grades[inside], weights=tags[inside], minlength=GRADES + 1)
    steps = np.bincount((2 * before + tags)[inside], minlength=4)
    return np.concatenate((by_grade, steps))


def _train_field(chains: list[tuple[list[int], list[int], int, int]], rounds: int = 50) -> np.ndarray:
    """Weights by gradient ascent of the likelihood of the tags, with a little shrinkage.

    The gradient is observed less expected counts. Chains are the documents with lexicon
    words and no more than TRAINED_WORDS words.
    """
    chains = sorted((c for c in chains if c[2] <= TRAINED_WORDS), key=lambda c: c[2])
    groups = []
    for at in range(0, len(chains), 128):
        part = chains[at : at + 128]
        grades = np.zeros((len(part), part[-1][2]), np.int64)
        for row, (places, found, _, _) in enumerate(part):
            grades[row, places] = found
        groups.append((grades, np.array([c[2] for c in part]), np.array([c[3] for c in part])))
    weights = np.zeros(GRADES + 5)
    weights[GRADES + 2] = weights[GRADES + 4] = -4.0
    if not groups:
        return weights
    observed = sum(_observed(*g) for g in groups)
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        slope = (observed - sum(_counts(weights, g, n) for g, n, _ in groups)) / len(chains) - 1e-3 * weights
        slope[GRADES + 1] = 0.0  # weights are relative to staying clean
        speed += slope**2
        weights += slope / np.sqrt(speed + 1e-8)
    return weights


def _train_head(features: np.ndarray, toxic: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's steps, with a little shrinkage."""
    x = np.column_stack((np.ones(len(features)), features))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - 0.05 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = LEXICON) -> Field:
    """The field and the score's weights, from labelled documents that are not held out."""
    ship(docs.sparkSession)
    rows = written(sample_documents(docs, labels, sample), "labelled")
    grades = _graded(lexicon(rows, most))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(grades, np.zeros(GRADES + 5), np.zeros(4))
        for batch in batches:
            places, graded, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                found = list(map(field.grade, words))
                places.append([i for i, g in enumerate(found) if g])
                graded.append([g for g in found if g])
                sizes.append(len(words))
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": pa.array([int(t > 0) for t in batch.column("toxic").to_pylist()], pa.int32()),
                    "places": pa.array(places, pa.list_(pa.int32())),
                    "grades": pa.array(graded, pa.list_(pa.int32())),
                    "size": pa.array(sizes, pa.int32()),
                }
            )

    found = rows.select("text", "toxic").mapInArrow(lean(hits), "toxic int, places array<int>, grades array<int>, size int").collect()
    chains = [(list(r["places"]), list(r["grades"]), r["size"], r["toxic"]) for r in found if r["places"]]
    weights = _train_field(chains[:SAMPLE_CHAINS])
    field = Field(grades, weights, np.zeros(4))
    features = [summary(marginals(field.move, list(r["places"]), list(r["grades"]), r["size"]), r["size"]) if r["places"] else [0.0] * 3 for r in found]
    if found:
        field.head = _train_head(np.array(features), np.array([r["toxic"] for r in found], float))
    else:
        field.head = np.array([-5.0, 0.0, 0.0, 0.0])  # nothing is known of toxic texts
    return field


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``, the toxic words' places and texts.

    Columns of these names are replaced. Null and empty texts have no words and the score
    of a document without any sign. Rows are independent.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = [c for c in docs.columns if c not in ("score", "offending")]
    spans = StructType.fromDDL("offending array<struct<word:int,text:string,marginal:double>>")
    schema = StructType([*docs.select(*kept).schema, StructField("score", DoubleType()), *spans])
    kind = pa.list_(pa.struct([("word", pa.int32()), ("text", pa.string()), ("marginal", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            scores, spans = [], []
            for body in batch.column(text).to_pylist():
                features, found = field.features(body or "")
                scores.append(field.score(features))
                found = [(i, m) for i, m in found if m >= 0.5]
                words = body.split() if found else []
                spans.append([{"word": i, "text": words[i], "marginal": m} for i, m in found])
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=schema.names)

    return docs.select(*kept).mapInArrow(lean(apply), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` for each row of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. An empty table of documents
    gives an empty one; without labels of both kinds every score is the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(rows, train(rows, labels.select("doc_id", "toxic"), sample))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending"
    )
