"""Toxicity by non-negative positive-unlabelled learning over word features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

#: Bound of the confirmed toxic documents that are learnt from, in labels: those with the smallest hashes of the id. Unlabelled text has no bound.
POSITIVES = 4_000
FEATURES = 4_096
PREFIXES = (4, 5, 6)
#: Least share of the positives with a word, and least share of toxic documents among those with it, by the prior.
SUPPORT = 0.02
TELLING = 0.5
#: Training: passes over all sets of features, step, weight decay; the step back where the risk over negatives is below zero.
EPOCHS = 60
STEP = 0.25
DECAY = 1e-4
BACK = 0.1
#: Tasks of a pass, each of which sends one gradient; bins of a unit of the margin, and the margin's bound, where the threshold is chosen.
TASKS = 64
BINS, MARGIN = 50, 60

_words = re.compile(r"\w+").findall


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    return common.crc32_bucket(doc_id, modulus) == 0


def marks_of(text: str) -> set[str]:
    """Distinct lower-case words of a text, and their beginnings of PREFIXES letters, marked by a caret."""
    words = set(_words(text.lower()))
    for k in PREFIXES:
        words |= {"^" + w[:k] for w in words if len(w) > k and w[0] != "^"}
    return words


def vocabulary_of(counts: list[tuple[str, int, int]], n_p: int, n_u: int, prior: float) -> dict[str, int]:
    """word -> column of those words of counts(word, positives with it, unlabelled with it) whose share among n_p positives is most over
    that among n_u unlabelled, by standard errors."""

    def lift(p: int, u: int) -> float:
        pooled = (p + u) / (n_p + n_u)
        return (p / n_p - u / n_u) / math.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)

    # a word counts if by the prior most documents with it are toxic
    telling = [(lift(p, u), w) for w, p, u in counts if n_u and prior * p / n_p >= TELLING * (u + 1) / n_u]
    return {w: i for i, (z, w) in enumerate(sorted(telling, key=lambda x: (-x[0], x[1]))[:FEATURES]) if z > 4}


def margins(x: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set and column of each entry of sets of columns (int16 each), and the margin of each set; the last weight is the bias."""
    columns = np.frombuffer(b"".join(x), np.int16)
    of = np.repeat(np.arange(len(x)), [len(b) // 2 for b in x])
    return of, columns, np.bincount(of, weight[columns], len(x)) + weight[-1]


def risk_sums(x: list[bytes], n_p: np.ndarray, n_u: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the logistic loss, and of its gradient: of positives as positive, positives as negative, unlabelled as negative."""
    of, columns, z = margins(x, weight)
    s = 1 / (1 + np.exp(-z))
    risk = np.array([n_p @ np.logaddexp(0, -z), n_p @ np.logaddexp(0, z), n_u @ np.logaddexp(0, z)])
    gradient = np.zeros((3, len(weight)))
    for row, slope in zip(gradient, (n_p * (s - 1), n_p * s, n_u * s), strict=True):
        row[:-1] = np.bincount(columns, slope[of], len(weight) - 1)
        row[-1] = slope.sum()
    return risk, gradient


def train(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Weights and bias that minimise the non-negative risk prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) of the
    logistic loss by Adam over all the data; where the second term is negative, the step goes back along it."""
    weight = np.zeros(width + 1)
    weight[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, EPOCHS + 1):
        risk, (plus, minus, unlabelled) = sums(weight)
        negative = risk[2] / n_u - prior * risk[1] / n_p
        g_negative = unlabelled / n_u - prior * minus / n_p
        g = prior * plus / n_p + (g_negative if negative >= 0 else -BACK * g_negative)
        g[:-1] += DECAY * weight[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weight = weight - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weight


def threshold(found_p: np.ndarray, found_u: np.ndarray, prior: float) -> float:
    """The margin of least estimated error, prior * missed positives + max(0, found unlabelled - prior * found positives), from counts by bin."""
    below_p, below_u = np.cumsum(found_p) / found_p.sum(), np.cumsum(found_u) / found_u.sum()
    error = prior * below_p + np.maximum(0, 1 - below_u - prior * (1 - below_p))
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(np.median(best) + 1) / BINS - MARGIN


def _reduced(rows: DataFrame, names: list[str], start: Callable[[], object], step: Callable, finish: Callable[[object], dict], schema: str) -> DataFrame:
    """One Python state a task: start(), then step(state, *columns) for each batch, then the rows of finish(state)."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, state, some = to_arrow_schema(fields), start(), False
        for batch in batches:
            some = some or batch.num_rows > 0
            step(state, *batch.columns)
        if some:
            yield pa.RecordBatch.from_pydict(finish(state), schema=kind)
        del state
        common.release()

    return rows.select(*names).mapInArrow(run, fields)


def _positive_words(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Words that enough of the confirmed texts have, with the number of these, and the number of texts. At most 1 / SUPPORT times a text's mean number of words come to the driver."""

    def step(state, texts):
        values = texts.to_pylist()
        state[""] += len(values)
        for t in values:
            state.update(marks_of(t))

    counts = _reduced(texts, ["text"], Counter, step, lambda s: {"word": list(s), "p": list(s.values())}, "word string, p long").groupBy("word").agg(F.sum("p").alias("p"))
    counts = common.materialise(counts, "toxicity-words")
    n_p = (counts.where("word = ''").first() or {"p": 0})["p"]
    return {r["word"]: r["p"] for r in counts.where((F.col("word") != "") & (F.col("p") >= max(3, SUPPORT * n_p))).collect()}, n_p


def _background(texts: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all texts each word occurs, and the number of texts: one row of counts a task and word."""
    sent = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def step(state, texts):
        at = sent.value
        values = texts.to_pylist()
        state[len(at)] += len(values)
        for t in values:
            for w in at.keys() & marks_of(t):
                state[at[w]] += 1

    def finish(state):
        used = np.flatnonzero(state)
        return {"i": used, "u": state[used]}

    width = len(words) + 1
    out = np.zeros(width, np.int64)
    for r in _reduced(texts, ["text"], lambda: np.zeros(width, np.int64), step, finish, "i long, u long").groupBy("i").agg(F.sum("u").alias("u")).collect():
        out[r["i"]] = r["u"]
    sent.destroy()
    return out[:-1], int(out[-1])


def _columns_of(texts, vocabulary: dict[str, int]) -> list[bytes]:
    keys = vocabulary.keys()
    return [np.array(sorted(vocabulary[w] for w in keys & marks_of(t)), np.int16).tobytes() for t in texts]


def features(text: Column, vocabulary: dict[str, int]) -> Column:
    """The columns of a whole text's words in the vocabulary, in order, int16 each."""

    @F.pandas_udf("binary", F.PandasUDFType.SCALAR_ITER)
    def columns(batches):
        import pandas as pd

        for texts in batches:
            yield pd.Series(_columns_of(texts, vocabulary))
        common.release()

    return columns(text)


def probability(x: Column, model: dict) -> Column:
    weight = np.append(model["weight"], model["bias"])

    @F.pandas_udf("double")
    def scored(x):
        import pandas as pd

        return pd.Series(1 / (1 + np.exp(-margins(list(x), weight)[2])))

    return scored(x)


def probability_of_text(text: Column, model: dict) -> Column:
    """probability() of the features() of whole texts, in one function: two of unlike kinds take a task two Python workers, which live on in the executor."""
    vocabulary, weight = model["vocabulary"], np.append(model["weight"], model["bias"])

    @F.pandas_udf("double", F.PandasUDFType.SCALAR_ITER)
    def scored(batches):
        import pandas as pd

        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-margins(_columns_of(texts, vocabulary), weight)[2])))
        common.release()

    return scored(text)


def _learnt(rows: DataFrame, labels: DataFrame) -> tuple[dict, DataFrame]:
    """A model {vocabulary, weight, bias} of rows(doc_id, held, text), and doc_id, held and features x of each row, written to the shared folder."""
    marks = labels.where(~held_out(labels["doc_id"])).where("toxic is not null").select(labels["doc_id"].alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = min(max(marks.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0, 1e-4), 0.9)
    wanted = marks.where("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(POSITIVES).select("doc_id", F.lit(1).alias("positive"))
    wanted = common.materialise(wanted, "toxicity-positives")  # POSITIVES ids, so its broadcast is bounded
    learn = rows.where("not held").select("doc_id", "text")
    words, n_p = _positive_words(learn.join(F.broadcast(wanted), "doc_id", "left_semi"))
    listed = sorted(words)
    u, n_u = _background(learn, listed) if listed else (np.zeros(0), 0)
    vocabulary = vocabulary_of([(w, words[w], int(k)) for w, k in zip(listed, u, strict=True)], n_p, n_u, prior) if n_u else {}
    model = {"vocabulary": vocabulary, "weight": np.zeros(len(vocabulary)), "bias": math.log(prior / (1 - prior))}
    table = common.materialise(rows.withColumn("x", features(F.col("text"), vocabulary)).drop("text"), "toxicity-features")
    if not vocabulary:
        return model, table
    sets = table.where("not held").select("doc_id", "x").join(F.broadcast(wanted), "doc_id", "left").groupBy("x").agg(F.count("positive").alias("n_p"), F.count(F.lit(1)).alias("n_u"))
    sets = common.materialise(sets, "toxicity-sets").coalesce(TASKS)
    width = len(vocabulary)

    def sums(weight):
        def step(state, x, a, b):
            risk, gradient = risk_sums(x.to_pylist(), a.to_numpy().astype(float), b.to_numpy().astype(float), weight)
            state[0] += risk
            state[1] += gradient

        parts = _reduced(sets, ["x", "n_p", "n_u"], lambda: [np.zeros(3), np.zeros((3, width + 1))], step, lambda s: {"risk": [s[0].tobytes()], "gradient": [s[1].tobytes()]}, "risk binary, gradient binary").collect()
        return sum(np.frombuffer(r["risk"]) for r in parts), sum(np.frombuffer(r["gradient"]).reshape(3, -1) for r in parts)

    weight = train(sums, width, n_p, n_u, prior)

    def step(state, x, a, b):
        at = np.clip(((margins(x.to_pylist(), weight)[2] + MARGIN) * BINS).astype(np.int64), 0, 2 * MARGIN * BINS - 1)
        for row, n in zip(state, (a, b), strict=True):
            row += np.bincount(at, n.to_numpy(), len(row))

    found = _reduced(sets, ["x", "n_p", "n_u"], lambda: np.zeros((2, 2 * MARGIN * BINS)), step, lambda s: {"n": [s.tobytes()]}, "n binary").collect()
    found_p, found_u = sum(np.frombuffer(r["n"]).reshape(2, -1) for r in found)
    return model | {"weight": weight[:-1], "bias": float(weight[-1]) - threshold(found_p, found_u, prior)}, table


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].alias("doc_id"), held_out(docs["doc_id"]).alias("held"), common.text_of(docs).alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model of docs(doc_id, text) and labels(doc_id, toxic) outside the held-out fold: all whole texts are the unlabelled side, the confirmed ones of at
    most POSITIVES labels the positive one. The driver sees words that enough positives have, and sums."""
    return _learnt(_rows(docs), labels)[0]


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text), learnt from labels(doc_id, toxic).

    Labels of the held-out fold (crc32 of the id modulo 5 is 0; a null id counts as the empty text) are never read; nor are its texts
    in training. Only the whole text feeds a score. A null text is empty and gets the score of no words; repeated rows each get the same score; without any
    confirmed toxic document every score is the class prior's; an empty table gives no rows; other columns are ignored. Rows of features are written to the
    shared folder, from which the classifier is trained and the scores are read.
    """
    model, table = _learnt(_rows(docs), labels)
    scored = table.select("doc_id", F.col("held").alias("held_out"), probability(F.col("x"), model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; see detect() for nulls, empty texts, repeated rows and missing labels. An empty
    table gives no rows. Texts stay where they are read: their features are worked out again for the filter, which costs less than a copy of all texts."""
    model, table = _learnt(_rows(docs), labels)
    common.discard(table)
    return docs.where(probability_of_text(common.text_of(docs), model) < threshold)
