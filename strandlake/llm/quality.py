"""Operator 8: document quality with hierarchical empirical Bayes.

Two logistic models, of quality and of toxicity, are fitted on a bounded sample
of labelled documents: presence of the words and signs that tell the classes
apart best, and a few figures of a text's shape.  Every document is then scored
where it is.  Hosts and paths get posteriors by grouped sums over all documents:
a path's mean is shrunk toward its host's, a host's toward the global one, each
by a weight estimated from the variance of scores within groups and the spread
between them (method of moments), so sparse sites say little.  A document's final
odds are its own evidence times the prior odds of its path, which are those of
the other documents there: its own score is taken out of the sums first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, nested, require, texts

#: Labelled documents that the models are fitted on, at most: those of the lowest hash of doc_id.
SAMPLE = 5_000
#: Words and signs that a model may weigh.
FEATURES = 1_500
MIN_DOCS = 4
#: Rows of site statistics that are broadcast; more are joined by a salted shuffle.
BROADCAST_SITES = 100_000
SALTS = 16
#: Lengths of word beginnings that count as features.
PREFIXES = (3, 5, 7)
HEADS = ("quality", "toxic")

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: What ``classify`` adds.
RESULTS = ("p_quality", "p_toxic", "site_quality", "site_toxic", "keep")
SHAPES = ("log_words", "distinct", "repeats", "signs", "capitals", "digits", "word_length", "line_repeats")


def _distinct(text: str) -> set[str]:
    """Lower-case words, their beginnings, and runs of signs."""
    words = set(_TOKEN.findall(text.lower()))
    return words | {f"^{w[:n]}" for n in PREFIXES for w in words if len(w) > n}


def tokens_of(text: str) -> np.ndarray:
    """CRC-32 of each distinct lower-case word, word beginning or run of signs."""
    return np.fromiter(map(zlib.crc32, map(str.encode, _distinct(text))), np.uint32).view(np.int32)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each character of the basic plane: 1 if it is no letter or digit, 2 if upper-case, 4 if a digit."""
    return np.array([(not c.isalnum()) + 2 * c.isupper() + 4 * c.isdigit() for c in map(chr, range(1 << 16))], np.uint8)


def _kind_counts(letters: str) -> list[int]:
    """Signs, capitals and digits of a text."""
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = codes[codes < 1 << 16]
    counts = np.bincount(_kinds()[plain], minlength=8)
    for c in () if len(plain) == len(codes) else filter(lambda c: ord(c) >> 16, letters):
        counts[(not c.isalnum()) + 2 * c.isupper() + 4 * c.isdigit()] += 1
    return [int(counts[[k for k in range(8) if k & bit]].sum()) for bit in (1, 2, 4)]


def shape_of(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(SHAPES)
    letters = "".join(words)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)) / 5,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        *(k / len(letters) for k in _kind_counts(letters)),
        min(20.0, len(text) / n) / 10,
        1 - len(set(lines)) / max(1, len(lines)),
    ]


class LogisticModel:
    """Weights of token hashes and shapes; small enough to go with every task."""

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, shapes: np.ndarray, centre: np.ndarray, scale: np.ndarray, bias: float):
        self.weights = dict(zip(tokens.tolist(), weights.tolist()))
        self.shapes, self.centre, self.scale, self.bias = shapes, centre, scale, bias

    def logit(self, tokens: Iterable[int], shape: np.ndarray) -> float:
        weights = self.weights
        evidence = sum([weights[t] for t in tokens if t in weights])
        return float(np.clip(self.bias + evidence + (np.clip((shape - self.centre) / self.scale, -6, 6) * self.shapes).sum(), -30, 30))


class _Telling:
    """The tokens of a text that some model weighs; most tokens are none."""

    def __init__(self, models: dict[str, LogisticModel]):
        self.known = {t & 0xFFFFFFFF: t for m in models.values() for t in m.weights}

    def of(self, text: str) -> list[int]:
        known = self.known
        return sorted([known[t] for t in known.keys() & map(zlib.crc32, map(str.encode, _distinct(text)))])


def fit(tokens: list[np.ndarray], shapes: np.ndarray, labels: np.ndarray, *, features: int = FEATURES, rounds: int = 800, lasso: float = 0.0003, ridge: float = 0.003) -> LogisticModel:
    """Logistic regression over the tokens with the highest chi-square.

    The lasso leaves a token weightless unless it explains what others do not, so
    words that merely travel with a telling word, as in copies, get none.
    """
    n = len(labels)
    positive = labels.sum()
    centre, scale = (shapes.mean(0), shapes.std(0) + 1e-3) if n else (np.zeros(len(SHAPES)), np.ones(len(SHAPES)))
    if n == 0 or positive in (0, n):
        # one class only: its share, smoothed
        share = (positive + 0.5) / (n + 1)
        return LogisticModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(len(SHAPES)), centre, scale, float(np.log(share / (1 - share))))
    rows = np.repeat(np.arange(n), [len(t) for t in tokens])
    ids, column = np.unique(np.concatenate(tokens), return_inverse=True)
    seen = np.bincount(column, minlength=len(ids)).astype(float)
    with_label = np.bincount(column, labels[rows], len(ids))
    expected = seen * positive / n
    score = (with_label - expected) ** 2 / (expected * (1 - positive / n) + 1e-9)
    score[seen < MIN_DOCS] = -1
    chosen = np.argsort(-score, kind="stable")[:features]
    chosen = chosen[score[chosen] > 4]
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    rows, column = rows[keep], place[column[keep]]
    z = np.clip((shapes - centre) / scale, -6, 6)
    w, v, bias = np.zeros(len(chosen)), np.zeros(z.shape[1]), float(np.log(positive / (n - positive)))
    gw, gv, gb = np.full(len(w), 1e-6), np.full(len(v), 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[column], n) + z @ v, -30, 30)))
        error = p - labels
        dw = np.bincount(column, error[rows], len(w)) / n
        dv, db = z.T @ error / n + ridge * v, error.mean()
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        rate = 1.0 / np.sqrt(gw)
        w -= rate * dw
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * lasso)
        v -= 0.3 * dv / np.sqrt(gv)
        bias -= 0.3 * db / np.sqrt(gb)
    return LogisticModel(ids[chosen][w != 0], w[w != 0], v, centre, scale, float(bias))


def _features(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = texts(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [pa.array([tokens_of(t) for t in rows], pa.list_(pa.int32())), pa.array([shape_of(t) for t in rows], pa.list_(pa.float64())), *batch.columns[2:]],
            ["tokens", "shape", *batch.schema.names[2:]],
        )

    return map_arrow(docs, run, "tokens array<int>, shape array<double>, quality int, toxic int")


def fit_models(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> dict[str, LogisticModel]:
    """A model for each head, from at most ``sample`` labelled documents: of rows that share a doc_id the least text counts."""
    require(labels, "doc_id", *HEADS)
    picked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.min(h).cast("int").alias(h) for h in HEADS])
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *HEADS).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", *HEADS)
    rows = _features(labelled).toArrow()
    lists = rows.column("tokens").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    tokens = [values[a:b] for a, b in zip(offsets, offsets[1:])]
    shapes = np.array(rows.column("shape").to_pylist(), float).reshape(len(tokens), len(SHAPES))
    # Copies of a document say a thing once.
    _, first = np.unique([zlib.crc32(np.sort(t).tobytes()) for t in tokens] or np.zeros(0), return_index=True)
    models = {}
    for head in HEADS:
        y = rows.column(head).to_pylist()
        use = [i for i in first.tolist() if y[i] is not None]
        models[head] = fit([tokens[i] for i in use], shapes[use], np.array([float(y[i] > 0) for i in use]))
    return models


def score_documents(rows: DataFrame, models: dict[str, LogisticModel], keep_text: bool) -> DataFrame:
    """``rows`` (doc, host, path; doc has text) with a logit for each head, of a text's own evidence; a narrow map."""
    fields = rows.schema["doc"].dataType.fields
    at = [f.name for f in fields].index("text")
    kept = [i for i in range(len(fields)) if keep_text or i != at]

    kept_words: list[_Telling] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept_words:
            kept_words.append(_Telling(models))
        out: list[list[float]] = [[] for _ in HEADS]
        columns = batch.column(0).flatten()
        for text in texts(columns[at]):
            tokens, shape = kept_words[0].of(text), np.array(shape_of(text))
            for scores, head in zip(out, HEADS):
                scores.append(models[head].logit(tokens, shape))
        doc = batch.column(0) if keep_text else pa.StructArray.from_arrays([columns[i] for i in kept], fields=[batch.schema.field(0).type.field(i) for i in kept])
        return pa.RecordBatch.from_arrays([doc, *batch.columns[1:], *(pa.array(x, pa.float64()) for x in out)], [*batch.schema.names, *(f"logit_{h}" for h in HEADS)])

    schema = T.StructType([T.StructField("doc", T.StructType([fields[i] for i in kept])), *rows.schema.fields[1:], *(T.StructField(f"logit_{h}", T.DoubleType()) for h in HEADS)])
    return map_arrow(rows, run, schema)


def _chance(head: str) -> Column:
    return 1 / (1 + F.exp(-F.col(f"logit_{head}")))


def _weight(total: Column, squares: Column, n: Column, prior: Column) -> Column:
    """How many documents a prior counts for: variance within groups over that between them.

    The variance within is the pooled one of the scores; the squared distance of a
    group's mean from its prior is, on average, the variance between groups plus
    that within over the group's size.
    """
    within = F.greatest(F.sum(squares - total * total / n) / F.greatest(F.sum(n) - F.count(F.lit(1)), F.lit(1.0)), F.lit(0.0))
    between = (F.sum(n * (total / n - prior) * (total / n - prior)) - F.count(F.lit(1)) * within) / F.sum(n)
    return F.least(F.greatest(within / F.greatest(between, F.lit(1e-9)), F.lit(1.0)), F.lit(1e6))


def site_sums(scored: DataFrame) -> tuple[DataFrame, dict[str, float], dict[str, tuple[float, float]]]:
    """(host, path; documents and sums of scores of both), the global means, and the weights of hosts' and paths' priors."""
    sums = [x for h in HEADS for x in (F.sum(_chance(h)).alias(f"s_{h}"), F.sum(_chance(h) * _chance(h)).alias(f"q_{h}"))]
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"{x}_{h}").alias(f"h{x}_{h}") for h in HEADS for x in "sq"])
    total = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"hs_{h}").alias(h) for h in HEADS]).first()
    means = {h: min(1 - 1e-6, max(1e-6, (total[h] or 0.0) / total["n"])) if total["n"] else 0.5 for h in HEADS}
    host_weight = hosts.agg(*[_weight(F.col(f"hs_{h}"), F.col(f"hq_{h}"), F.col("hn"), F.lit(means[h])).alias(h) for h in HEADS]).first()
    weights = {h: float(host_weight[h] or 1.0) for h in HEADS}
    sites = paths.join(hosts, "host")
    prior = {h: (F.lit(means[h] * weights[h]) + F.col(f"hs_{h}")) / (F.lit(weights[h]) + F.col("hn")) for h in HEADS}
    path_weight = sites.agg(*[_weight(F.col(f"s_{h}"), F.col(f"q_{h}"), F.col("n"), prior[h]).alias(h) for h in HEADS]).first()
    return sites.drop(*[f"{x}_{h}" for h in HEADS for x in ("q", "hq")]), means, {h: (weights[h], float(path_weight[h] or 1.0)) for h in HEADS}


def site_prior(head: str, mean: float, weights: tuple[float, float]) -> Column:
    """The posterior of a path without the document of the row itself: shrunk to that of its host, and that to the mean."""
    own = _chance(head)
    host = (F.lit(mean * weights[0]) + F.col(f"hs_{head}") - own) / (F.lit(weights[0]) + F.col("hn") - 1)
    path = (host * weights[1] + F.col(f"s_{head}") - own) / (F.lit(weights[1]) + F.col("n") - 1)
    return F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))


def _judged(docs: DataFrame, labels: DataFrame, host: str, path: str, sample: int, min_quality: float, max_toxic: float, keep_text: bool) -> DataFrame:
    """doc, a struct of the caller's columns, and ``RESULTS``."""
    require(docs, "doc_id", "text")
    models = fit_models(docs, labels, sample=sample)
    site = [(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(k) for k, c in (("host", host), ("path", path))]
    scored = materialize(score_documents(nested(docs, *site).select("doc", "host", "path"), models, keep_text), "scores")
    sites, means, weights = site_sums(scored)
    sites = materialize(sites, "sites")
    if sites.count() <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(sites), ["host", "path"])
    else:
        spread = sites.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = scored.withColumn("salt", F.pmod(F.xxhash64("logit_quality", "logit_toxic"), F.lit(SALTS)).cast("int")).join(spread, ["host", "path", "salt"])
    for head in HEADS:
        joined = joined.withColumn(f"site_{head}", site_prior(head, means[head], weights[head]))

    def chance(head: str) -> Column:
        prior = F.col(f"site_{head}")
        odds = F.col(f"logit_{head}") + F.log(prior / (1 - prior)) - float(np.log(means[head] / (1 - means[head])))
        return (1 / (1 + F.exp(-odds))).alias(f"p_{head}")

    out = joined.select("doc", chance("quality"), chance("toxic"), "site_quality", "site_toxic")
    return out.withColumn("keep", (F.col("p_quality") >= min_quality) & (F.col("p_toxic") < max_toxic))


def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", sample: int = SAMPLE, min_quality: float = 0.5, max_toxic: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs``, all columns (without text if not ``keep_text``), with p_quality, p_toxic, site priors and keep.

    ``docs`` has doc_id and text and, if there are any, columns that name a host
    and a path within it; ``labels`` has doc_id, quality and toxic (0, 1 or null).
    ``keep`` says that p_quality is at least ``min_quality`` and p_toxic below
    ``max_toxic``; a probability just at a bound is of good quality, or toxic.  Null
    and empty texts have the evidence of a text without words; null hosts and paths
    are a site of their own.  Without labels of both classes a model is the smoothed
    share of its class; a doc_id that is labelled repeatedly has the least label.
    Repeated rows are scored alike and count each; long texts are read whole; an
    empty table stays empty.  Columns of ``docs`` that are named as a result are
    replaced by it, all others stay, whatever their names.
    """
    out = _judged(docs, labels, host, path, sample, min_quality, max_toxic, keep_text)
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if (keep_text or c != "text") and c not in RESULTS], *RESULTS)


def keep_good(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", sample: int = SAMPLE, min_quality: float = 0.5, max_toxic: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with the columns of ``docs``, whatever their names."""
    return _judged(docs, labels, host, path, sample, min_quality, max_toxic, True).where("keep").select(*[F.col(f"doc.`{c}`") for c in docs.columns])
