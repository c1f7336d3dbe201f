"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of each whole text: shares of kinds of characters, word lengths,
   repeated words, pairs and lines.
2. A forest of shallow trees on the labelled rows; every path from a root to a
   node is a conjunctive rule over the statistics.
3. A lasso-penalised logistic regression weighs the rules; most weights are zero.
4. The rules left are compiled into one Spark column expression, which scores
   all rows in generated code.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import filled, held_out, map_arrow, per_row, steps, text_bytes, words
from tidal.session import materialize

_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _SYMBOL, _WIDE, _REST = range(8)

#: Statistics of a text, in the order of their columns.
STATS = ("words", "word_length", "longest_word", "short_words", "upper", "digits", "marks", "symbols", "non_ascii",
         "capitalised", "ended", "exclaimed", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "lines",
         "distinct_lines", "line_words")


def _kinds() -> np.ndarray:
    kind = np.full(256, _SYMBOL, np.uint8)
    for chars, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER),
                     ("0123456789", _DIGIT), (" \t\n\v\f\r", _SPACE), (".,;:!?'\"-()", _MARK)):
        kind[np.frombuffer(chars.encode(), np.uint8)] = k
    kind[0x80:0xC0] = _REST  # not the first byte of a character
    kind[0xC0:] = _WIDE
    return kind


_KIND = _kinds()


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and how often its most frequent one occurs."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    key, times = np.unique(row * (int(code.max()) + 1) + code, return_counts=True)
    of = key // (int(code.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATS`` for each text; null is an empty text, all of whose statistics are 0."""
    texts = filled(texts)
    n = len(texts)
    buf, off = text_bytes(texts)
    kind = _KIND[buf]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    of = {k: count(kind == k) for k in (_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _WIDE)}
    shown = sum(of.values())  # characters besides white space
    each, row = words(texts)
    total = per_row(np.ones(len(row)), row, n)
    length = pc.utf8_length(each).to_numpy(zero_copy_only=False).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    data, at = text_bytes(each)
    first, last = (_KIND[data[at[:-1]]], _KIND[data[at[1:] - 1]]) if len(each) else (np.zeros(0), np.zeros(0))
    coded = each.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(each) else np.zeros(0, np.int64)
    distinct, top = _distinct(row, code, n)
    same = row[1:] == row[:-1]
    next_row, a, b = row[1:][same], code[:-1][same], code[1:][same]
    _, pair = np.unique(a * (len(coded.dictionary) + 1) + b, return_inverse=True)
    pairs, _ = _distinct(next_row, pair, n)
    split = pc.split_pattern(texts, "\n")
    line, line_row = split.flatten(), np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    line, line_row = line.filter(full), line_row[full.to_numpy(zero_copy_only=False)]
    lines = per_row(np.ones(len(line_row)), line_row, n)
    line_code = line.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(line) else np.zeros(
        0, np.int64)
    return np.column_stack([
        total, _share(per_row(length, row, n), total), longest, _share(per_row(length <= 3, row, n), total),
        _share(of[_UPPER], of[_UPPER] + of[_LOWER]), *(_share(of[k], shown) for k in (_DIGIT, _MARK, _SYMBOL, _WIDE)),
        _share(per_row(first == _UPPER, row, n), total),
        _share(per_row((last == _MARK) | (last == _SYMBOL), row, n), total), _share(count(buf == ord("!")), total),
        _share(distinct, total), _share(top, total), _share(per_row(a == b, next_row, n), total),
        _share(pairs, per_row(np.ones(len(next_row)), next_row, n)), lines,
        _share(_distinct(line_row, line_code, n)[0], lines), _share(total, lines)])


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``STATS``: one row per row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), *((s, pa.float64()) for s in STATS)])

    def run(batches):
        for part in steps(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, statistics(part.column(1)).T)], schema=schema)

    cols = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return map_arrow(cols, run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """A statistic above ``low`` and at most ``high``, for each (name, low, high) of ``terms``."""

    terms: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        met = F.lit(True)
        for name, low, high in self.terms:
            if low > -math.inf:
                met = met & (F.col(name) > low)
            if high < math.inf:
                met = met & (F.col(name) <= high)
        return met

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} < {name} <= {high:.4g}" for name, low, high in self.terms)


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str) -> list[Rule]:
    """The rule of every node below the root, from the text form of a tree."""
    out: list[Rule] = []
    held: list[tuple[int, str, str, float]] = []  # depth, statistic, side, threshold
    for line in tree.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        depth = len(m[1])
        held = [h for h in held if h[0] < depth] + [(depth, STATS[int(m[3])], m[4], float(m[5]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, side, at in held:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
        out.append(Rule(tuple((name, *bounds[name]) for name in sorted(bounds))))
    return out


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; the score is the logistic function of ``base`` and the weights of the rules that hold."""

    base: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, label: str, trees: int = 40, depth: int = 3, penalty: float = 0.001, seed: int = 42) -> Ensemble:
    """The ensemble of all ``rows`` (``STATS`` and ``label``, 0 or 1).

    Without rows the score is 0.5 everywhere, with one class only it leans to
    that class by the number of its rows.
    """
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if not bad or not good:
        return Ensemble(math.log((good + 1) / (bad + 1)))
    data = rows.select(array_to_vector(F.array(*STATS)).alias("features"), F.col(label).cast("double").alias("label"),
                       *STATS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5).fit(data)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in paths(tree.toDebugString)))
    if not rules:
        return Ensemble(math.log(good / bad))
    met = data.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("rules"))
    met = materialize(met, "quality-rules")
    model = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=200, tol=1e-7).fit(met)
    weights = model.coefficients.toArray()
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, trees: int = 40, depth: int = 3,
            penalty: float = 0.001, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Fitted on all rows whose id has a label 0 or 1 and whose crc32(doc_id as
    text) mod 3 is not 1; other labels and null ids teach nothing, an id with
    several labels counts once for each.  Null text is an empty one and has a
    score too; repeated rows are scored each; an empty table gives no rows.
    Only the named columns are read; only statistics of the text reach a score.
    """
    stats = materialize(with_statistics(docs, doc_id, text), "quality-stats")
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label_")).filter(
        "label_ IN (0, 1)")
    rows = (stats.filter(~held_out("doc_id", 3, 1)).join(known, F.col("doc_id") == F.col("id"))
            .select(F.col("label_"), *STATS))
    ensemble = fit(materialize(rows, "quality-train"), "label_", trees, depth, penalty)
    score = ensemble.score()
    return (stats.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
