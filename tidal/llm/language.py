"""Language ID: binary n-gram classifiers for the bits of error-correcting codewords.

Every language has a codeword.  One classifier per bit tells the languages with
a 1 from those with a 0 by byte n-grams (naive Bayes over hashed n-grams, so a
classifier is one weight per n-gram).  The codeword of least loss, weighted by
the bits' margins, names the language; a close second flags ambiguity.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidal.llm.common import WindowHash, batch, held_out, map_arrow, steps, text_bytes

#: Lengths of the n-grams, in bytes, and the hashed table of each.
GRAMS = (2, 3, 4)
TABLE = 1 << 14
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One row of bits per language: all splits for up to five, else the widest of some random codes."""
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 5:
        columns = [c for c in itertools.product((0, 1), repeat=languages) if c[0] and not all(c)]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(10 * np.log2(languages)))
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(40):
        code = rng.permuted(np.tile(np.arange(languages) % 2, (bits, 1)), axis=1).T.astype(np.int8)
        near = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if near > best[0]:
            best = (near, code)
    return best[1]


def _grams(part: pa.RecordBatch, text: int):
    """(table position, row) of every n-gram, for each length, and the texts' sizes."""
    buf, off = text_bytes(part.column(text))
    hashes = WindowHash(_LOWER[buf])
    size = np.diff(off)
    row_of = np.repeat(np.arange(part.num_rows), size)
    for k, n in enumerate(GRAMS):
        at = (hashes.each(n) >> np.uint64(50)).astype(np.int64) + k * TABLE
        row = row_of[:len(at)]
        inside = np.arange(len(at)) + n <= off[row + 1]
        yield at[inside], row[inside]


def _counts(labelled: DataFrame) -> DataFrame:
    """gram, lang (position), n: n-gram counts of all labelled texts."""
    schema = pa.schema([("lang", pa.int32()), ("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for part in steps(batches, 1):
            lang = part.column(0).to_numpy(zero_copy_only=False)
            for at, row in _grams(part, 1):
                of = lang[row]
                for code in np.unique(of):
                    if code not in total:
                        total[code] = np.zeros(len(GRAMS) * TABLE, np.int64)
                    total[code] += np.bincount(at[of == code], minlength=len(GRAMS) * TABLE)
        for code, n in total.items():
            have = np.flatnonzero(n)
            yield batch(schema, np.full(len(have), code, np.int32), have.astype(np.int32), n[have])

    return map_arrow(labelled, run, "lang int, gram int, n long")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             margin: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of ``docs``.

    Learned from all texts with a language whose crc32(doc_id) mod 4 is not 2.
    ``lang_pred`` is a learned value, or ``und`` for a null text or one without
    a letter (score 0), and for all where nothing was learned.  ``score`` is the
    share of the best codeword in the loss-weighted decoding, between 0 and 1;
    ``ambiguous`` says that the second codeword's loss per bit is within
    ``margin``.  Ties go to the first language in order.  Repeated rows are
    predicted each; an empty table gives no rows; clashing extra columns are not
    read.  Counting and predicting take one narrow pass each; only table-sized
    counts are shuffled.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    teach = cols.filter(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names = sorted(r["lang"] for r in teach.select("lang").distinct().collect())  # the list of languages
    code = codewords(len(names))
    bits = code.shape[1]
    weights = np.zeros((len(GRAMS) * TABLE, max(bits, 1)), np.float32)
    if bits:
        place = F.create_map(*[x for i, v in enumerate(names) for x in (F.lit(v), F.lit(i))])
        counts = _counts(teach.select(place[F.col("lang")].cast("int").alias("lang"), "text"))
        word = F.array(*[F.array(*[F.lit(int(b)) for b in row]) for row in code])
        per_bit = counts.withColumn("word", F.element_at(word, F.col("lang") + 1)).groupBy("gram").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("n") * F.element_at("word", b + 1)).alias(f"b{b}") for b in range(bits)])
        one = np.zeros((len(weights), bits))
        every = np.zeros(len(weights))
        for r in per_bit.toLocalIterator():  # as many rows as the hashed tables have places
            every[r["gram"]] = r["n"]
            one[r["gram"]] = r[2:]
        for k in range(len(GRAMS)):
            s = slice(k * TABLE, (k + 1) * TABLE)
            yes, no = one[s] + 0.5, every[s, None] - one[s] + 0.5
            weights[s] = np.log(yes / yes.sum(0)) - np.log(no / no.sum(0))
    shared = spark.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("ambiguous", pa.bool_())])
    sign = 2.0 * code - 1
    listed = np.array([*names, "und"], dtype=object)

    def run(batches):
        table = shared.value
        for part in steps(batches, 1, 1 << 19):
            n = part.num_rows
            letter = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if not names:
                best, score, close = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
                letter = np.zeros(n, bool)
            elif not bits:
                best, score, close = np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
            else:
                total, count = np.zeros((n, bits)), np.zeros(n)
                for at, row in _grams(part, 1):
                    if len(at):
                        have, first = np.unique(row, return_index=True)
                        total[have] += np.add.reduceat(table[at], first, axis=0, dtype=np.float64)
                        count += np.bincount(row, minlength=n)
                # evidence grows as the root of the length: neighbouring n-grams depend on each other
                m = total / np.sqrt(np.maximum(count, 1))[:, None]
                loss = np.logaddexp(0, -m[:, None, :] * sign[None, :, :]).sum(2)
                best = loss.argmin(1)
                low = loss - loss.min(1, keepdims=True)
                score = 1 / np.exp(-low).sum(1)
                close = np.sort(low, axis=1)[:, 1] < margin * bits
            pred = listed[np.where(letter, best, len(names))]
            yield batch(schema, part.column(0), pred.tolist(), np.where(letter, score, 0.0), close | ~letter)

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = map_arrow(cols.select("doc_id", "text", letter.alias("letter")), run,
                    "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
