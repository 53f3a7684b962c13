"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all learning rows are taken in the tasks (one row of counts per task and
language leaves a task) and summed by Spark.  The matrix of log probabilities has
``languages x BUCKETS`` cells, whatever the corpus; its size is checked before it
is shipped.  Scoring counts the n-grams of a run of texts sparsely, as bucket
numbers, and multiplies their count rows with the matrix.

Defined results
  NULL text, or one without a letter   ``und``, score 0; never learned from
  NULL ``lang``                        not learned from
  NULL id                              neither held out nor learned from
  nothing to learn from                ``und``, score 0 for every row
  equal scores                         the language that sorts first
  repeated rows, empty texts, empty table   each row by itself; no rows for no rows
Texts are used whole, lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bpe import slices
from assayer.llm.shared import by_value, fold, stored

BUCKETS, ORDERS, SMOOTHING = 1 << 13, (1, 2, 3), 0.5
#: Largest model to ship, in bytes.  With more languages than fit the buckets are halved until they do.
MAX_MODEL = 64 << 20
#: Cells of the count rows that are held at a time.
CELLS = 1 << 21
UNKNOWN = "und"


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of all n-grams of the lower-cased text, blank at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        parts.append(h % np.uint32(buckets))
    return np.concatenate(parts)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _count(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if has_letter(text):
                        if lang not in totals:
                            totals[lang] = np.zeros(buckets, np.int64)
                        totals[lang] += np.bincount(grams(text, buckets), minlength=buckets)
        for lang, counts in sorted(totals.items()):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])],
                ["lang", "bucket", "n"])
    return work


def fit(rows: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by bucket, from all rows ``lang, text``."""
    learn = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    many = learn.select("lang").distinct().count()
    while buckets > 1 and many * buckets * 8 > MAX_MODEL:
        buckets //= 2
    counts = stored(learn.mapInArrow(_count(buckets), "lang string, bucket int, n long")
                    .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")
    packed = counts.toPandas()
    names = sorted(packed["lang"].unique())
    table = np.full((len(names), buckets), SMOOTHING)
    if names:
        table[packed["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), packed["bucket"].to_numpy(int)] += (
            packed["n"].to_numpy(float))
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def _score(names: list[str], log_p: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = log_p.shape[1]
        together = max(1, CELLS // buckets)
        weights = np.ascontiguousarray(log_p.T)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                usable = [i for i, t in enumerate(texts) if has_letter(t)] if names else []
                for start in range(0, len(usable), together):
                    run = usable[start:start + together]
                    cells = [grams(texts[i], buckets).astype(np.int64) + k * buckets for k, i in enumerate(run)]
                    counts = np.bincount(np.concatenate(cells), minlength=len(run) * buckets)
                    used = np.flatnonzero(counts)  # every text has some
                    first = np.searchsorted(used, np.arange(len(run)) * buckets)
                    logs = np.add.reduceat(weights[used % buckets] * counts[used, None], first)
                    shares = np.exp(logs - logs.max(axis=1, keepdims=True))
                    shares /= shares.sum(axis=1, keepdims=True)
                    best = logs.argmax(axis=1)
                    for k, i in enumerate(run):
                        pred[i], score[i] = names[best[k]], float(shares[k, best[k]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()),
                     pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return work


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; only the text decides."""
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(_score(*model), "doc_id long, held_out boolean, lang_pred string, score double")


def _accepted(names: list[str], log_p: np.ndarray):
    score = _score(names, log_p)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                judged = pa.RecordBatch.from_arrays(
                    [pa.nulls(part.num_rows), pa.nulls(part.num_rows), part.column("text")], ["doc_id", "held_out", "text"])
                known = [p != UNKNOWN for out in score(iter([judged])) for p in out.column("lang_pred").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(known, pa.bool_())], ["row", "known"])
    return work


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``row, known`` of every row of ``row, text``: whether its language can be told."""
    return docs.select("row", "text").mapInArrow(_accepted(*model), "row long, known boolean")


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that are not held out and say their language."""
    return docs.where(fold(F.col("doc_id")) != 0).select("lang", "text")


by_value(__name__)
