"""Text quality by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad.
A text that resembles good text is smaller with the good dictionary; the difference of the
two compressed sizes, divided by the text's size, becomes a probability by a
rising calibration curve from labelled rows that built no dictionary.

Dictionaries and calibration are fitted on at most ``FIT_ROWS`` labelled rows, a documented
bound, chosen by hash; every text is then compressed whole.  Two dictionaries of
``DICTIONARY`` bytes and two numbers are all that goes to the tasks.

Defined results: null and empty texts have difference 0 and get the calibration's score
for that.  Rows without ``doc_id`` are scored and are not held out.  Repeated rows get
equal scores.  Without labelled rows of both kinds every score is 1, so that nothing is
rejected unlearned.  A label is the larger of the labels given to an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.deobfuscate import held_out, isotonic, training

FIT_ROWS = 24_000
DICTIONARY = 112 * 1024
LEVEL = 3
#: A text gives one sample of this many bytes; so many texts build a dictionary.
SAMPLE, SAMPLES = 2000, 8000
THRESHOLD = 0.3


#: Nothing learned: every score is 1.
ALWAYS = (np.zeros(1), np.ones(1))


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: tuple[np.ndarray, np.ndarray] = ALWAYS  # difference and its probability, rising


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the text itself where there is too little to train on."""
    if sum(map(len, samples)) > 8 * DICTIONARY:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    return b"\n".join(samples)[-DICTIONARY:]


def differences(texts, model: Model) -> Iterator[float]:
    """(bad size - good size) / text size, of each text."""
    def compressor(d: bytes):
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=False, write_content_size=False
        )

    good, bad = compressor(model.good), compressor(model.bad)
    for t in texts:
        body = (t or "").encode()
        yield (len(bad.compress(body)) - len(good.compress(body))) / len(body) if body else 0.0


def _scored(model: Model):
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.fromiter(differences((t.as_py() for t in batch.column(1)), model), float, batch.num_rows)
            score = np.interp(x, *model.curve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(score)], ["key", "difference", "score"])

    return work


def fit(train: DataFrame, samples: int = SAMPLES) -> Model:
    """``train``: key, label, text of a bounded number of rows.

    Half of the rows, by hash, build the dictionaries, the other half calibrates.
    """
    builds = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(2)) == 0
    pieces = F.ceil(F.length("text") / SAMPLE)
    piece = F.substring("text", F.pmod(F.xxhash64(F.lit(9), "text"), pieces).cast("int") * SAMPLE + 1, F.lit(SAMPLE)).alias("piece")
    sides = {}
    for label in (1, 0):
        rows = train.where(builds & (F.col("label") == label) & (F.length("text") > 0))
        rows = rows.select("key", piece).orderBy(F.xxhash64(F.lit(7), "key"), "key", "piece").limit(samples)
        sides[label] = [r["piece"].encode() for r in rows.collect()]
    if not sides[1] or not sides[0]:
        return Model(b"", b"")
    model = Model(dictionary(sides[1]), dictionary(sides[0]))
    scored = train.where(~builds).select("key", "text").mapInArrow(_scored(model), "key long, difference double, score double")
    binned = (
        scored.join(train.select("key", "label"), "key")
        .groupBy(F.round(F.col("difference"), 5).alias("x"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("x", "label")
        .limit(100_000)
        .collect()
    )
    model.curve = isotonic(*(np.array([r[c] for r in binned], float) for c in ("x", "label", "n")))
    return model


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, difference of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("key"), "text")
    out = rows.mapInArrow(_scored(model), "key long, difference double, score double")
    out = out.select(F.col("key").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
    return out.select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted", "difference")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(training(documents, labels, "quality", 0, 5, FIT_ROWS)))
