"""Language identification by bit-sliced Bloom filters of character trigrams.

Every language's filter has the same number of rows and the same hashes. The filters are stored across: row i has one
bit for each language, so the AND of a trigram's rows is the bitmask of all languages that (may) contain it. A
document's bits are counted for each language, the share that false positives add is taken off again, and the
language with the largest share is the answer; its part of all languages' shares is the score.

A language contains a trigram if the trigram makes up at least `MIN_RATE` of the language's trigrams, and at least
`SHARE` of its rate in the language where it is most common (so a quotation in another language adds nothing). That
bounds each filter to 1 / MIN_RATE trigrams, whatever the size of the training text. Counts cover all training text.

Trigrams are of lower-cased letters, with one space for each run of other characters, and a letter in the middle.
A null text, or one without a letter, is `und` with score 0, and so is every text if nothing was learned. A text with
letters of which no trigram is known has score 0 too, and the language that comes first in the alphabet.
Ties go to the language that comes first in the alphabet. Rows are judged one by one, repeated ids included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, mix, schema_text, text_chunks, written

MIN_RATE = 1e-5
SHARE = 0.1
HASHES = 3
BITS_PER_GRAM = 16
SPACE = 32


def letter_table() -> np.ndarray:
    """The lower-case letter for each code point below 0x30000, a space for what is no letter."""
    out = np.full(0x30000, SPACE, np.uint32)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def trigrams(data: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of texts that lie one after another, the texts' bounds among them, and whether each has a letter."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[starts]
    far = points >= len(letters)
    text = letters[np.where(far, 0, points)] if far.any() else letters[points]
    for c in np.unique(points[far]):
        if chr(c).isalpha():
            text[points == c] = c
    blank = text == SPACE
    opens = np.zeros(len(text) + 1, bool)
    opens[first] = True
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep |= opens[:-1]
    bounds = np.append(0, np.cumsum(keep))[first]
    has_letter = np.diff(np.append(0, np.cumsum(~blank))[first]) > 0
    # each text is framed by spaces, which also part it from its neighbours
    text = np.insert(text[keep], bounds, SPACE).astype(np.uint64)
    bounds = bounds + np.arange(len(bounds))
    grams = (text[:-2] << np.uint64(42)) | (text[1:-1] << np.uint64(21)) | text[2:]
    centre = text[1:-1] != SPACE
    return grams[centre], np.append(0, np.cumsum(centre))[np.clip(bounds, 0, len(centre))], has_letter


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all texts whose lang is known."""

    def run(batches):
        letters, held = letter_table(), {}

        def add(lang, grams, n):
            keys, counts = held.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            keys, at = np.unique(np.append(keys, grams), return_inverse=True)
            held[lang] = keys, np.bincount(at, np.append(counts, n)).astype(np.int64)

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, data, starts in text_chunks(batch.column("text")):
                grams, bounds, _ = trigrams(data, starts, letters)
                owner = np.repeat(np.arange(b - a), np.diff(bounds))
                for lang in set(langs[a:b]):
                    add(lang, *np.unique(grams[(langs[a:b] == lang)[owner]], return_counts=True))
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    known = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return known.mapInArrow(giving_back(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilters:
    languages: list[str]
    rows: np.ndarray  # (rows, words of 64 languages)
    false_positives: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each trigram one bit for each language that may contain it."""
        out = None
        for row in hash_rows(len(self.rows), grams):
            out = self.rows[row] if out is None else out & self.rows[row]
        return out


def hash_rows(n_rows: int, grams: np.ndarray):
    """The rows of each trigram, from separate bits of one hash while it has enough of them."""
    h, width, shift = mix(grams), int(np.log2(n_rows)), 0
    for _ in range(HASHES):
        if shift + width > 64:
            h, shift = mix(h + np.uint64(1)), 0
        yield ((h >> np.uint64(shift)) & np.uint64(n_rows - 1)).astype(np.int64)
        shift += width


def learn(docs: DataFrame) -> LanguageFilters:
    """Filters from all rows with a text and a lang; the driver sees at most 1 / MIN_RATE trigrams a language."""
    counts = written(trigram_counts(docs), "trigrams")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("size"))
    rated = counts.join(sizes, "lang").withColumn("rate", F.col("n") / F.col("size")).where(F.col("rate") >= MIN_RATE)
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    chosen = rated.join(most, "gram").where(F.col("rate") >= SHARE * F.col("most"))
    found = chosen.select("lang", "gram").toPandas()
    languages = sorted(found["lang"].unique())
    largest = int(found.groupby("lang").size().max()) if languages else 1
    n_rows = 1 << int(np.ceil(np.log2(largest * BITS_PER_GRAM)))
    model = LanguageFilters(languages, np.zeros((n_rows, -(-len(languages) // 64) or 1), np.uint64), np.zeros(len(languages)))
    for k, lang in enumerate(languages):
        grams = found.loc[found["lang"] == lang, "gram"].to_numpy().astype(np.uint64)
        for row in hash_rows(n_rows, grams):
            model.rows[row, k // 64] |= np.uint64(1 << (k % 64))
        fill = ((model.rows[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
        model.false_positives[k] = fill**HASHES
    return model


def identify(docs: DataFrame, model: LanguageFilters, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of each row, and the columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.rows, model.false_positives))

    def run(batches):
        model, letters = LanguageFilters(*shared.value), letter_table()
        names = np.array([*model.languages, "und"], object)
        fp = model.false_positives
        for batch in batches:
            preds, scores = [np.empty(0, object)], [np.empty(0)]
            for _, _, data, starts in text_chunks(batch.column("text")):
                grams, bounds, has_letter = trigrams(data, starts, letters)
                masks, n = model.masks(grams), np.diff(bounds)
                shares = np.zeros((len(n), len(fp)))
                for k in range(len(fp)):
                    bits = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                    hits = np.diff(np.append(0, np.cumsum(bits.astype(np.int64)))[bounds])
                    shares[:, k] = np.maximum(0, (hits / np.maximum(n, 1) - fp[k]) / (1 - fp[k]))
                known = has_letter & (len(fp) > 0)
                best = shares.argmax(axis=1) if len(fp) else np.zeros(len(n), int)
                top = shares.max(axis=1) if len(fp) else np.zeros(len(n))
                preds.append(names[np.where(known, best, len(fp))])
                scores.append(np.where(known & (top > 0), top / np.maximum(shares.sum(axis=1), 1e-300), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(preds), pa.string()), pa.array(np.concatenate(scores)), *map(batch.column, carry)], names=["doc_id", "lang_pred", "score", *carry])

    rest = [c for c in carry if c != "text"]
    schema = f"doc_id long, lang_pred string, score double{schema_text(docs, carry)}"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *rest).mapInArrow(giving_back(run), schema)
