"""Language identification with a bit-sliced Bloom filter of character n-grams.

One lookup of an n-gram returns the mask of all languages that contain it; a
text's n-grams are counted per language, corrected for the filter's false positives."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import process_cache, stored, text_batches

#: Odd multipliers of the filter's hash functions.
_HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
NGRAM = 3


def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """The text's character trigrams as exact 63-bit numbers: letters in lower case, any run of other
    characters as one space, no trigram across words.  Empty if there is no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(a):
        return a
    letter = process_cache("letters", _letters)[a]
    if not letter.any():
        return a[:0]
    a = np.where(letter, a, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a, letter = a[keep], letter[keep]
    a, letter = np.concatenate([[32], a, [32]]), np.concatenate([[False], letter, [False]])
    grams = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    return grams[letter[1:-1]]


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    g = grams.astype(np.uint64)
    out = []
    for m in _HASHES:
        h = g * np.uint64(m)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(24)).astype(np.int64) & (size - 1))
    return out


@dataclass
class LanguageFilter:
    """``table[slot]`` holds one bit per language (64 per word); ``rates`` are the false-positive rates."""

    names: list[str]
    table: np.ndarray
    rates: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per n-gram the words of the mask of languages that contain it (never one too few)."""
        out = None
        for s in _slots(grams, len(self.table)):
            out = self.table[s] if out is None else out & self.table[s]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text) if text is not None else np.empty(0, np.int64)
        if not len(grams) or not self.names:
            return "und", 0.0
        masks, n = self.masks(grams), len(grams)
        hits = np.array([int(((masks[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).sum()) for i in range(len(self.names))])
        # A gram outside a language's set still hits it with that language's rate.
        true = np.maximum(0.0, (hits - n * self.rates) / np.maximum(1e-9, 1 - self.rates))
        best = int(true.argmax())
        rest = np.delete(true, best).max() if len(true) > 1 else 0.0
        return self.names[best], float(true[best] / (true[best] + rest)) if true[best] else 0.0


def learn_filter(docs: DataFrame, min_share: float = 0.01, lang_col: str = "lang", text_col: str = "text", max_slots: int = 1 << 22) -> LanguageFilter:
    """Fit to all rows with a language and a text; rows with a NULL there teach nothing, empty texts count as documents
    without trigrams, repeated rows count each time, and from an empty table no language is learned.

    A trigram belongs to a language if at least ``min_share`` of the language's documents
    hold it.  Documents are counted by language and trigram with one row per batch,
    language and trigram before the shuffle; the sets that come to the driver are bounded by
    mean distinct trigrams per document / min_share, whatever the number of documents."""
    def run(batches):
        for b in batches:
            for lang, part in b.groupby("lang"):
                grams = [np.unique(ngrams(t)) for t in part["text"]]
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                # Trigram 0 (three NULs, never made by ngrams) carries the number of documents.
                yield pd.DataFrame({"lang": lang, "gram": np.append(g, 0), "n": np.append(n, len(part))})

    text_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = stored(rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.where("gram = 0").select("lang", F.col("n").alias("docs"))
    sets = counts.where("gram <> 0").join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("docs") * min_share)
    pdf = sets.select("lang", "gram").toPandas()
    names = sorted(r["lang"] for r in totals.collect())
    largest = int(pdf.groupby("lang").size().max()) if len(pdf) else 1
    size = min(max_slots, 1 << max(10, (8 * largest - 1).bit_length()))
    table = np.zeros((size, -(-max(1, len(names)) // 64)), np.uint64)
    for i, name in enumerate(names):
        bit = np.uint64(1) << np.uint64(i & 63)
        for s in _slots(pdf.loc[pdf["lang"] == name, "gram"].to_numpy(np.int64), size):
            table[s, i >> 6] |= bit
    fill = np.array([((table[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(names))])
    return LanguageFilter(names, table, fill ** len(_HASHES))


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred, score.

    Reads whole texts.  NULL text or one without a letter (and any text if nothing was
    learned): ``und`` with score 0.  A text none of whose trigrams is known: the first language, score 0; of equal
    counts the first name wins.  score: the best corrected count over the sum of the best two.
    Repeated rows and NULL ids are predicted like others; an empty table gives no rows; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_slots words per 64 languages

    def run(batches):
        for b in batches:
            found = [sent.value.predict(t) for t in b["text"]]
            yield pd.DataFrame({id_col: b["id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double")
