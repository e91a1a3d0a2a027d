"""Language detection by character n-grams: profiles fitted on labelled rows, texts scored against them where they
are read, in arrays.

A text's first ``SAMPLE`` characters are taken; texts of fewer than ``LEAST`` have no language. A profile holds the most
frequent trigrams of a language's texts (words in lower case, with blanks around them) with their smoothed log frequency.
A text's language is that whose profile gives its trigrams the highest mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Characters of a document that are looked at, and the least that a text needs.
SAMPLE, LEAST = 2000, 20
#: Trigrams of a profile.
PROFILE = 2000
#: Texts whose trigrams are held at once.
SLICE = 512


def letters(text: Column) -> Column:
    """The letters' words, a blank before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _codes(joined: str) -> np.ndarray:
    """Trigrams as numbers, 21 bits a character."""
    chars = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    return chars[:-2] | chars[1:-1] << np.uint64(21) | chars[2:] << np.uint64(42)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of a batch, trigrams in order, the row of each) of the letters in the last column; nulls have none."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            texts = ["" if t is None else t for t in part.column(part.num_columns - 1).to_pylist()]
            joined = "".join(texts)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            inside = row[:-2] == row[2:]
            codes = _codes(joined)
            inside &= codes >> np.uint64(21) & np.uint64((1 << 21) - 1) != ord(" ")
            yield part, codes[inside], row[:-2][inside]


def _sampled(text: Column) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)
    return F.when(F.length(strip(head)) >= LEAST, head)


def fit_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, weight) of labelled rows: the ``size`` most frequent trigrams of each language, all rows counted; the
    gram "" has the weight of any other. Counts are summed before they are shuffled."""
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), letters(_sampled(F.col(text_col))).alias("letters"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes, row in _trigrams(batches):
            langs = part.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()[row]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                found, n = np.unique(codes[lang == k], return_counts=True)
                chars = np.stack([found >> np.uint64(s) & np.uint64((1 << 21) - 1) for s in (0, 21, 42)], axis=1).astype("<u4")
                grams = pa.array(chars.reshape(-1).view("<U3").tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), grams, pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    most = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).join(F.broadcast(total), "lang")
    weight = lambda n: F.log(n / (F.col("total") + F.col("kinds"))).alias("weight")
    return most.select("lang", "gram", weight(F.col("n") + 1)).unionByName(total.select("lang", F.lit("").alias("gram"), weight(F.lit(0.5))))


def detect_languages(df: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language): null for a text that is null or too short, and for one without letters. Ids come once. Profiles (a
    bounded number of rows a language) reach the driver and every worker; a text is scored where it is read."""
    found = profiles.select("lang", "gram", "weight").collect()
    langs = sorted({r["lang"] for r in found})
    at = {lang: k for k, lang in enumerate(langs)}
    rest, known = np.zeros(len(langs)), sorted({r["gram"] for r in found if r["gram"]})
    for r in found:
        if not r["gram"]:
            rest[at[r["lang"]]] = r["weight"]
    codes = np.array([_codes(g)[0] for g in known], np.uint64)
    order = np.argsort(codes)
    place = {known[i]: k for k, i in enumerate(order)}
    # Grams outside a profile have its rest weight, so a language's mean is the rest weight and the mean gain.
    gain, held = np.zeros((len(langs), len(known))), np.zeros((len(langs), len(known)), bool)
    for r in found:
        if r["gram"]:
            k, g = at[r["lang"]], place[r["gram"]]
            gain[k, g], held[k, g] = r["weight"] - rest[k], True
    shared = df.sparkSession.sparkContext.broadcast((langs, rest, codes[order], gain, held))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, rest, known, gain, held = shared.value
        for part, codes, row in _trigrams(batches):
            n = np.bincount(row, minlength=part.num_rows)
            best, language = np.full(part.num_rows, -np.inf), np.full(part.num_rows, -1)
            at = np.searchsorted(known, codes)
            there = at < len(known)
            there[there] = known[at[there]] == codes[there]
            at, row = at[there], row[there]
            for k in range(len(langs)):  # of equal means the later name's
                score = np.round(rest[k] + np.bincount(row, gain[k, at], part.num_rows) / np.maximum(n, 1), 9)
                better = (np.bincount(row, held[k, at], part.num_rows) > 0) & (score >= best)
                best[better], language[better] = score[better], k
            told = pa.array([langs[k] if k >= 0 else None for k in language.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), told], [id_col, "language"])

    rows = df.select(F.col(id_col), letters(_sampled(F.col(text_col))).alias("letters"))
    return rows.mapInArrow(tell, f"`{id_col}` {dict(df.dtypes)[id_col]}, language string")
