"""License scan: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their document frequency in the corpus, rarest first. A template of n tokens that a block must
contain to a share t has to meet the block in one of its first n - ceil(t n) + 1 tokens of that order (prefix filter);
the block needs at least ceil(t n) template tokens (length filter), as many of them from the shared one on, in both
orders (positional filter). What passes is counted exactly.

Blocks are sentences, however they are wrapped: texts are cut at blank lines and after ``.``, ``!`` or ``?`` before
white space (but not after a single letter or digit, as in "v. 2"), license texts as well. License sentences of fewer than
``LEAST_WORDS`` different words are one template with the sentence next to them; one that stands alone counts only where its
words stand in their order. Only blocks with a prefix token are ever compared. Every template block that a text
block contains to the threshold is found; its label counts unless a template of nearly the same words fits the block
better (the notices of the General and the Lesser license differ in three words). Only DataFrame functions are used;
what reaches the driver is one row per template token.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import text_or_empty
from .license_texts import LICENSE_TEXTS
from .scratch import materialize

#: Fixed phrases of the base scan and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
SHARE = 0.9
#: Different words below which a license sentence says too little by itself.
LEAST_WORDS = 5
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ENDS = r"(?<=[.!?])(?<![^A-Za-z0-9][A-Za-z0-9]\.)[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """Words (ASCII letters and digits, anything beyond ASCII; A-Z in lower case) with one space between them."""
    spaced = F.trim(F.regexp_replace(text, _GAPS, " "))
    # Two letters beyond ASCII have ASCII letters as their lower case; they must not.
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(spaced, _UPPER, _LOWER)).otherwise(F.lower(spaced))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(norm: Column, phrases: dict[str, str]) -> list[Column]:
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    n_words = F.when(norm == "", F.lit(0)).otherwise(_spaces(norm) + 1).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        cut = F.split(padded, f" {phrase}(?= )", -1)
        there = norm.contains(phrase)
        n = F.when(there, F.size(cut) - 1).otherwise(F.lit(0))
        hit = there & (F.size(cut) > 1)
        counts.append(n)
        firsts.append(F.when(hit, _spaces(cut[0])))
        lasts.append(F.when(hit, n_words - (_spaces(F.element_at(cut, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(hit, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    some = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    return [
        n_words.alias("n_words"),
        total.cast("long").alias("n_base"),
        some(F.least, firsts).cast("long").alias("first_word"),
        some(F.greatest, lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"),
    ]


def template_blocks(texts: tuple[tuple[str, str], ...]) -> list[tuple[str, frozenset[str], str]]:
    """(label, distinct words, the words in order) of every block of the license texts, each set of words once a label."""
    fold, found = str.maketrans(_UPPER, _LOWER), {}
    for label, text in texts:
        blocks: list[list[str]] = []
        for sentence in re.split(_ENDS, text):
            words = re.sub(_GAPS, " ", sentence).translate(fold).split()
            if blocks and words and min(len(set(words)), len(set(blocks[-1]))) < LEAST_WORDS:
                blocks[-1] += words
            elif words:
                blocks.append(words)
        for words in blocks:
            found.setdefault((label, frozenset(words)), " ".join(words))
    return [(label, words, phrase) for (label, words), phrase in found.items()]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, texts: tuple[tuple[str, str], ...] = LICENSE_TEXTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Base: places where a phrase's words stand consecutively. Labels: the base ones and those of every template block of
    which a block of the text holds at least ``share`` of the distinct words; blocks lists all of these with label, share
    and the block's template words. Where two templates hold one another's words to that share, only the label of the one
    that fits a block better counts (by share, then by length). score is the highest share found, 1 if a phrase stands in
    the text, else 0. Null and empty texts have no words. Every row is scanned by itself, so repeated rows repeat their
    result; null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = template_blocks(texts)
    vocabulary = sorted({w for _, own, _ in templates for w in own})
    short = {k: phrase for k, (_, own, phrase) in enumerate(templates) if len(own) < LEAST_WORDS}
    words = F.array(*map(F.lit, vocabulary))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__text")).withColumn("__norm", normalized(F.col("__text")))

    found = rows.select(F.explode(F.array_intersect(F.split("__norm", " "), words)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    frequency = {r["w"]: r["n"] for r in found.toLocalIterator()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index = []
    for k, (label, own, _) in enumerate(templates):
        ordered_own = sorted(own, key=rank.__getitem__)
        need = math.ceil(share * len(own) - 1e-9)
        rivals = [n for n, (_, other, _) in enumerate(templates) if n != k and len(own & other) >= need]
        index += [(w, k, label, ordered_own, at, need, rivals) for at, w in enumerate(ordered_own[: len(own) - need + 1])]
    prefix_words = sorted({w for w, *_ in index}, key=rank.__getitem__)
    prefix = F.array(*map(F.lit, prefix_words))
    ordered = F.array(*map(F.lit, sorted(vocabulary, key=rank.__getitem__)))

    # One pass over the texts: base scan; where any prefix word stands, the blocks with one (cut before normalising),
    # and of these the template words in the global order.
    block_words = F.transform(F.split("__text", _ENDS), lambda b: F.split(normalized(b), " "))
    near = F.filter(block_words, lambda b: F.arrays_overlap(b, prefix))
    held = F.when(F.arrays_overlap(F.split("__norm", " "), prefix), F.transform(near, lambda b: F.array_intersect(ordered, b)))
    padded = F.concat(F.lit(" "), "__norm", F.lit(" "))
    said = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(padded.contains(f" {phrase} "), F.lit(k)) for k, phrase in short.items()]))
    scanned = rows.select("doc_id", *_base(F.col("__norm"), phrases), held.alias("held"), said.alias("said"))
    scanned = materialize(scanned.withColumn("__row", F.monotonically_increasing_id()), "scanned")

    templates_df = spark.createDataFrame(index, "word string, template int, label string, tokens array<string>, at_t int, need int, rivals array<int>")
    block = scanned.where("size(held) > 0").select("__row", "said", F.explode(F.array_distinct("held")).alias("block"))
    exploded = block.select("__row", "said", "block", F.posexplode("block").alias("at_b", "word")).where(F.array_contains(prefix, F.col("word")))
    met = exploded.join(F.broadcast(templates_df), "word")  # at most one row per template token
    left = F.least(F.size("tokens") - F.col("at_t"), F.size("block") - F.col("at_b"))
    met = met.where((F.size("block") >= F.col("need")) & (left >= F.col("need")))
    counted = met.withColumn("n", F.size(F.array_intersect("block", "tokens"))).where("n >= need")
    if short:
        counted = counted.where(~F.col("template").isin(*short) | F.array_contains("said", F.col("template")))
    hit = F.struct("label", (F.col("n") / F.size("tokens")).alias("share"), F.array_join("block", " ").alias("words"), "template", F.size("tokens").alias("size"), "rivals")
    matched = counted.groupBy("__row").agg(F.collect_set(hit).alias("hits"))  # of one document
    fits = lambda x: F.struct(x["share"], x["size"])
    outdone = lambda x, y: (x["words"] == y["words"]) & F.array_contains(x["rivals"], y["template"]) & (fits(y) > fits(x))
    best = F.filter("hits", lambda x: ~F.exists("hits", lambda y: outdone(x, y)))
    shown = F.transform("hits", lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share"), x["words"].alias("words")))
    matched = matched.select("__row", F.array_sort(F.array_distinct(shown)).alias("blocks"), F.transform(best, lambda x: x["label"]).alias("best"))

    out = scanned.join(matched, "__row", "left")
    own = F.coalesce(F.col("best"), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union("base_labels", own))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("blocks.share")), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), "blocks")
