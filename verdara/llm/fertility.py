"""Quality rules from tokeniser fertility.

Public vocabularies measure how a text falls apart into tokens: characters per token and token
entropy under a byte-level vocabulary, and the share of byte-fallback pieces under a piece
vocabulary.  Words are tokenised one by one, each with one leading blank, so white space does not
count and every word is encoded once per worker.  Texts outside the band of their language are
rejected.

Bands reach ``spread`` (3.5 by default) interquartile ranges beyond the quartiles of the texts
that pass the base rules, per language with at least 1/1000 of them (so at most 1000
languages); all other languages share the band of the whole corpus.  For texts with fewer tokens
than the median the reach grows as sqrt(median / tokens), the scatter of a mean.  Quartiles are
exact, from rounded values, so they do not depend on the layout of the data.

Defined results: NULL or empty text: no words, zero tokens, fails the base rules.  NULL language:
a language of its own.  Equal texts of one language get equal verdicts; repeated rows stay
repeated.  Empty table: no rows.  Input columns named like an added column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.common import ship, with_fields
from verdara.llm.vocab import BYTE_RANKS, PIECES, WordTokens, file_bytes, once

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens",
            "chars_per_token", "byte_share", "entropy"]
_SCHEMA = ", ".join(f"{m} {'long' if m.startswith(('n_', 'word')) else 'double'}" for m in MEASURES)
_GROUPS = 1000
#: A share of byte-fallback pieces up to this never rejects a text.
MIN_BYTE_SHARE = 0.05
#: A band is at least as wide as one whose quartiles lie so far apart.
LEAST_RANGE = {"f": 0.1, "b": 0.002, "e": 0.1}


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    marked = bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marked[i:i + 3] = b"\1\1\1"
    return sum(marked)


def text_measures(text: str | None, tokens: WordTokens) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at exactly the six ASCII blanks
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_tokens, entropy, n_pieces, n_bytes = tokens.stats(words)
    chars = len(text) - blanks
    return (len(words), chars, len(raw) - len(raw.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), repeat_words(words), n_tokens,
            chars / n_tokens if n_tokens else 0.0, n_bytes / n_pieces if n_pieces else 0.0, entropy)


def measure(docs: DataFrame, text: str = "text", ranks_path: str | None = None,
            pieces_path: str | None = None) -> DataFrame:
    """Add the MEASURES of every whole text."""
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    files = sc.broadcast((file_bytes(ranks_path, BYTE_RANKS), file_bytes(pieces_path, PIECES)))

    @pandas_udf(_SCHEMA)
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = once(WordTokens, files)
        for texts in batches:
            yield pd.DataFrame([text_measures(t, tokens) for t in texts], columns=MEASURES)

    return with_fields(docs, fn(F.col(text)), MEASURES)


def base_failed() -> Column:
    return ((F.col("n_words") < 50)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _judged() -> dict[str, Column]:
    """The values that bands are fitted on and texts are judged by, rounded alike."""
    return {"f": F.round("chars_per_token", 2), "b": F.round("byte_share", 3),
            "e": F.round("entropy", 2)}


def fit_bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """Quartiles per language: (_lang, tokens, f1, f3, b1, b3, e1, e3); _lang NULL: all others.

    f: characters per token, b: byte share, e: entropy; tokens: their median number.
    """
    key = F.coalesce(F.col(f"`{lang}`"), F.lit("")) if lang in measured.columns else F.lit("")
    rows = measured.where(~base_failed()).select(
        key.alias("_lang"), "n_tokens", *[v.alias(c) for c, v in _judged().items()])
    quarters = F.array(F.lit(0.25), F.lit(0.75))
    found = rows.cube("_lang").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("_lang").alias("pooled"),
        F.percentile_approx("n_tokens", 0.5, 1000).cast("double").alias("tokens"),
        *[F.percentile(c, quarters).alias(c) for c in "fbe"])
    # languages are kept by their share of rows, so there are at most 1000
    total = F.max(F.when(F.col("pooled") == 1, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return (found.withColumn("_total", total)
            .where((F.col("pooled") == 1) | (F.col("n") * _GROUPS >= F.col("_total")))
            .select("_lang", "tokens", *[F.col(c)[i].alias(f"{c}{1 + 2 * i}")
                                         for c in "fbe" for i in (0, 1)]))


def judge(measured: DataFrame, bands: DataFrame, lang: str = "lang",
          spread: float = 3.5) -> DataFrame:
    """Add base_failed and kept."""
    rows = bands.collect()  # at most 1001 by construction
    names = bands.columns[1:]
    pooled = next((r for r in rows if r["_lang"] is None), None)
    if pooled is None or pooled["tokens"] is None:  # no text passes the base rules
        return with_fields(measured, F.struct(base_failed().alias("base_failed"),
                                              F.lit(False).alias("kept")), ["base_failed", "kept"])
    own = measured.sparkSession.createDataFrame(
        [tuple(r) for r in rows if r["_lang"] is not None],
        "_lang string, " + ", ".join(f"_{c} double" for c in names))
    key = F.coalesce(F.col(f"`{lang}`"), F.lit("")) if lang in measured.columns else F.lit("")
    at = {c: F.coalesce(F.col(f"_{c}"), F.lit(float(pooled[c]))) for c in names}
    # one token at least: Spark computes this for texts without words too, whatever base_failed says
    n_tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    wide = spread * F.greatest(F.lit(1.0), F.sqrt(at["tokens"] / n_tokens))

    def reach(c: str) -> Column:
        return wide * F.greatest(at[f"{c}3"] - at[f"{c}1"], F.lit(LEAST_RANGE[c]))

    own_value = _judged()
    inside = (own_value["f"].between(at["f1"] - reach("f"), at["f3"] + reach("f"))
              & (own_value["b"] <= F.greatest(at["b3"] + reach("b"), F.lit(MIN_BYTE_SHARE)))
              & (own_value["e"] >= at["e1"] - reach("e")))
    joined = measured.withColumn("_key", key).join(
        F.broadcast(own), F.col("_key") == F.col("_lang"), "left")
    verdict = F.struct(base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))
    return with_fields(joined, verdict, ["base_failed", "kept"]).drop(
        "_key", "_lang", *[f"_{c}" for c in names])
