"""Quality rules by repetition coverage.

Every text is cut into words; rolling hashes of several n-gram lengths, computed with numpy
over the whole text, tell which words lie inside an n-gram that occurs twice or more. The
share of the text's characters inside such n-grams and inside repeated lines is held against
one limit for each length; so is the share inside occurrences after the first, which tells a
passage quoted once more from one that comes again and again. The base rule sees windows of five
words only; the limits on two to four words see what stammers or shuffles short phrases.

Defined cases: a null text counts as empty; an empty text has zeros throughout and fails (too
few words); a very long text is read whole; rows are judged one by one, so ties, repeated rows
and other columns, whatever their names, don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkprism.llm.common import free_name, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MIN_WORDS = 10
BASE_N = 5
BASE_PERCENT = 20
#: Largest share of characters inside duplicated n-grams, by n, and inside repeated lines. One
#: passage quoted twice in a short text covers up to a fifth of it; that alone must not reject it.
#: Chosen on labelled documents with an even id: falling by a hundredth a word, above the largest
#: share among good ones within the base rule (24.4 % at two words, 20.4 % at five, 16.7 % at ten).
NGRAM_LIMITS = {2: 0.28, 3: 0.27, 4: 0.26, 5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.2}
LINE_LIMIT = 0.22
#: Largest share of characters inside occurrences after the first. A passage that occurs twice has half of its
#: coverage there, so within the base rule it stays; one that occurs three times or more has two thirds or more.
AGAIN_LIMITS = {2: 0.15, 3: 0.14, 4: 0.13, 5: 0.11, 6: 0.108, 7: 0.106, 8: 0.104, 9: 0.102, 10: 0.1}
_BASE = np.uint64(0x9E3779B97F4A7C15)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_LIMITS), *(f"again_chars_{n}" for n in AGAIN_LIMITS))


def covered_words(hashes: np.ndarray, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n, masks of the words inside an n-gram that occurs at least twice, and inside its occurrences after the first. A length without repeats ends the search: no longer n-gram can repeat."""
    total = len(hashes)
    out = {n: (np.zeros(total, dtype=bool),) * 2 for n in sizes}
    rolling, length = hashes.copy(), 1
    for n in sorted(sizes):
        if total <= n:
            break
        while length < n:
            rolling = rolling[:-1] * _BASE + hashes[length:]
            length += 1
        order = np.argsort(rolling, kind="stable")
        equal = rolling[order[1:]] == rolling[order[:-1]]
        if not equal.any():
            break
        later = order[1:][equal]  # the sort is stable: of equal n-grams the first in the text comes first
        out[n] = _inside(np.union1d(later, order[:-1][equal]), n, total), _inside(later, n, total)
    return out


def _inside(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """A mask of the words inside the n-grams that start at the distinct places ``at``."""
    starts = np.zeros(total + 1, dtype=np.int64)
    starts[at] += 1
    starts[at + n] -= 1
    return np.cumsum(starts)[:total] > 0


def repetition_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of STATS for one text."""
    tokens = words(text)
    sizes = tuple(NGRAM_LIMITS)
    if not tokens:
        symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
        return (0, 0, symbols, *[0] * (3 + 2 * len(sizes)))
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += len(line) - sum(line.count(c) for c in SPACES)
        elif line.strip(SPACES):
            seen.add(line)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in tokens), dtype=np.uint64, count=len(tokens))
    masks = covered_words(hashes, sizes)
    chars = None
    dup_chars, again_chars = [], []
    for n in sizes:
        repeated, later = masks[n]
        if chars is None and repeated.any():
            chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in tokens), dtype=np.int64, count=len(tokens))
        dup_chars.append(int(chars[repeated].sum()) if repeated.any() else 0)
        again_chars.append(int(chars[later].sum()) if repeated.any() else 0)
    return (len(tokens), word_chars, n_symbols, dup_lines, int(masks[BASE_N][0].sum()), dup_line_chars, *dup_chars, *again_chars)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repetition_stats(t) for t in texts], columns=list(STATS), dtype="int64")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > BASE_PERCENT * q["n_words"])


def verdict(q: Column) -> Column:
    """True if neither the base rule nor a coverage limit rejects the text."""
    kept = ~base_failed(q) & (q["dup_line_chars"] <= LINE_LIMIT * q["word_chars"])
    for n, limit in NGRAM_LIMITS.items():
        kept = kept & (q[f"dup_chars_{n}"] <= limit * q["word_chars"])
    for n, limit in AGAIN_LIMITS.items():
        kept = kept & (q[f"again_chars_{n}"] <= limit * q["word_chars"])
    return kept


def with_repetition(docs: DataFrame, text: str = "text", into: str = "repetition") -> DataFrame:
    """``docs`` with a struct column ``into`` of STATS."""
    return docs.withColumn(into, _stats(F.col(text)))


def reject_repetitive(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    q = free_name(docs, "repetition")
    return with_repetition(docs, text, q).filter(verdict(F.col(q))).select(*[F.col(f"`{c}`") for c in docs.columns])
