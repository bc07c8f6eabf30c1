"""Batches of requests, checked as columns before they are served.

The same limits hold as for a single request, which is refused by an exception; here every row
gets the names of its rejections, so a log or a queue of requests is checked where it lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprism.errors import InvalidQuery, InvalidRequest, InvalidTimeWindow, LimitExceeded, Oversized
from talkprism.functions import textquery as tq
from talkprism.functions.text import byte_length, tokens
from talkprism.functions.timestamps import instant
from talkprism.operators.config import InterfaceLimits
from talkprism.plans.paging import ORDERS

#: Columns of a batch, with their types; those that it lacks aren't asked for.
REQUEST = {
    "page_items": "long",
    "sort": "string",
    "preview_bytes": "long",
    "read_bytes": "long",
    "word": "string",
    "phrase": "string",
    "near_left": "string",
    "near_right": "string",
    "distance": "long",
    "window_start": "string",
    "window_end": "string",
    "budget_segments": "long",
    "budget_bytes": "long",
}
#: Aspects in the order in which a request is checked.
ASPECTS = ("window", "budget", "query", "preview", "page", "sort", "read")


def _limit(value: Column, most: int) -> Column:
    return F.when(value <= 0, InvalidRequest.__name__).when(value > most, Oversized.__name__)


def _not_a_word(word: Column) -> Column:
    return (byte_length(word) > tq.MAX_WORD_BYTES) | (F.size(tokens(word)) != 1)


def _query(c: dict[str, Column]) -> Column:
    """What a word, a phrase and two words near each other may be; a near query lacks none of its parts."""
    phrase_words = F.size(tokens(c["phrase"]))
    phrase = (phrase_words == 0) | (phrase_words > tq.MAX_PHRASE_WORDS) | (byte_length(c["phrase"]) > tq.MAX_PHRASE_BYTES)
    parts = [c["near_left"], c["near_right"], c["distance"]]
    asked = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
    lacks = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    near = asked & (lacks | _not_a_word(parts[0]) | _not_a_word(parts[1]) | ~parts[2].between(0, tq.MAX_DISTANCE))
    # A part that isn't there isn't wrong.
    wrong = [F.coalesce(x, F.lit(False)) for x in (_not_a_word(c["word"]), phrase, near)]
    return F.when(reduce(lambda a, b: a | b, wrong), InvalidQuery.__name__)


def _window(start: Column, end: Column) -> Column:
    """A window without an end is open; one without a start, reversed or with texts that aren't canonical is refused."""
    unread = [t.isNotNull() & instant(t).isNull() for t in (start, end)]
    reversed_ = F.coalesce(instant(start) > instant(end), F.lit(False))
    return F.when(unread[0] | unread[1] | reversed_ | (end.isNotNull() & start.isNull()), InvalidTimeWindow.__name__)


def with_errors(requests: DataFrame, limits: InterfaceLimits = InterfaceLimits()) -> DataFrame:
    """``requests`` with a column ``<aspect>_error`` for each of ASPECTS and ``error``, the first of them: the name of the rejection, null if there is none.

    A null value isn't asked for and so isn't refused. Built-in expressions alone: no shuffle.
    """
    c = {k: F.col(f"`{k}`") if k in requests.columns else F.lit(None).cast(t) for k, t in REQUEST.items()}
    found = {
        "window": _window(c["window_start"], c["window_end"]),
        "budget": F.when((c["budget_segments"] <= 0) | (c["budget_bytes"] <= 0), LimitExceeded.__name__),
        "query": _query(c),
        "preview": _limit(c["preview_bytes"], limits.preview_bytes),
        "page": _limit(c["page_items"], limits.page_items),
        "sort": F.when(~c["sort"].isin(*ORDERS), InvalidRequest.__name__),
        "read": _limit(c["read_bytes"], limits.read_bytes),
    }
    rows = requests.withColumns({f"{a}_error": found[a] for a in ASPECTS})
    return rows.withColumn("error", F.coalesce(*[F.col(f"{a}_error") for a in ASPECTS]))


def admitted(requests: DataFrame, limits: InterfaceLimits = InterfaceLimits()) -> DataFrame:
    """The requests that nothing is wrong with, with their own columns."""
    return with_errors(requests, limits).where(F.col("error").isNull()).select(*[F.col(f"`{c}`") for c in requests.columns])


def rejections(requests: DataFrame, limits: InterfaceLimits = InterfaceLimits()) -> DataFrame:
    """(aspect, error, requests): how many requests fail each check, those that fail several counted at each."""
    rows = with_errors(requests, limits)
    pairs = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_error").alias("error")) for a in ASPECTS])
    return rows.select(F.inline(F.filter(pairs, lambda p: p["error"].isNotNull()))).groupBy("aspect", "error").agg(F.count(F.lit(1)).alias("requests"))
