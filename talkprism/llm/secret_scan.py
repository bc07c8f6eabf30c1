"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

DataFrame functions only. Three patterns give the base spans (``assign``, ``access``, ``hex``).
The battery adds ``random`` spans: runs of 20 or more token characters that overlap no base
span. For each run the narrowest encoding that holds it is inferred (digits, hex, one-case or
mixed letters, base 32, 36, 62, 64) and three tests ask whether its characters look drawn at
random from that alphabet: Pearson's chi-squared against uniformity, Wald-Wolfowitz runs about
the middle of the alphabet, and lag-1 serial correlation. Their squared deviates add up to one
statistic with three degrees of freedom; beyond CRITICAL the run is not random.

What passes must also be a discovery. The null is ordinary text: letters by their usual
frequencies, digits and signs, with rare changes between lower case, upper case, digit and
sign. The likelihood ratio of the uniform alphabet to the null, T, bounds the p-value by
exp(-T) (Markov), so longer runs can reach smaller ones. Benjamini-Hochberg at level FDR holds
within classes of length, over all runs of the table; T is binned downward, so the bounds stay
valid and only a table of counts, of fixed size, reaches the driver. Strings of digits are as
likely in ordinary text as at random here (T near 0), so numbers are never ``random``.

Defined cases: a null or empty text has no spans; rows are scanned one by one, so ties,
repeated rows, null ids and other columns don't matter; an empty table gives an empty result.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprism.llm.common import free_name

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more: a shorter match ends its run
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 or more
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Chi-squared, 3 degrees of freedom, upper 0.001.
CRITICAL = 16.266
FDR = 0.01
#: Upper ends of the classes of length, and the number of bins of T (one nat each, the last open).
LENGTHS = (24, 32, 48, 64, 128)
BINS = 200
#: Values in a chunk of the running sums, and code points in a block of a text that is cut.
CHUNK = 128
BLOCK = 1024
#: Letters of ordinary text, per mille, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_LOWER, _UPPER, _DIGIT, _SIGN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/"
#: What parts a run's segments, and the fewest other characters to test.
SEPARATORS = "[-_=]"
LEAST = 16
#: Inferred encodings, narrowest first: pattern, alphabet.
ENCODINGS = (
    ("^[0-9]+$", _DIGIT),
    ("^[0-9a-f]+$", _DIGIT + _LOWER[:6]),
    ("^[0-9A-F]+$", _DIGIT + _UPPER[:6]),
    ("^[a-z]+$", _LOWER),
    ("^[A-Z]+$", _UPPER),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGIT + _LOWER),
    ("^[0-9A-Z]+$", _DIGIT + _UPPER),
    ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGIT),
    ("^", _UPPER + _LOWER + _DIGIT + _SIGN),
)
_STAY, _MOVE = math.log(0.9), math.log(0.1 / 3)


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda acc, x: acc + x) -> Column:
    """The sum of the values, or what ``combine`` makes of them from 0 on, up to each one, by chunks: an array that grows is copied at every step. ``values`` must be a lambda variable."""
    total = lambda v: F.aggregate(v, F.lit(0), combine)

    def steps(v: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(v, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(combine(acc["at"], x))).alias("out")))["out"]

    last = F.floor(F.size(values) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    before = lambda ends: F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
    return _bind(chunks, lambda parts: _bind(steps(F.transform(parts, total), F.lit(0)), lambda ends: F.flatten(F.zip_with(parts, before(ends), steps))))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, match), leftmost and non-overlapping: the pieces between the matches give the offsets."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda gap, match: gap + F.length(match))
        pairs = F.zip_with(_bind(steps, lambda v: running(v)), found, lambda end, match: F.struct((end - F.length(match)).alias("start"), match.alias("match")))
        none = F.array().cast("array<struct<start:int,match:string>>")
        return F.when(F.size(found) > 0, pairs).otherwise(none)

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["match"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end), in order."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(_spans(assign, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")))


def _alphabet(run: Column) -> Column:
    out = F.lit(ENCODINGS[-1][1])
    for pattern, alphabet in reversed(ENCODINGS[:-1]):
        out = F.when(run.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def _null_likelihood(chars: Column) -> Column:
    """Natural logarithm of the characters' probability as ordinary text."""
    signs = _UPPER + _LOWER + _DIGIT + _SIGN
    letters = [math.log(x / sum(LETTERS)) for x in LETTERS]
    logs = F.array(*[F.lit(x) for x in [*letters, *letters, *[math.log(0.1)] * 10, *[math.log(0.5)] * 2]])
    at = F.transform(chars, lambda c: F.call_function("locate", c, F.lit(signs)))
    kinds = F.transform(at, lambda i: F.when(i <= 26, 0).when(i <= 52, 1).when(i <= 62, 2).otherwise(3))
    moves = F.zip_with(F.slice(kinds, 1, F.size(chars) - 1), F.slice(kinds, 2, F.size(chars) - 1), lambda a, b: F.when(a == b, F.lit(_STAY)).otherwise(F.lit(_MOVE)))
    total = F.aggregate(at, F.lit(math.log(0.25)), lambda acc, i: acc + F.element_at(logs, i))
    return F.aggregate(moves, total, lambda acc, m: acc + m)


def battery(run: Column) -> Column:
    """Struct of one run's statistic (three squared deviates, added) and T, the log likelihood ratio of random to ordinary.

    ``run`` must be a lambda variable or a plain column; each step below is bound once, by transform over an array of one.
    """
    def of(v: Column) -> Column:
        n, k = F.size(v["chars"]).cast("double"), F.length(v["alphabet"]).cast("double")
        x = F.transform(v["chars"], lambda c: (F.call_function("locate", c, v["alphabet"]) - 1).cast("double"))
        return _bind(F.struct(v["run"].alias("run"), v["chars"].alias("chars"), n.alias("n"), k.alias("k"), x.alias("x")), tests)

    def tests(v: Column) -> Column:
        n, k, x = v["n"], v["k"], v["x"]
        add = lambda acc, y: acc + y
        square = F.aggregate(F.array_distinct(v["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(v["run"]) - F.length(F.replace(v["run"], c, F.lit(""))), F.lit(2.0)))
        chi = (k / n * square - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mean = F.aggregate(x, F.lit(0.0), add) / n
        before, after = F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1)
        high = F.aggregate(x, F.lit(0.0), lambda acc, y: acc + F.when(y >= k / 2, 1.0).otherwise(0.0))
        turns = F.aggregate(F.zip_with(before, after, lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0)), F.lit(1.0), add)
        parts = F.struct(chi.alias("chi"), mean.alias("mean"), high.alias("high"), turns.alias("turns"), before.alias("before"), after.alias("after"), x.alias("x"), n.alias("n"), k.alias("k"), v["chars"].alias("chars"))
        return _bind(parts, combine)

    def combine(v: Column) -> Column:
        n, both = v["n"], 2 * v["high"] * (v["n"] - v["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, F.pow(v["turns"] - both / n - 1, F.lit(2.0)) / spread).otherwise(n)
        scale = F.aggregate(v["x"], F.lit(0.0), lambda acc, y: acc + (y - v["mean"]) * (y - v["mean"]))
        lag = F.aggregate(F.zip_with(v["before"], v["after"], lambda a, b: (a - v["mean"]) * (b - v["mean"])), F.lit(0.0), lambda acc, y: acc + y)
        serial = F.when(scale > 0, n * F.pow(lag / scale + 1 / n, F.lit(2.0))).otherwise(n)
        ratio = -n * F.log(v["k"]) - _null_likelihood(v["chars"])
        return F.struct((v["chi"] * v["chi"] + runs + serial).alias("statistic"), ratio.alias("ratio"))

    return _bind(F.struct(run.alias("run"), F.split(run, "").alias("chars"), _alphabet(run).alias("alphabet")), of)


def _length_class(run: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, end in reversed(list(enumerate(LENGTHS))):
        out = F.when(F.length(run) < end, F.lit(i)).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Array of (start, end, length class, bin of T) of every run; bin 0 if a test rejects randomness."""

    def judged(m: Column) -> Column:
        score = _bind(F.regexp_replace(m["match"], SEPARATORS, ""), lambda run: F.when(F.length(run) >= LEAST, battery(run)))
        bound = _bind(score, lambda b: F.when(b["statistic"] <= CRITICAL, F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(b["ratio"]).cast("int")))).otherwise(F.lit(0)))
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), _length_class(m["match"]).alias("length_class"), bound.alias("bin"))

    return F.transform(matches(text, RUN), judged)


def discovery_bins(counts: dict[tuple[int, int], int], level: float = FDR) -> list[int]:
    """For each class of length the least bin accepted by Benjamini-Hochberg; BINS if none is. counts: runs by (class, bin)."""
    out = []
    for length in range(len(LENGTHS) + 1):
        total = sum(n for (c, _), n in counts.items() if c == length)
        above, least = 0, BINS
        for b in range(BINS - 1, 0, -1):
            above += counts.get((length, b), 0)
            if above and math.exp(-b) <= level * above / total:
                least = b
        out.append(least)
    return out


def thresholds(docs: DataFrame, text: str = "text", level: float = FDR) -> list[int]:
    """discovery_bins over all runs of the table. At most BINS counts a class reach the driver."""
    runs = docs.select(F.explode(candidates(F.col(text))).alias("c"))
    rows = runs.groupBy("c.length_class", "c.bin").count().collect()
    return discovery_bins({(r[0], r[1]): r[2] for r in rows}, level)


def with_spans(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans", level: float = FDR) -> DataFrame:
    """``docs`` with the base spans and all spans: arrays of (start, rank of the kind, end), in order."""
    least = F.array(*[F.lit(b) for b in thresholds(docs, text, level)])
    runs = free_name(docs, "random_runs")
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(base, base_spans(whole)).withColumn(runs, F.filter(candidates(whole), lambda c: c["bin"] >= F.element_at(least, c["length_class"] + 1)))
    apart = F.filter(F.col(runs), lambda c: ~F.exists(F.col(base), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.transform(apart, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end")))
    return out.withColumn(spans, F.array_sort(F.concat(F.col(base), added))).drop(runs)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each span; a span that starts inside earlier ones adds none. Pieces are taken from blocks of the text, so the cost is near linear in the text and the spans."""
    block = lambda blocks, k: F.coalesce(F.get(blocks, k), F.lit(""))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        whole = F.concat(F.substring(block(blocks, first), a % BLOCK + 1, F.lit(BLOCK)), inner, F.substring(block(blocks, last), F.lit(1), b % BLOCK))
        return F.when(first == last, F.substring(block(blocks, first), a % BLOCK + 1, b - a)).otherwise(whole)

    def joined(v: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), v["ends"]), F.lit(1), F.size(v["ends"]))
        gaps = F.filter(F.zip_with(before, v["spans"], lambda a, s: F.struct(a.alias("a"), s["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        gaps = F.concat(gaps, F.array(F.struct(F.array_max(v["ends"]).alias("a"), v["length"].alias("b"))))
        return F.array_join(F.transform(gaps, lambda g: piece(v["blocks"], g["a"], g["b"])), mark)

    ends = _bind(F.transform(spans, lambda s: s["end"]), lambda e: running(e, lambda acc, x: F.greatest(acc, x)))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _bind(F.struct(ends.alias("ends"), spans.alias("spans"), blocks.alias("blocks"), F.length(text).alias("length")), joined)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", level: float = FDR) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans become one mark. A column n_chars follows the text."""
    base = free_name(docs, "base_spans")
    spans = free_name(docs, "secret_spans")
    whole = F.col(text)
    # The new text gets a name of its own: a column that is named like the old one would stand for it in what follows.
    new = free_name(docs, "redacted_text")
    found = with_spans(docs, text, base, spans, level).withColumn(new, F.when(F.size(spans) > 0, _cut(whole, F.col(spans), mark)).otherwise(whole))
    columns = {text: F.col(new)}
    if "n_chars" in docs.columns and text == "text":
        columns["n_chars"] = F.when(F.size(spans) > 0, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
