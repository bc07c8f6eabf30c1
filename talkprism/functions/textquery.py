"""Boolean text queries over token arrays: a small tree, its guard, a match column, an evidence column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkprism.errors import InvalidQuery

#: Limits of the guard.
MAX_NODES, MAX_DEPTH, MAX_WORD_BYTES, MAX_PHRASE_WORDS, MAX_PHRASE_BYTES, MAX_DISTANCE = 64, 16, 256, 32, 2048, 10_000
EVIDENCE = "array<struct<term:string,spans:array<struct<start:int,end:int>>>>"


def _normal(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, where f uses it several times or inside other functions' lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


class Query:
    def parts(self) -> tuple[Query, ...]:
        return ()

    def matches(self, tokens: Column) -> Column:
        raise NotImplementedError

    def terms(self) -> list[Query]:
        """The terms that give evidence; none below a negation."""
        return [t for p in self.parts() for t in p.terms()]

    def spans(self, tokens: Column) -> Column:
        raise NotImplementedError

    def words(self) -> set[str]:
        """The normalised words that the query asks for."""
        return set().union(*[p.words() for p in self.parts()])

    def holds(self, at: Column) -> Column:
        """As ``matches``, by a map of the query's words to their places."""
        raise NotImplementedError

    def places(self, at: Column) -> Column:
        """As ``spans``, by that map."""
        raise NotImplementedError


def _places(at: Column, word: str) -> Column:
    return F.coalesce(at[_normal(word)[0]], F.array().cast("array<int>"))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _positions(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


@dataclass(frozen=True)
class Word(Query):
    text: str

    def matches(self, tokens):
        return F.array_contains(tokens, _normal(self.text)[0])

    def terms(self):
        return [self]

    def spans(self, tokens):
        word = _normal(self.text)[0]
        return F.transform(F.filter(_positions(tokens), lambda i: F.get(tokens, i) == word), lambda i: _span(i, i))

    def words(self):
        return {_normal(self.text)[0]}

    def holds(self, at):
        return F.size(_places(at, self.text)) > 0

    def places(self, at):
        return F.transform(_places(at, self.text), lambda i: _span(i, i))


@dataclass(frozen=True)
class Phrase(Query):
    text: str

    def _starts(self, tokens):
        own = _normal(self.text)
        return F.filter(_positions(tokens), lambda i: F.slice(tokens, i + 1, len(own)) == F.array(*[F.lit(w) for w in own]))

    def matches(self, tokens):
        return F.size(self._starts(tokens)) > 0

    def terms(self):
        return [self]

    def spans(self, tokens):
        n = len(_normal(self.text))
        return F.transform(self._starts(tokens), lambda i: _span(i, i + (n - 1)))

    def words(self):
        return set(_normal(self.text))

    def _starts_at(self, at):
        first, *rest = _normal(self.text)
        starts = _places(at, first)
        for k, word in enumerate(rest, 1):
            starts = F.array_intersect(starts, _shifted(_places(at, word), k))
        return starts

    def holds(self, at):
        return F.size(self._starts_at(at)) > 0

    def places(self, at):
        n = len(_normal(self.text))
        return F.transform(self._starts_at(at), lambda i: _span(i, i + (n - 1)))


@dataclass(frozen=True)
class Near(Query):
    """Two words with at most ``distance`` words between them, in either order."""

    left: str
    right: str
    distance: int

    def _of(self, tokens, word):
        return F.filter(_positions(tokens), lambda i: F.get(tokens, i) == _normal(word)[0])

    def _around(self, right, size, use):
        """``use(right, around)``: the right words' places, and the slice of them near a place, as (first, number).

        One array has, for every place up to the end (``size``), how many right words come before
        it; so a slice is two lookups, whatever the number of words.
        """

        def with_right(right):
            gaps = F.transform(right, lambda j, k: F.array_repeat(k, j - F.coalesce(F.get(right, k - 1), F.lit(-1))))
            rest = F.array_repeat(F.size(right), size - F.coalesce(F.get(right, F.size(right) - 1), F.lit(-1)))

            def with_before(before):
                def around(i):
                    first = F.get(before, F.greatest(i - (self.distance + 1), F.lit(0)))
                    return first, F.get(before, F.least(i + (self.distance + 2), size)) - first

                return use(right, around)

            return bind(F.flatten(F.array_append(gaps, rest)), with_before)

        return bind(right, with_right)

    def _hit(self, left, right, size):
        itself = int(_normal(self.left) == _normal(self.right))
        return self._around(right, size, lambda _, around: F.exists(left, lambda i: around(i)[1] > itself))

    def _pairs(self, left, right, size):
        def pairs(right, around):
            def of(i):
                first, n = around(i)
                return F.transform(F.filter(F.slice(right, first + 1, n), lambda j: j != i), lambda j: _span(F.least(i, j), F.greatest(i, j)))

            return F.flatten(F.transform(left, of))

        return self._around(right, size, pairs)

    def matches(self, tokens):
        return self._hit(self._of(tokens, self.left), self._of(tokens, self.right), F.size(tokens))

    def terms(self):
        return [self]

    def words(self):
        return {_normal(self.left)[0], _normal(self.right)[0]}

    def spans(self, tokens):
        return self._pairs(self._of(tokens, self.left), self._of(tokens, self.right), F.size(tokens))

    def _indexed(self, at):
        left, right = _places(at, self.left), _places(at, self.right)
        return left, right, F.coalesce(F.greatest(F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(-1))) + 1, F.lit(0))

    def holds(self, at):
        return self._hit(*self._indexed(at))

    def places(self, at):
        return self._pairs(*self._indexed(at))


@dataclass(frozen=True)
class AllOf(Query):
    of: tuple[Query, ...]

    def parts(self):
        return self.of

    def matches(self, tokens):
        out = self.of[0].matches(tokens)
        for q in self.of[1:]:
            out = out & q.matches(tokens)
        return out

    def holds(self, at):
        out = self.of[0].holds(at)
        for q in self.of[1:]:
            out = out & q.holds(at)
        return out


@dataclass(frozen=True)
class AnyOf(Query):
    of: tuple[Query, ...]

    def parts(self):
        return self.of

    def matches(self, tokens):
        out = self.of[0].matches(tokens)
        for q in self.of[1:]:
            out = out | q.matches(tokens)
        return out

    def holds(self, at):
        out = self.of[0].holds(at)
        for q in self.of[1:]:
            out = out | q.holds(at)
        return out


@dataclass(frozen=True)
class Not(Query):
    of: Query

    def parts(self):
        return (self.of,)

    def matches(self, tokens):
        return ~self.of.matches(tokens)

    def holds(self, at):
        return ~self.of.holds(at)

    def terms(self):
        return []


def check(query: Query) -> Query:
    """The query, or InvalidQuery if it is too large or has an empty part."""
    level, nodes, depth = [query], 0, 0
    while level:
        nodes, depth = nodes + len(level), depth + 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            raise InvalidQuery("too many nodes or levels")
        for q in level:
            if isinstance(q, AllOf | AnyOf) and not q.of:
                raise InvalidQuery("an empty list of queries")
            if isinstance(q, Word | Near):
                own = [q.text] if isinstance(q, Word) else [q.left, q.right]
                if any(len(w.encode()) > MAX_WORD_BYTES or len(_normal(w)) != 1 for w in own):
                    raise InvalidQuery("a word is too long or isn't one word")
            if isinstance(q, Phrase) and not (0 < len(_normal(q.text)) <= MAX_PHRASE_WORDS and len(q.text.encode()) <= MAX_PHRASE_BYTES):
                raise InvalidQuery("a phrase is empty or too long")
            if isinstance(q, Near) and not 0 <= q.distance <= MAX_DISTANCE:
                raise InvalidQuery("a distance is out of range")
        level = [p for q in level for p in q.parts()]
    return query


def holds_without_words(query: Query) -> bool:
    """Whether a text with none of the query's words matches."""
    if isinstance(query, AllOf | AnyOf):
        return (all if isinstance(query, AllOf) else any)(holds_without_words(q) for q in query.of)
    return isinstance(query, Not) and not holds_without_words(query.of)


def _as_evidence(found: list[Column]) -> Column:
    if not found:
        return F.array().cast(EVIDENCE)
    return F.filter(F.array(*found).cast(EVIDENCE), lambda e: F.size(e["spans"]) > 0)


def evidence(query: Query, tokens: Column) -> Column:
    """For each term its spans: inclusive token positions from 0. Terms without a span are left out."""
    return _as_evidence([F.struct(F.lit(str(t)).alias("term"), t.spans(tokens).alias("spans")) for t in query.terms()])


def indexed_evidence(query: Query, at: Column) -> Column:
    """As ``evidence``, by a map of the query's words to their places."""
    return _as_evidence([F.struct(F.lit(str(t)).alias("term"), t.places(at).alias("spans")) for t in query.terms()])
