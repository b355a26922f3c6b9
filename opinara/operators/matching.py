"""Lexicon matching within the row: terms in tokenized or plain text, longer terms before those inside them. No shuffle."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import ClassVar

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions import text as T

_HIT = "array<struct<start:int,neg:int,ord:int,term:string>>"
#: Rows that are Python objects at a time.
_PART = 64


def is_thai(term: str) -> bool:
    return any("ก" <= c <= "๙" for c in term)


def array_of(values: list) -> Column:
    return F.array(*map(F.lit, values))


def joined(tokens: Column) -> Column:
    """The text in which hits have their places: lower-case tokens joined by spaces."""
    return F.array_join(F.transform(tokens, F.lower), " ")


def lower(text: str) -> str:
    """In lower case, every character still one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Lexicon:
    """Terms of any number, found in one pass over a text: two automata, which a Python worker builds once.

    A term without Thai letters stands as a whole word, in any case. A term with Thai letters begins a text or follows white
    space, may end inside a word, and may have white space between its characters. Of a term's hits that overlap the first
    counts; of equal terms the first in the list. A hit is (start, minus end, place of the term, term); hits are in this order.
    """

    _built: ClassVar[dict[str, tuple]] = {}

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.key = terms, uuid.uuid4().hex

    def _automata(self) -> tuple:
        if self.key not in self._built:
            if len(self._built) >= 16:
                self._built.clear()
            kinds = [{}, {}, {}]
            for k, t in enumerate(self.terms):
                low = lower(t)
                if is_thai(t):
                    kinds[2].setdefault("".join(low.split()), (k, t))
                elif low:
                    kinds[0].setdefault(f" {low} ", (k, t))
                    kinds[1].setdefault(low, (k, t))
            self._built[self.key] = tuple(self._automaton(x) for x in kinds)
        return self._built[self.key]

    @staticmethod
    def _automaton(words: dict[str, tuple[int, str]]):
        if not words:
            return None
        found = ahocorasick.Automaton()
        for w, (k, t) in words.items():
            found.add_word(w, (len(w), k, t))
        found.make_automaton()
        return found

    @staticmethod
    def _ordered(hits: list[tuple]) -> list[tuple]:
        hits.sort()
        ends, out = {}, []
        for hit in hits:
            if hit[0] >= ends.get(hit[2], 0):
                ends[hit[2]] = -hit[1]
                out.append(hit)
        return out

    def in_tokens(self, tokens: list[str]) -> list[tuple]:
        """Hits in the lower-case tokens joined by spaces; words are tokens."""
        low = [lower(t) for t in tokens]
        text = " ".join(low)
        whole, _, thai = self._automata()
        hits = [(end - n + 1, 1 - end, k, t) for end, (n, k, t) in whole.iter(f" {text} ")] if whole else []
        found = list(thai.iter("".join(low))) if thai else []
        if found:
            firsts, starts, flat, at = {}, [], [], 0
            for i, t in enumerate(low):
                firsts.setdefault(at, i)
                flat.append(at)
                starts.append(at + i)
                at += len(t)
            for end, (n, k, t) in found:
                i = firsts.get(end - n + 1)
                if i is not None:
                    j = bisect_left(flat, end + 1) - 1
                    hits.append((starts[i], -(starts[j] + end + 1 - flat[j]), k, t))
        return self._ordered(hits)

    def in_text(self, text: str) -> list[tuple]:
        """Hits in plain text; words are runs of letters, digits and underscores."""
        low = lower(text)
        _, plain, thai = self._automata()
        hits, n_text = [], len(low)
        for end, (n, k, t) in plain.iter(low) if plain else ():
            at = end - n + 1
            if (at == 0 or not _word(low[at - 1])) and (end + 1 == n_text or not _word(low[end + 1])):
                hits.append((at, -(end + 1), k, t))
        if thai and is_thai(low):
            places = [i for i, c in enumerate(low) if not c.isspace()]
            for end, (n, k, t) in thai.iter("".join(low.split())):
                at = places[end - n + 1]
                if at == 0 or low[at - 1].isspace():
                    hits.append((at, -(places[end] + 1), k, t))
        return self._ordered(hits)


def outermost(hits: list[tuple]) -> list[tuple]:
    """Ordered hits without those that lie inside an earlier one."""
    far, out = 0, []
    for hit in hits:
        if -hit[1] > far:
            far = -hit[1]
            out.append(hit)
    return out


def _python(column: pa.Array) -> list:
    """Strings, or lists of strings, as Python objects: by way of numpy, as Arrow makes an object of its own for every string."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    flat, at, out = column.flatten().to_numpy(zero_copy_only=False).tolist(), 0, []
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else flat[at : at + n])
        at += n or 0
    return out


def _hits_of(find: Callable[[object], list[tuple]]):
    @F.arrow_udf(_HIT)
    def hits(column: pa.Array) -> pa.Array:
        rows = [[] if x is None else find(x) for k in range(0, len(column), _PART) for x in _python(column[k : k + _PART])]
        start, neg, place, term = zip(*(h for x in rows for h in x), strict=True) if any(rows) else ((), (), (), ())
        flat = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(neg, pa.int32()), pa.array(place, pa.int32()), pa.array(term, pa.string())], names=["start", "neg", "ord", "term"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), flat)

    # so marked, filters of a query are not pushed below (and do not repeat) all that makes its input
    return hits.asNondeterministic()


def token_hits(tokens: Column, terms: list[str]) -> Column:
    """array<(start, neg, ord, term)> of all hits of terms in ``joined(tokens)``; neg is minus the end, ord the term's place in
    the list. Null has none."""
    return _hits_of(Lexicon(terms).in_tokens)(tokens)


def text_hits(text: Column, terms: list[str]) -> Column:
    """The same in plain text."""
    return _hits_of(Lexicon(terms).in_text)(text)


def kept(hits: Column, terms: list[str] | None = None) -> Column:
    """The hits of some terms, of hits in the order of ``token_hits``, without those that lie inside an earlier one; one pass."""
    own = hits if terms is None else F.filter(hits, lambda h: h["term"].isin(*terms))
    none = F.struct(F.lit(1).alias("far"), F.array().cast(_HIT).alias("out"))
    # far is minus the largest end so far
    step = lambda a, h: F.when(h["neg"] < a["far"], F.struct(h["neg"].alias("far"), F.array_append(a["out"], h).alias("out"))).otherwise(a)
    return F.aggregate(own, none, step, lambda a: a["out"])


def names(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["term"])


def drop_inner(terms: Column) -> Column:
    """Distinct terms without those that are part of another one; order kept."""
    return T.let(F.array_distinct(terms), lambda once: F.filter(once, lambda t: ~F.exists(once, lambda u: (u != t) & F.contains(u, t))))


def _outer(terms: list[str]) -> list[str]:
    """One automaton of all terms runs over each of them; what it finds, but for the term itself, is a part."""
    once = list(dict.fromkeys(terms))
    found = ahocorasick.Automaton()
    for k, t in enumerate(once):
        if t:
            found.add_word(t, k)
    inner = {""} if len(once) > 1 else set()
    if len(found):
        found.make_automaton()
        parts = {k for own, u in enumerate(once) if u for _, k in found.iter(u) if k != own}
        inner.update(once[k] for k in parts)
    return [t for t in once if t not in inner]


def drop_inner_long(terms: Column) -> Column:
    """``drop_inner`` for long lists, such as all words of a text: time grows with their letters and with what is found, not
    with the pairs of terms. Null stays null."""

    @F.arrow_udf("array<string>")
    def outer(terms: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = (terms[k : k + _PART].to_pylist() for k in range(0, len(terms), _PART))
        return pa.concat_arrays([pa.array([], kind), *(pa.array([None if x is None else _outer(x) for x in part], kind) for part in parts)])

    return outer(terms)


def gazetteers(text: Column, lists: dict[str, list[str]]) -> Column:
    """struct of a list's name to the sorted distinct terms of it that stand in plain text; a term inside a longer one of the
    same list does not count. The lists are looked up independently, in one pass over the rows."""
    books = [Lexicon(terms) for terms in lists.values()]

    @F.arrow_udf("struct<" + ",".join(f"{name}:array<string>" for name in lists) + ">")
    def found(texts: pa.Array, _: pa.Array) -> pa.Array:
        def of(book: Lexicon) -> Iterator[list[str]]:
            for k in range(0, len(texts), _PART):
                for t in texts[k : k + _PART].to_pylist():
                    yield sorted({hit[3] for hit in outermost(book.in_text(t))}) if t else []

        return pa.StructArray.from_arrays([pa.array(list(of(b)), pa.list_(pa.string())) for b in books], names=list(lists))

    # a column that is named twice keeps a projection of its own: Spark cannot call Python on an expression that holds lambdas
    return found.asNondeterministic()(text, F.octet_length(text))
