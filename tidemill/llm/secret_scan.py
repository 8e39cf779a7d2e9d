"""Secret scan by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must hold.
Documents are indexed segment by segment (a segment is a chunk of a partition, as in a document-sharded
search index): trigram -> sorted postings of document numbers. Postings are intersected and united as the
query says, and only candidate documents meet the regular expression. A rule without mandatory trigrams
scans every document. There is no shuffle, and memory is bounded by the segment and the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, Texts, text_chunks

#: A query is a set of alternatives; each is the set of trigrams that must all occur. ALL matches any text.
Query = frozenset
ALL: Query = frozenset({frozenset()})
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the match) must have ``least`` characters at least, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = re.ASCII


#: The base rules, in the order in which kinds are listed, then further well-known token forms.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # an earlier AKIA of the same run makes the longer match
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # matches of [0-9a-f]+ are whole runs
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _grams(strings: Iterable[str]) -> Query:
    """Trigrams (of UTF-8, ASCII letters in lower case) of one of ``strings``."""
    options = set()
    for s in strings:
        b = s.encode().lower()
        options.add(frozenset(b[i : i + 3] for i in range(len(b) - 2)))
    return ALL if frozenset() in options else frozenset(options)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_STRINGS:
        return min(a, b, key=len)  # weaker, but no match is lost
    return frozenset(x | y for x in a for y in b)


def _one_of(parts: Iterable[Query]) -> Query:
    out = frozenset().union(*parts)
    return ALL if frozenset() in out or len(out) > MAX_STRINGS else out


def _walk(items: Iterable) -> tuple[set[str] | None, Query]:
    """The strings that a parsed expression stands for, if few, else the query that its matches meet."""
    strings, query, whole = {""}, ALL, True
    for kind, arg in items:
        found, need = _item(kind, arg)
        if found is not None and len(found) * len(strings) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in found}
            continue
        query = _both(_both(query, _grams(strings)), need if found is None else _grams(found))
        strings, whole = {""}, False
    return (strings, _grams(strings)) if whole else (None, _both(query, _grams(strings)))


def _item(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, ALL
    if kind is op.IN:
        chars = {chr(v) for k, v in arg if k is op.LITERAL}
        return (chars, ALL) if len(chars) == len(arg) <= 8 else (None, ALL)
    if kind is op.SUBPATTERN:
        return _walk(arg[3])
    if kind is op.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MAX_STRINGS:
            return set().union(*(s for s, _ in parts)), ALL
        return None, _one_of(q if s is None else _grams(s) for s, q in parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, query = _walk(body)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ALL
        return None, ALL if not least else query if strings is None else _grams(strings)
    if kind is op.AT:
        return {""}, ALL
    return None, ALL


def trigram_query(rule: Rule) -> Query:
    """The trigrams that a text must hold for ``rule`` to match in it; ALL if there are none."""
    strings, query = _walk(parser.parse(rule.pattern, rule.flags))
    return query if strings is None else _grams(strings)


class Segment:
    """Inverted index of one chunk of documents, for the trigrams that the rules ask for."""

    def __init__(self, texts: Texts, numbers: np.ndarray, n_terms: int):
        data = TO_LOWER[texts.bytes].astype(np.uint32)
        self.texts, self.postings = texts, [np.empty(0, np.int64)] * (n_terms + 1)
        if len(data) < 3:
            return
        term = numbers[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(term)
        doc = np.searchsorted(texts.starts, at, "right") - 1
        at, doc = (x[at + 3 <= texts.ends[doc]] for x in (at, doc))
        pairs = np.unique(term[at].astype(np.int64) * texts.n + doc)
        cuts = np.searchsorted(pairs, np.arange(n_terms + 2) * texts.n)
        self.postings = [pairs[a:b] - t * texts.n for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]

    def candidates(self, query: list[list[int]]) -> np.ndarray:
        if [] in query:
            return np.arange(self.texts.n)
        found = [np.empty(0, np.int64)]
        for terms in query:
            lists = sorted((self.postings[t] for t in terms), key=len)
            docs = lists[0]
            for x in lists[1:]:
                docs = np.intersect1d(docs, x, assume_unique=True) if len(docs) else docs
            found.append(docs)
        return np.unique(np.concatenate(found))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans``, an array of (kind, start, end).

    Positions count code points, ends are exclusive; spans are ordered by start, then by the order of
    ``rules``. Matches of a kind are leftmost and do not overlap; kinds may overlap each other. A null text
    counts as empty. Rows that repeat are each answered; null ids are kept; other columns are not read.
    """
    queries = [trigram_query(r) for r in rules]
    terms = sorted({t for q in queries for option in q for t in option})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(terms):
            numbers[int.from_bytes(t, "big")] = i + 1
        numbered = [[[terms.index(t) + 1 for t in option] for option in q] for q in queries]
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                segment = Segment(texts, numbers, len(terms))
                spans: list[list] = [[] for _ in range(texts.n)]
                kept: dict[int, str] = {}
                for k, (rule, query, regex) in enumerate(zip(rules, numbered, compiled, strict=True)):
                    for d in segment.candidates(query).tolist():
                        text = kept.get(d)
                        if text is None:
                            text = kept[d] = texts.text(d)
                        for m in regex.finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                spans[d].append((m.start(), k, m.end()))
                out = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]
                yield pa.record_batch([batch.column(0).slice(texts.first, texts.n), pa.array(out, _ARROW_SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, spans {SPAN_TYPE}").withColumnRenamed("id", id_col)
