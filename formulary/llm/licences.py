"""Licence scans: an Aho-Corasick pass finds notice phrases and identifier tags, and the licence
expressions after a tag are read by a shunting-yard parser and evaluated against a policy."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}  # A-Z only

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases beyond the base ones, in words as WORD finds them.
NOTICE_PHRASES = {
    "licensed under the mit": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "all rights reserved": "proprietary",
}

# A tag, behind it a mark, and then, up to the end of the line, a licence expression.
TAGS = ("spdx license identifier", "license expression")
MARK = re.compile(r"[ \t\"']*[:=][ \t\"']*")
REFERENCES = ("licenseref-", "documentref-")  # names that a document gives licences of its own

# First words of an identifier and the label it stands for; the longest that fits is taken.
FAMILIES = {
    "mit": "mit",
    "apache": "apache",
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "bsd": "bsd",
    "isc": "isc",
    "mpl": "mpl",
    "epl": "epl",
    "bsl": "bsl",
    "cc0": "cc0",
    "cc-by": "cc-by",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nc-sa": "cc-by-nc-sa",
    "cc-by-nc-nd": "cc-by-nc-nd",
    "unlicense": "unlicense",
}

# How freely text under a label may be used, 1 freely to 0 not at all.
FREEDOM = {
    "mit": 1.0,
    "apache": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "bsl": 1.0,
    "cc0": 1.0,
    "unlicense": 1.0,
    "public-domain": 1.0,
    "cc-by": 0.9,
    "mpl": 0.6,
    "epl": 0.6,
    "lgpl": 0.5,
    "cc": 0.5,
    "cc-by-sa": 0.4,
    "gpl": 0.3,
    "agpl": 0.2,
    "cc-by-nd": 0.2,
    "cc-by-nc": 0.1,
    "cc-by-nc-sa": 0.1,
    "cc-by-nc-nd": 0.1,
    "proprietary": 0.0,
}
UNKNOWN = 0.5  # a licence that is named but not known here
EXCEPTION = 0.1  # what an exception adds to the licence it loosens

TOKEN = re.compile(r"[ \t\r]*([()]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
RANK = {"or": 1, "and": 2, "with": 3}


def _tokens(text: str, start: int, stop: int) -> Iterator[tuple[str, int]]:
    """(token in lower case, its end) one after the other, as long as nothing but spaces stands between them."""
    while (m := TOKEN.match(text, start, stop)) is not None:
        start = m.end()
        yield m[1].lower(), start


def postfix(text: str) -> list[str]:
    """The licence expression at the beginning of `text`, any names, in postfix order."""
    return expression(text, 0, len(text), lambda _: True)[0]


def expression(text: str, start: int, stop: int, named: Callable[[str], bool]) -> tuple[list[str], int]:
    """(operands and operators of the expression at `start` in postfix order, by two stacks; where it ends).

    `with` binds closest, then `and`, then `or`; letter case does not count. Operands are names that `named`
    holds for. Reading stops where the text stops being an expression, at `stop` at the latest. An operator left
    without a second operand is dropped. Never fails: no operand, no output.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next, depth, end = True, 0, start
    ahead: deque[tuple[str, int]] = deque()
    tokens = _tokens(text, start, len(text) if stop is None else stop)

    def following() -> str | None:
        """The next token that is no opening bracket; what is looked at stays to be read."""
        for token, _ in ahead:
            if token != "(":
                return token
        for token, at in tokens:
            ahead.append((token, at))
            if token != "(":
                return token
        return None

    while True:
        token, at = ahead.popleft() if ahead else next(tokens, ("", 0))
        if token == "(":
            if not operand_next:
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif token in RANK:
            if operand_next or (after := following()) is None or after in RANK or after == ")" or not named(after):
                break
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token and operand_next and named(token):
            out.append(token)
            operand_next = False
        else:
            break
        end = at
    while waiting:
        if (top := waiting.pop()) != "(":
            out.append(top)
    return (out if _complete(out) else [t for t in out if t not in RANK][:1]), end


def licence_like(name: str) -> bool:
    """Whether a name is a licence's: of a family known here, a reference, or with a version or an exception."""
    if label_of(name) in FAMILIES.values() or name.startswith(REFERENCES):
        return True
    return "-" in name and any(c.isdigit() for c in name) or name.endswith("-exception")


def _complete(tokens: list[str]) -> bool:
    height = 0
    for token in tokens:
        height += -1 if token in RANK else 1
        if height < 1:
            return False
    return height == 1


def label_of(identifier: str) -> str:
    """The label of a licence identifier such as `Apache-2.0`; one that is not known stands for itself."""
    name = identifier.lower().rstrip("+.-")
    parts = name.split("-")
    for size in range(len(parts), 0, -1):
        if (head := "-".join(parts[:size])) in FAMILIES:
            return FAMILIES[head]
    return name


def evaluate(tokens: list[str]) -> tuple[set[str], float | None]:
    """Labels and freedom of a postfix expression: `or` takes the freer side, `and` the stricter one."""
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token not in RANK:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
            continue
        (right, free_r), (left, free_l) = stack.pop(), stack.pop()
        if token == "with":  # the exception names no licence
            stack.append((left, min(1.0, free_l + EXCEPTION)))
        else:
            stack.append((left | right, max(free_l, free_r) if token == "or" else min(free_l, free_r)))
    return stack.pop() if stack else (set(), None)


def automaton(base: dict[str, str], more: dict[str, str], tags: Iterable[str]) -> ahocorasick.Automaton:
    """All phrases, each between spaces: (kind, label, length in words)."""
    found = ahocorasick.Automaton()
    for kind, phrases in (("tag", dict.fromkeys(tags, "")), ("more", more), ("base", base)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase.split(" "))))
    found.make_automaton()
    return found


def scan(text: str | None, phrases: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, expressions) of one whole text.

    score is 1 without any licence, else the freedom of the strictest one found.
    """
    lowered = (text or "").translate(LOWER)
    words = WORD.findall(lowered)
    line = f" {' '.join(words)} "
    base, labels, freedom, expressions = set(), set(), [], []
    n_base, first, last = 0, None, None
    counted, at = 0, 0  # spaces seen up to a place of the line
    read = 0  # end of the last expression
    ends: list[int] | None = None
    for end, (kind, label, size) in phrases.iter(line):
        counted += line.count(" ", at, end + 1)
        at = end + 1
        word = counted - 1 - size
        if kind == "base":
            n_base += 1
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
            base.add(label)
        if kind != "tag":
            labels.add(label)
            freedom.append(FREEDOM.get(label, UNKNOWN))
            continue
        if ends is None:
            ends = [m.end() for m in WORD.finditer(lowered)]
        mark = MARK.match(lowered, ends[word + size - 1])
        if mark is None or mark.end() < read:  # prose, or inside an expression that has been read
            continue
        stop = lowered.find("\n", mark.end())
        tokens, read = expression(lowered, mark.end(), len(lowered) if stop < 0 else stop, licence_like)
        named, free = evaluate(tokens)
        if free is not None:
            labels |= named
            freedom.append(free)
            expressions.append(" ".join(tokens))
    return (
        len(words),
        n_base,
        first,
        last,
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        min(freedom, default=1.0),
        expressions,
    )


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"]
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double, expressions array<string>"
)
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]


def licence_scan(
    docs: DataFrame,
    base: dict[str, str] = BASE_PHRASES,
    more: dict[str, str] = NOTICE_PHRASES,
    tags: Iterable[str] = TAGS,
) -> DataFrame:
    """One row per row of `docs`: words, places of base phrases, labels, score and expressions in postfix order.

    A tag counts with `:` or `=` behind it, and then names of a family known here, with a version or exception, or
    LicenseRef- names: prose about licences gives no labels of its own words. Whole texts, no shuffle. A null text counts as an empty one: no words, no labels, score 1. Repeated rows
    and null ids stay; further columns are left out. labels holds base_labels too; tags and notices only add.
    """

    def scanner() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = automaton(base, more, tags)
            for batch in batches:
                found = [scan(t.as_py(), phrases) for t in batch.column("text")]
                columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(TYPES)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *COLUMNS])

        return run

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scanner(), SCHEMA)
