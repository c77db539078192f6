"""License scans: notice phrases and identifier tags by one Aho-Corasick pass, tags' expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Notice phrases and their labels, the base ones first.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MORE = {
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "creative commons": "cc",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
}
TAG = "spdx license identifier"
#: How identifiers begin, and their labels.
IDENTIFIERS = {"mit": "mit", "apache": "apache", "agpl": "gpl", "lgpl": "gpl", "gpl": "gpl", "mpl": "mpl", "bsd": "bsd", "cc": "cc", "epl": "epl", "isc": "isc"}
#: Bytes of a text in UTF-8 to what words are made of: A-Z lower-cased, all other ASCII but letters and digits a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Labels that ask for no more than a notice.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc"})
RANK = {"or": 1, "and": 2, "with": 3}
TAG_LINE = re.compile(r"spdx-license-identifier:([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order (with binds before and, and before or); stops at the first token that can't follow."""
    out, stack, operand = [], [], True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if operand:
            if word == "(":
                stack.append(word)
            elif word in RANK or word == ")":
                break
            else:
                out.append(word)
                operand = False
        elif word in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif word == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    pending = [x for x in reversed(stack) if x != "("]
    return out + (pending[1:] if operand and pending else pending)  # an operator without its right side is left out


@dataclass(frozen=True)
class Terms:
    """What an expression asks for: identifiers that every way to satisfy it has, all that it names, and whether allowed ones satisfy it."""

    required: frozenset[str]
    named: frozenset[str]
    permitted: bool


def evaluate(expression: str, allowed: Callable[[str], bool]) -> Terms | None:
    """The expression's terms, in one pass over its postfix form: or chooses, and joins, with names an exception to its left side."""
    stack: list[Terms] = []
    for token in postfix(expression):
        if token in RANK and len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            elif token == "or":
                stack.append(Terms(left.required & right.required, left.named | right.named, left.permitted or right.permitted))
            else:
                stack.append(Terms(left.required | right.required, left.named | right.named, left.permitted and right.permitted))
        elif token not in RANK:
            own = frozenset([token])
            stack.append(Terms(own, own, allowed(token)))
    return stack[-1] if stack else None


def label_of(identifier: str) -> str:
    """The label of a licence identifier: its family, or else the identifier itself."""
    return next((v for k, v in IDENTIFIERS.items() if identifier == k or identifier.startswith(f"{k}-")), identifier)


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, label in {**BASE, **MORE, TAG: ""}.items():
        out.add_word(f" {phrase} ", (phrase, label))
    out.make_automaton()
    return out


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> dict:
    """n_words, the places (start word, phrase, label) of base and of further phrases, and the tags' expressions of a text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")
    tokens = [x for x in tokens if x]
    line = " " + b" ".join(tokens).decode("latin-1") + " "
    hits, spaces = [], None
    for end, (phrase, label) in machine.iter(line):
        if spaces is None:
            spaces = [m.start() for m in re.finditer(" ", line)]
        hits.append((bisect_right(spaces, end - len(phrase) - 1) - 1, phrase, label))
    tags = [m[1].strip() for m in TAG_LINE.finditer(text)] if any(x[1] == TAG for x in hits) else []
    return {"n_words": len(tokens), "base": [x for x in hits if x[1] in BASE], "more": [x for x in hits if x[1] in MORE], "expressions": tags}


def judged(scan: dict, allowed: frozenset[str]) -> tuple[str, float, bool | None]:
    """The labels, the score and the verdict of a text's scan (see scan_licenses())."""
    terms = [t for e in scan["expressions"] if (t := evaluate(e, lambda x: label_of(x) in allowed))]
    sure = {x[2] for x in scan["base"] + scan["more"]} | {label_of(x) for t in terms for x in t.required}
    maybe = {label_of(x) for t in terms for x in t.named} - sure
    n = len(scan["base"]) + len(scan["more"]) + sum((1 + len(t.required) / len(t.named)) / 2 for t in terms)
    return ",".join(sorted(sure | {f"{x}?" for x in maybe})), n / (n + 1), all(t.permitted for t in terms) if terms else None


def scan_licenses(docs: DataFrame, text: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score, permitted.

    Words are runs of digits, letters and non-ASCII characters of the whole text, A-Z lower-cased. n_base counts all places
    of base phrases; first_word and last_word are their smallest and largest start, null if there are none. labels has the
    base labels, those of further phrases, and those of the tags' expressions: an identifier that every way to satisfy the
    expression has by its label, one that may be chosen with a question mark (a AND b gives a,b and a OR b gives a?,b?); both
    lists are distinct, sorted and comma-joined, empty if there are none. score is n / (n + 1) for n finds, an expression
    counting between a half and 1 by how much of it is required. permitted says whether licences with an allowed label
    satisfy all expressions, null without any. A null or empty text has no words, a very long one is scanned whole. Rows
    with null ids and repeated rows keep their row, an empty table gives an empty result, other columns aren't read.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [scan_text(x, machine) for x in batch.column(1).to_pylist()]
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score", "permitted")}
            for r in rows:
                starts = [x[0] for x in r["base"]]
                labels, score, permitted = judged(r, allowed)
                values = (r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[2] for x in r["base"]})), labels, r["expressions"], score, permitted)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    schema = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double, permitted boolean"
    rows = docs.select("doc_id", text)
    return rows.mapInArrow(scanned, schema.format(rows.schema["doc_id"].dataType.simpleString()))
