"""Licence scan: Aho-Corasick finds identifier tags and notice phrases; shunting-yard reads licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import only

# The phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices that the operator knows beside them (words as the word rule gives them), and their labels.
NOTICES = {
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons": "cc",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
# The families that identifiers are of, each the head of its identifiers, by what the licence lets one do.
FREE = "mit apache agpl lgpl gpl mpl bsd isc epl eupl cddl bsl cc0 cc-by-sa cc-by unlicense zlib artistic ofl wtfpl python postgresql 0bsd".split()
RESTRICTED = "cc-by-nc cc-by-nd busl sspl elastic polyform proprietary".split()
RESTRICTIVE = frozenset(RESTRICTED)
# the longest family first, and no letter after it (but for a version, as in gplv3)
_FAMILY = re.compile(rf"({'|'.join(sorted(FREE + RESTRICTED, key=len, reverse=True))})(?=[-.+_]|v?[0-9]|\Z)")
_CLOSED = re.compile(r"proprietary|commercial|confidential|internal")

_OTHER = bytes(c if c >= 0x80 or chr(c).isascii() and chr(c).isalnum() else 0x20 for c in range(256))
# bytes outside of [^\x00-\x2F\x3A-\x60\x7B-\x7F] become spaces, after A-Z have become a-z
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in _OTHER)


def expression(tokens: Iterable[str]) -> tuple[list, int]:
    """The longest licence expression at the start of tokens, in postfix order, and how many tokens it takes.

    WITH binds tighter than AND, and AND tighter than OR; all are binary and group to the left. Where parentheses
    don't match or an operand is missing, the expression ends before that.
    """
    power = {"or": 1, "and": 2, "with": 3}
    best: tuple[int, list, int] = (0, [], 0)  # how much of out, what follows it, and tokens
    out: list = []
    stack: list = []
    operand = True  # whether one is expected next
    for i, t in enumerate(tokens):
        low = t.lower()
        if t == "(":
            if not operand:
                break
            stack.append(t)
        elif t == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in power:
            if operand:
                break
            while stack and stack[-1] != "(" and power[stack[-1]] >= power[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
            continue
        else:
            if not operand or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.+-]*", t):
                break
            out.append(t)
            operand = False
        if not operand and "(" not in stack:
            best = (len(out), stack[::-1], i + 1)
    return out[: best[0]] + best[1], best[2]


def permitted(postfix: list, allowed) -> bool:
    """Whether the expression can be met: an or needs one side, an and both; an exception (with) keeps its licence's."""
    stack: list[bool] = []
    for t in postfix:
        if t in ("or", "and", "with"):
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "or" else a and b if t == "and" else a)
        else:
            stack.append(bool(allowed(t)))
    return stack[0] if stack else False


def family(identifier: str) -> str:
    """The family of an identifier; one that no family has is its own. LicenseRef- names count as proprietary where
    they say so."""
    low = identifier.lower()
    if low.startswith("licenseref-") and _CLOSED.search(low):
        return "proprietary"
    m = _FAMILY.match(low)
    return m[1] if m else low


_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*", re.IGNORECASE)
_LINE_END = re.compile(r"[\r\n]|\Z")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+|[^\s]")


class Scanner:
    def __init__(self):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for phrase, label in (BASE | NOTICES | {TAG: ""}).items():
            self.tree.add_word(f" {phrase} ", (phrase, label))
        self.tree.make_automaton()

    def scan(self, text: str) -> dict:
        """Everything found in a text: base places, labels, and the licence expressions of identifier tags."""
        flat = text.encode().translate(_LOWER)
        found = flat.split()  # only spaces are left of white space
        line = " " + b" ".join(found).decode() + " "
        places, base, labels, tag, notices = [], set(), set(), False, []
        # the automaton reports matches that overlap, also at a shared space
        for end, (phrase, label) in self.tree.iter(line):
            if phrase in BASE:
                places.append(end - len(phrase) - 1)
                base.add(label)
            elif phrase == TAG:
                tag = True
            else:
                # a notice counts for those that lie within it; ends never fall here
                begin = end - len(phrase)
                while notices and notices[-1][0] >= begin:
                    notices.pop()
                if not notices or notices[-1][1] < end:
                    notices.append((begin, end, label))
        labels |= {label for _, _, label in notices}
        expressions = []
        if tag:
            stop = -1
            for m in _SPDX.finditer(text):
                if stop < m.end():
                    stop = _LINE_END.search(text, m.end()).start()
                # tokens are read as far as the expression goes, at most to the end of the line
                postfix, n = expression(t[0] for t in _TOKEN.finditer(text, m.end(), stop))
                if n:
                    postfix[:] = [t.rstrip(".") if t not in ("or", "and", "with") else t for t in postfix]
                    expressions.append(postfix)
                    exceptions = {postfix[i - 1] for i, t in enumerate(postfix) if t == "with"}
                    labels |= {family(t) for t in postfix if t not in ("or", "and", "with") and t not in exceptions}
        starts = _starts(line, sorted(places))
        every = base | labels
        free = {x for x in every if x not in RESTRICTIVE}
        if expressions:
            good = sum(permitted(e, lambda t: family(t) not in RESTRICTIVE) for e in expressions) / len(expressions)
            score = 0.5 + 0.5 * good if not (every & RESTRICTIVE) else 0.5 * good
        else:
            score = len(free) / len(every) if every else 0.0
        return {"n_words": len(found), "starts": starts, "base": sorted(base), "labels": sorted(every), "expressions": expressions, "score": score}


def _starts(line: str, places: list[int]) -> list[int]:
    """The number of words before each of rising places in line."""
    out, at, n = [], 0, 0
    for p in places:
        n += line.count(" ", at, p + 1)
        at = p + 1
        out.append(n - 1)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def _scan(batches):
    scanner = Scanner()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            r = scanner.scan(text or "")
            s = r["starts"]
            rows.append((doc, r["n_words"], len(s), s[0] if s else None, s[-1] if s else None, ",".join(r["base"]), ",".join(r["labels"]), r["score"], "; ".join(" ".join(e) for e in r["expressions"])))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in SCHEMA.split(", ")])


def licences(docs: DataFrame) -> DataFrame:
    """What every row of docs (doc_id, text) says of its licence.

    A notice within a longer one gives no label of its own. n_base counts all places of the base phrases, first_word and last_word are their smallest and largest start in
    words from 0 (else null). labels are those of base phrases, other notices and identifier tags, score is the share
    of them that lets the text be used (0 without any), expressions holds the tags' expressions in postfix order.
    Null texts count as empty, repeated rows stay, other columns are ignored.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_scan, SCHEMA)
