"""License scans: Aho-Corasick for tags and notices, a shunting-yard parser for expressions.

A text is lower-cased in A-Z and cut into words; one automaton finds all notice phrases as whole
words in one pass. Where it meets an SPDX tag, the expression after the tag is read from the
text, brought to postfix order by the shunting-yard algorithm and evaluated: ``or`` lets choose
the freer licence, ``and`` binds to both, ``with`` adds an exception to its licence, which stands
among the labels and, if it lets combine or link freely, makes strong copyleft weak.

A licence has one label whether a tag or a notice names it: its family (all GPL versions are gpl,
the lesser and the Affero one have families of their own), or for families that differ in what
they allow its name without the version (cc-by-nc-sa).

Scale: one pass over the rows, no shuffle, in time linear in the text; the automaton is built once
in each Python worker.

Defined cases: a null text counts as empty, has no words and score 0; phrases are found in texts
of any length and overlap freely; of the method's phrases that start at one place the longest
counts, and one inside a longer one doesn't; an expression that isn't well formed gives no labels;
repeated rows get equal results; null doc_ids are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches

#: Phrases of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases that the method adds: words of notices, titles and short names, by label.
NOTICES = {
    "mit": ("permission is hereby granted free of charge to any person", "expat license",
        "the above copyright notice and this permission notice shall be included in all copies"),
    "apache": ("licensed under the apache license", "apache software license", "apache 2 0"),
    "bsd": ("redistribution and use in source and binary forms", "bsd license", "bsd 2 clause", "bsd 3 clause",
        "bsd 4 clause", "new bsd", "simplified bsd", "neither the name of the copyright holder"),
    "gpl": ("gnu gpl", "gplv2", "gplv3", "gnu public license", "free software foundation either version"),
    "lgpl": ("lesser general public license", "library general public license", "gnu lgpl", "lgplv2", "lgplv3"),
    "agpl": ("affero general public license", "gnu agpl", "agplv3"),
    "mpl": ("mozilla public license", "mpl 2 0", "mpl 1 1"),
    "epl": ("eclipse public license", "epl 1 0", "epl 2 0"),
    "cddl": ("common development and distribution license",),
    "cpl": ("common public license",),
    "eupl": ("european union public licence", "european union public license"),
    "isc": ("isc license", "permission to use copy modify and or distribute this software for any purpose"),
    "zlib": ("zlib license", "altered source versions must be plainly marked as such"),
    "bsl": ("boost software license",),
    "busl": ("business source license",),
    "sspl": ("server side public license",),
    "artistic": ("artistic license",),
    "unlicense": ("this is free and unencumbered software released into the public domain", "the unlicense"),
    "wtfpl": ("do what the fuck you want to public license",),
    "python": ("python software foundation license", "psf license agreement"),
    "postgresql": ("postgresql license",),
    "ofl": ("open font license",),
    "gfdl": ("free documentation license",),
    "odbl": ("open database license",),
    "upl": ("universal permissive license",),
    "cc0": ("cc0", "creative commons zero"),
    "cc-by": ("cc by", "creative commons attribution"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial",
        "creative commons attribution non commercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs",
        "creative commons attribution no derivatives"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike",
        "creative commons attribution non commercial share alike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives",
        "creative commons attribution noncommercial noderivs",
        "creative commons attribution non commercial no derivatives"),
    "public-domain": ("released into the public domain", "dedicated to the public domain",
        "placed in the public domain"),
    "all-rights-reserved": ("all rights reserved",),
}
TAG = "spdx license identifier"
#: How sure each kind of evidence makes.
CERTAINTY = {"base": 0.9, "notice": 0.7, "tag": 0.99}
#: Families: identifiers that are the name, or the name and a version or variant after a hyphen.
FAMILIES = (
    "agpl", "lgpl", "gpl", "mit", "apache", "bsd", "mpl", "epl", "isc", "cddl", "cpl", "eupl", "zlib", "bsl", "busl",
    "sspl", "artistic", "unlicense", "wtfpl", "python", "postgresql", "ofl", "gfdl", "odbl", "upl", "cc0",
    "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by",
)
#: Identifiers with another name than their family's.
ALIASES = {"psf-2.0": "python", "cnri-python": "python", "0bsd": "bsd", "expat": "mit", "x11": "mit", "gpl": "gpl"}
#: What using a work asks: 0 that all of the whole is given away alike, 0.5 that its own files are, 1 no more than notices.
STRONG, WEAK = ("gpl", "agpl", "sspl", "eupl", "gfdl", "cc-by-sa", "cc-by-nc-sa", "odbl"), ("lgpl", "mpl", "epl",
    "cddl", "cpl")
#: Words of exceptions that let a work be linked or combined under other terms.
LINKING = ("classpath", "linking", "gcc", "runtime", "bootloader", "bison", "autoconf", "font", "libtool", "openssl",
    "llvm", "swift", "universal-foss")
_RANK = {"or": 1, "and": 2, "with": 3}
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))
_AFTER_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def family(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return ALIASES.get(name) or next((f for f in FAMILIES if name == f or name.startswith(f + "-")), name)


def freedom_of(label: str) -> float:
    return 0.0 if label in STRONG else 0.5 if label in WEAK else 1.0


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the longest well-formed expression the line starts with, in postfix order; None if none."""
    out, stack = [], []
    operand = True  # whether one is due
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            if not operand:
                break  # prose after the expression
            out.append(low)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """(labels named, how free the choice is: 1 if a permissive one suffices, 0 if all bind strongly)."""
    stack: list[tuple[set[str], float, str]] = []
    for token in postfix:
        if token == "with":
            (_, _, exception), (labels, free, name) = stack.pop(), stack.pop()
            freer = max(free, 0.5) if any(w in exception for w in LINKING) else free
            stack.append((labels | {exception}, freer, name))
        elif token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1]), ""))
        else:
            label = family(token)
            stack.append(({label}, freedom_of(label), token))
    return stack[0][:2]


class Scanner:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        phrases = {TAG: ("tag", "")} | {p: ("notice", label) for label, ps in NOTICES.items()
            for p in ps} | {p: ("base", label) for p, label in BASE.items()}
        for phrase, what in phrases.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, *what))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, freedom)."""
        words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
        joined = b" " + b" ".join(words) + b" "
        found = [(end - length + 1, end, kind, label) for end,
            (length, kind, label) in self.automaton.iter(joined.decode("latin-1"))]
        base = [(start, label) for start, _, kind, label in found if kind == "base"]
        labels = {label: CERTAINTY["base"] for _, label in base}
        # of phrases by start, the longest first: one that ends inside an earlier one is part of it
        reach = -1
        for start, end, kind, label in sorted((f for f in found if f[2] == "notice"), key=lambda f: (f[0], -f[1])):
            if end > reach:
                reach = end
                labels[label] = max(labels.get(label, 0), CERTAINTY["notice"])
        freedom = None
        if any(f[2] == "tag" for f in found):
            for line in _AFTER_TAG.findall(text):
                postfix = to_postfix(line)
                if postfix:
                    named, free = evaluate(postfix)
                    labels |= dict.fromkeys(named, CERTAINTY["tag"])
                    freedom = free if freedom is None else min(freedom, free)
        doubt = 1.0
        for _, sure in sorted(labels.items()):
            doubt *= 1 - sure
        # each word follows one blank of the joined text, so a place is the number of blanks before its own
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if base else None
        places = np.searchsorted(blanks, [start for start, _ in base]) if base else []
        first, last = (int(min(places)), int(max(places))) if base else (None, None)
        return len(words), len(base), first, last, ",".join(sorted({b for _,
                    b in base})), ",".join(sorted(labels)), 1 - doubt if labels else 0.0, freedom


_scanner: list[Scanner] = []


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, freedom) for each row of docs.

    freedom: of the tags' expressions, 1 if a permissive licence can be chosen, 0 if only
    strong copyleft can; null without a tag.
    """
    bounded_batches(docs.sparkSession)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "freedom"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            rows = [_scanner[0].scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0),
                    *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["doc_id", *names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
