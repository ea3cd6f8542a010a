"""Licence scan (operator 3): Aho-Corasick over notice phrases and identifier tags, and a
shunting-yard parser for licence expressions.

A text is taken as its words (lower-cased A-Z; runs of 0-9, a-z and everything that is not
ASCII) with one blank between them; one automaton finds all phrases there, each with a blank
on both sides, so a phrase stands for consecutive whole words.  Where the phrase of the
identifier tag ends, the expression parser reads on: up to the line's end or the next tag, and as
far as an operator follows each complete operand.  ``and`` binds tighter than ``or``, ``with``
tighter than both, parentheses group.  Identifiers are looked up in the same automaton; an expression
that does not parse, or names one that is unknown, gives the label ``unparsed`` when a colon
stands before it, else nothing.

An expression's value is (labels, permissive): the licences it names, and whether some
choice of its ``or`` branches needs permissive licences only.  score is how sure the text
states terms: the largest weight of what was found, 0 when nothing was.

NULL and empty texts have no words, no labels and score 0.  Rows are handled one by one;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import NOT_ALNUM, chunks

# fixed values of the task: phrases whose places are counted, and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: phrases of this operator's own: label and weight
NOTICES = {
    "apache license": ("apache", 0.8), "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "mit license": ("mit", 0.9), "bsd license": ("bsd", 0.9), "isc license": ("isc", 0.9),
    "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.95), "affero general public license": ("agpl", 0.95),
    "general public license version 2": ("gpl-2.0", 0.95), "general public license version 3": ("gpl-3.0", 0.95),
    "cc by nc": ("cc-by-nc", 0.9), "cc by sa": ("cc-by-sa", 0.9), "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8), "public domain": ("public-domain", 0.5), "boost software license": ("bsl", 0.9),
}
BASE_WEIGHT = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.7}
TAG = "spdx license identifier"
# fixed values: licence identifiers and exceptions of the public identifier list, in lower case
IDENTIFIERS = set("""
0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0
artistic-1.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause
bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0
cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0
curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.2-only gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only
gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg ipl-1.0 isc
json lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later
libpng lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01
postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 llvm-exception
linux-syscall-note openssl-exception
""".split())

#: identifiers (lower case) that ask for no more than notices
PERMISSIVE = {"mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "zlib", "unlicense", "cc0-1.0",
              "bsl-1.0", "cc-by-4.0", "cc-by-3.0"}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


class BadExpression(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Operands and operators in postfix order (shunting yard)."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _BINDS:
            if operand_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise BadExpression(expression)
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise BadExpression(expression)
            waiting.pop()
        else:
            if not operand_next:
                raise BadExpression(expression)
            out.append(word)
            operand_next = False
    if operand_next or "(" in waiting:
        raise BadExpression(expression)
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[frozenset[str], bool]:
    """(licences named, whether permissive terms can be chosen).  ``with`` keeps the licence
    on its left and names the exception too; an exception only loosens terms."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in to_postfix(expression):
        if token not in _BINDS:
            stack.append((frozenset([token]), token.rstrip("+") in PERMISSIVE))
            continue
        right, left = stack.pop(), stack.pop()
        free = left[1] if token == "with" else (left[1] and right[1] if token == "and" else left[1] or right[1])
        stack.append((left[0] | right[0], free))
    return stack[0]


def leading(line: str) -> str:
    """The expression that ``line`` begins with: it ends where no operator follows a complete
    operand.  A full stop or hyphens behind an operand (a comment's end) end it as well."""
    depth, end, operand_next = 0, len(line), True
    for token in _TOKEN.finditer(line):
        word = token[0].lower()
        if operand_next:
            if word in _BINDS or word == ")":
                return line
            if word == "(":
                depth += 1
                continue
            name = word.rstrip(".:-")
            if not name:
                return line
            operand_next, end = False, token.start() + len(name)
            if name != word:
                return line[:end]
        elif word in _BINDS:
            operand_next, end = True, len(line)
        elif word == ")" and depth:
            depth, end = depth - 1, token.end()
        else:
            return line[:end]
    return line[:end]


#: words of a text: lower-cased, other characters become blanks
_CLEAN = bytes(0x20 if NOT_ALNUM[b] else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    for name in IDENTIFIERS:                # looked up as a whole; cleaned texts hold no such byte
        found.add_word(f"\x01{name}", name)
    found.make_automaton()
    return found


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tagged(raw: bytes, ends: list[int]) -> Iterator[tuple[str, bool]]:
    """(what follows, whether after a colon) of each tag whose last word is one of ``ends``
    (numbers of words): up to the line's end or the next tag."""
    last = {e: i for i, e in enumerate(sorted(ends))}
    spans = {}
    for k, word in enumerate(_WORD.finditer(raw)):
        if k + len(TAG.split()) - 1 in last:
            spans[last[k + len(TAG.split()) - 1]] = [word.start(), 0]
        if k in last:
            spans[last[k]][1] = word.end()
    for i in range(len(spans)):
        stop = raw.find(b"\n", spans[i][1])
        stop = min(len(raw) if stop < 0 else stop, spans[i + 1][0] if i + 1 in spans else len(raw))
        rest = raw[spans[i][1]:stop].decode("utf-8", "replace").lstrip(" \t")
        yield rest.removeprefix(":").lstrip(" \t"), rest.startswith(":")


def known(name: str, automaton) -> bool:
    return name.startswith(("licenseref-", "documentref-")) or automaton.exists("\x01" + name) or automaton.exists("\x01" + name.rstrip("+"))


def scan(text: str, automaton) -> tuple[int, int, int | None, int | None, str, str, float, bool | None]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_CLEAN).split()
    plain = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, base, labels, score, tags = [], set(), set(), 0.0, []
    for end, phrase in automaton.iter(plain):
        if phrase in BASE:
            places.append(end - len(phrase))
            base.add(BASE[phrase])
            score = max(score, BASE_WEIGHT[BASE[phrase]])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
            score = max(score, NOTICES[phrase][1])
        if phrase == TAG:
            tags.append(end)
    permissive = None
    if tags:
        at, ends = 0, []
        for k, end in enumerate(tags):              # number of the word that ends before ``end``
            at += plain.count(" ", tags[k - 1] if k else 0, end)
            ends.append(at - 1)
        for line, colon in tagged(raw, ends):
            expression = leading(line)
            try:
                named, free = evaluate(expression)
                if not all(known(n, automaton) for n in named):
                    raise BadExpression(expression)
                labels |= named
                permissive = free if permissive is None else permissive and free
                score = 1.0
            except BadExpression:
                if colon:                            # a tag, and not a sentence about tags
                    labels.add("unparsed")
                    score = max(score, 0.6)
    first = last = None
    if places:
        # word index: blanks before the phrase, less the one at the front
        first = plain.count(" ", 0, min(places)) - 1
        last = first + plain.count(" ", min(places), max(places))
    return (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score, permissive)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, permissive boolean")


def licenses(docs: DataFrame) -> DataFrame:
    """One row (``SCHEMA``) per row of ``docs`` (doc_id, text).  permissive: whether all
    identifier expressions leave a permissive choice (NULL without a readable one)."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for piece in chunks(batches):
            rows = [scan(t or "", automaton) for t in piece.column(1).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]
            yield pa.RecordBatch.from_arrays([piece.column(0), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
