"""Personal data, with disguises undone and spans mapped back to the source.

The plain patterns are found in the text as it is. Then a chain of transducers
rewrites disguises - homoglyphs and full-width forms, digits spelled as words,
and at/dot written out - into a normalised text that keeps, for every rewritten
segment, where it came from. The same patterns run on the normalised text and
each match is mapped back to code points of the source.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # an "@" is in no local part, so the leftmost match of each "@" starts where the run before it does
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            pos = found.end()
        else:
            pos = max(pos, at + 1)
        at = text.find("@", pos)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass their check, by start and then kind."""
    out: list[Span] = [(s, e, "email") for s, e in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


# Look-alikes of ASCII letters, digits and signs, as (look-alikes, what they stand for): fixed values.
_LOOKALIKES = (
    ("аеорсухіјѕһԁԛԝ", "aeopcyxijshdqw"),
    ("АВЕКМНОРСТУХІЈЅ", "ABEKMHOPCTYXIJS"),
    ("οανικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavikptuABEZHIKMNOPTYX"),
    ("＠．＋－（）﹫․。∙·‐‑‒–—−", "@.+-()@...." + "------"),
)
_FOLD: dict[str, str] = {a: b for src, dst in _LOOKALIKES for a, b in zip(src, dst, strict=False)}
_FOLD |= {chr(0xFF10 + i): chr(48 + i) for i in range(10)}
_FOLD |= {chr(0xFF21 + i): chr(65 + i) for i in range(26)}
_FOLD |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_FOLD |= {chr(base + i): chr(48 + i) for base in (0x0660, 0x06F0, 0x0966) for i in range(10)}
_INVISIBLE = "​‌‍⁠﻿­"
_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_GLYPHS = re.compile("[" + re.escape("".join(_FOLD) + _INVISIBLE) + "]")
_OPEN, _CLOSE = r"(?<![ \t\[({<])[ \t]*+[\[({<]++[ \t]*+", r"[ \t]*+[\])}>]++[ \t]*+"
_AT = rf"{_OPEN}(?:at|AT|At|@){_CLOSE}"
_DOT = rf"{_OPEN}(?:dot|DOT|Dot|\.){_CLOSE}"
_BRACKETED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})")
#: A sign between a local part and a host: spoken, or plain.
_SAID_AT = re.compile(r"[ \t](?:at|AT|At)[ \t]|@")
_SAID_DOT = re.compile(r"[ \t](?:dot|DOT|Dot)[ \t]")
#: What follows a host's label: another label behind a spoken or a plain dot.
_NEXT_LABEL = re.compile(r"(?:[ \t](?:dot|DOT|Dot)[ \t]|\.)([A-Za-z0-9-]++)")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
#: What may end a spoken address, words that a spoken local part is not, and words that announce an address: fixed values.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv xyz online site shop uk us ca au nz ie in de fr es it nl be ch at se no dk fi pl cz pt br mx jp cn kr ru eu".split())
#: Endings that are words of prose, too.
_WORD_ENDINGS = frozenset("it in me us at be no".split())
#: Figures, versions and scores, which come before "at" in prose.
_FIGURE = re.compile(r"[A-Za-z]?[0-9][0-9.,%+-]*[A-Za-z]{0,2}")
_PROSE = frozenset("a an the this that my our your his her their its it is are was were be been look looked looks looking meet met meets meeting arrive arrived arrives stay stayed stop stopped start started starts open opens closed work works worked working live lives lived living here there home not now only best worst aim aimed good more news available find found visit shop buy read see seen join joined held and or up down us me him them all sold based".split())
_CUE = re.compile(r"(?i)(?:e-?mail|mailto|mail|contact|write|reach|address|ping|forward|send|cc|message)[a-z]*[ \t:]+(?:(?:to|me|us|him|her|them|is|at|on|via|now|of)[ \t:]+){0,3}$")
_DIGIT_WORD = "(?:" + "|".join(_WORDS) + ")"
_SPELLED = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus[ -]+)?(?:{_DIGIT_WORD}|[0-9]+)(?:(?:[ ]point[ ]|[ ]dot[ ]|[ ,.-]+)(?:{_DIGIT_WORD}|[0-9]+))+(?![A-Za-z])")
_SPELLED_PART = re.compile(rf"(?i)(?P<plus>plus[ -]+)|(?P<word>{_DIGIT_WORD})|(?P<point>[ ](?:point|dot)[ ])|(?P<gap>[ ,.-]+)")
_HAS_DIGIT_WORD = re.compile(r"(?i)\b" + _DIGIT_WORD + r"\b")
_POINT_WORD = re.compile(r"(?i)[ ](?:point|dot)(?=[ ])")
_MAY_HAVE_SIGNS = re.compile(rf"[ \t](?:dot|DOT|Dot|at|AT|At)[ \t]|{_OPEN}(?:at|AT|At|@|dot|DOT|Dot|\.)")
#: Runs of spelled digits with fewer digit words than this, and fewer than three spelled points, are prose and stay as they are.
LEAST_SPELLED = 4

Edit = tuple[int, int, str]


class Rewrite:
    """A text after edits, with the place of each of its characters in the text before."""

    def __init__(self, text: str, edits: list[Edit]):
        parts: list[str] = []
        self._new: list[int] = []  # start of each segment in the new text
        self._old: list[tuple[int, int, bool]] = []  # its start and end before, and whether it was copied
        at = size = 0
        for s, e, new in [*edits, (len(text), len(text), "")]:
            for lo, hi, piece, copied in ((at, s, text[at:s], True), (s, e, new, False)):
                if lo < hi or piece:
                    parts.append(piece)
                    self._new.append(size)
                    self._old.append((lo, hi, copied))
                    size += len(piece)
            at = e
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span before that [start, end) of the new text came from; a rewritten segment counts whole."""
        i, j = bisect_right(self._new, start) - 1, bisect_right(self._new, end - 1) - 1
        lo, _, copied = self._old[i]
        first = lo + (start - self._new[i] if copied else 0)
        lo, hi, copied = self._old[j]
        return first, lo + (end - self._new[j]) if copied else hi


def fold_glyphs(text: str) -> list[Edit]:
    return [(m.start(), m.end(), _FOLD.get(m.group(), "")) for m in _GLYPHS.finditer(text)]


def _local_start(text: str, at: int, least: int) -> int:
    """Where the local part that ends at ``at`` begins: words joined by plain or spoken dots."""
    start = at
    while True:
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if start == at or start - 5 <= least or not _SAID_DOT.match(text, start - 5) or text[start - 6] not in _LOCAL:
            return start
        start -= 5


def _spoken(text: str) -> Iterator[list[Edit]]:
    """The edits of each address with a spoken sign.

    Each sign for "at" is followed to both sides, up to the one before, so the
    work is linear. The last label must be a known ending if it is behind a
    spoken dot. More is asked where prose looks alike: after a spoken "at" the
    host has no article and the local part is no common word; where every dot is
    plain (``more at example.com``) the local part has a letter, and a digit or
    an inner sign, and is no figure such as a version or a price; or a word such
    as "mail" comes before. One spoken dot before an ending that is an English
    word (``sat at table dot it``) asks for the like.
    """
    least = 0
    for m in _SAID_AT.finditer(text):
        plain_at = m.group() == "@"
        first = _LABEL.match(text, m.end())
        start = _local_start(text, m.start(), least)
        least = m.end()
        if not first or start == m.start():
            continue
        end, said, upto, ending = first.end(), 0, 0, ""
        dots: list[Edit] = []
        while n := _NEXT_LABEL.match(text, end):
            if spoken := n.start(1) - n.start() > 1:
                dots.append((n.start(), n.start(1), "."))
            end = n.end()
            if not spoken or n.group(1).lower() in _ENDINGS:
                said, upto, ending = len(dots), end, n.group(1).lower()
        dots = dots[:said]
        local = text[start : m.start()]
        if not upto or (plain_at and not dots):
            continue
        if not plain_at:
            words = _SAID_DOT.split(local)
            if first.group().lower() in ("the", "a", "an", "this", "that", "my", "our") or (len(words) == 1 and local.lower() in _PROSE):
                continue
            telling = len(words) > 1 or any(not c.isalpha() for c in local.strip("."))
            cued = bool(_CUE.search(text, max(0, start - 40), start))
            if not dots and (not any(c.isalpha() for c in local) or not (cued or (telling and not _FIGURE.fullmatch(local)))):
                continue
            if len(dots) == 1 and ending in _WORD_ENDINGS and not telling and not cued:
                continue
        edits = [(k.start(), k.end(), ".") for k in _SAID_DOT.finditer(text, start, m.start())]
        yield [*edits, *([] if plain_at else [(m.start(), m.end(), "@")]), *dots]


def undo_signs(text: str) -> list[Edit]:
    """Edits for bracketed at/dot, and for addresses with a spoken sign (``name at host dot tld``, ``name@host dot tld``)."""
    edits = [(m.start(), m.end(), "@" if m.lastgroup == "at" else ".") for m in _BRACKETED.finditer(text)]
    for address in _spoken(text):
        edits += address
    edits.sort()
    out: list[Edit] = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def spell_digits(text: str) -> list[Edit]:
    """Edits that turn runs of spelled digits into figures without gaps."""
    edits: list[Edit] = []
    for m in _SPELLED.finditer(text):
        if len(_HAS_DIGIT_WORD.findall(m.group())) < LEAST_SPELLED and len(_POINT_WORD.findall(m.group())) < 3:
            continue
        for k in _SPELLED_PART.finditer(text, m.start(), m.end()):
            if k["plus"]:
                new = "+"
            elif k["word"]:
                new = _WORDS[k["word"].lower()]
            else:
                new = "." if k["point"] or "." in k["gap"] else ""
            edits.append((k.start(), k.end(), new))
    return edits


def _widens(text: str, s: int, e: int, kind: str, base: list[Span]) -> bool:
    """Whether a span adds disguised letters or digits to the base spans of its kind that it meets, and meets no other.

    A look-alike of a dash or a dot behind an address is punctuation, and adds nothing.
    """
    met = [x for x in base if x[0] < e and s < x[1]]
    if any(x[2] != kind or not (s <= x[0] and x[1] <= e) for x in met):
        return False
    added = "".join(text[i] for i in range(s, e) if not any(x[0] <= i < x[1] for x in met)) if met else ""
    odd = [c for c in added if not c.isascii()]
    return not met or (bool(odd) and all(c.isalnum() or c in _INVISIBLE for c in odd))


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and undisguised spans), each by start and then kind.

    An undisguised span is added where it overlaps no base span, and where it
    holds base spans of its kind whole and widens them by look-alikes of letters
    or digits (as in an address of which a plain pattern sees the end only).
    """
    if not text:
        return [], []
    base = base_spans(text)
    steps: list[Rewrite] = []
    now = text
    if not now.isascii() and (edits := fold_glyphs(now)):
        steps.append(Rewrite(now, edits))
        now = steps[-1].text
    if (_MAY_HAVE_SIGNS.search(now)) and (edits := undo_signs(now)):
        steps.append(Rewrite(now, edits))
        now = steps[-1].text
    if (_HAS_DIGIT_WORD.search(now) or _POINT_WORD.search(now)) and (edits := spell_digits(now)):
        steps.append(Rewrite(now, edits))
        now = steps[-1].text
    if not steps:
        return base, base
    out, have = list(base), set(base)
    for s, e, kind in base_spans(now):
        for step in reversed(steps):
            s, e = step.source(s, e)
        if (s, e, kind) not in have and _widens(text, s, e, kind, base):
            out.append((s, e, kind))
    out.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return base, out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_base bigint"


def _digest(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    cols: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_base")}
    for text in texts:
        base, spans = all_spans(text)
        for k in KINDS:
            cols[f"n_{k}"].append(sum(x[2] == k for x in spans))
        cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        cols["spans"].append(_joined(spans))
        cols["n_base"].append(len(base))
    arrays = [ids] + [pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in cols.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *cols])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each row's whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (all spans of the kind),
    base_sha256 (the plain matches), spans (all, ``kind:start:end`` in code
    points of the source), n_base. A null or empty text has no spans; each
    repeated row gets its own result; an empty table gives an empty result; a
    null id is kept; extra columns are not read. Work is linear in the text, row
    by row, with no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield _digest(part.column(0), part.column(1).to_pylist())

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, value (as written in the source), disguised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, spans = all_spans(text)
                rows += [(i, k, s, e, text[s:e], (s, e, k) not in base) for s, e, k in spans]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "kind", "start", "end", "value", "disguised"])

    schema = "doc_id bigint, kind string, start bigint, end bigint, value string, disguised boolean"
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
