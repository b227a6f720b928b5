"""Span arithmetic on text columns, JVM-side.

A span is struct<start:int,end:int,kind:string,priority:int> with an exclusive
end, counted in characters.  ``split`` and ``regexp_extract_all`` of the same
pattern alternate gaps and hits, so starts are running sums of lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import WHITESPACE, let, strip

SPANS = "array<struct<start:int,end:int,kind:string,priority:int>>"


@dataclass(frozen=True)
class Detector:
    """A pattern row: which part of a match is the entity, and how it ranks.

    ``groups`` lists (group number, anchor): the entity is the first non-empty
    group, lying at the ``start`` or the ``end`` of the match.  Empty means the
    whole match.
    """

    name: str
    pattern: str
    priority: int
    groups: tuple[tuple[int, str], ...] = ()
    digits: bool = False  # no match without a digit
    lead: int | None = None  # most characters of a match before its first digit
    marks: tuple[str, ...] = ()  # no match without one of these literals
    needs: str = ""  # no match without a hit of this pattern from the first digit on
    solid: bool = False  # no match holds a space, so it lies in the word that holds the mark


# Entity patterns and ranks.  (?U) gives \w, \d, \s and \b their
# Unicode meaning.
DETECTORS: dict[str, Detector] = {
    d.name: d
    for d in (
        Detector("email", r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", 100, marks=("@",),
                 solid=True),
        Detector("ni_number", r"(?U)\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 95,
                 digits=True, lead=3),
        Detector("uk_postcode", r"(?iU)\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b", 90, digits=True,
                 lead=2),
        Detector(
            "date_of_birth",
            r"(?iU)\b(?:d\.?o\.?b\.?|date of birth|born)\b[:\s]*"
            r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}\s+\w+\s+\d{4})",
            88,
            ((1, "end"),),
            digits=True,
            needs=r"(?U)\d[/\-.]\d|\d\s+\w+\s+\d",
        ),
        Detector(
            "url",
            r"(?U)\b(?:https?://|www\.)[^\s<>\"']+"
            r"|\b(?:[\w-]+\.)+(?:com|org|net|ac\.uk|co\.uk|io|gov\.uk)\b(?:/[^\s<>\"']*)?",
            80,
            marks=("://", "www.", ".com", ".org", ".net", ".uk", ".io"),
            solid=True,
        ),
        Detector("uk_phone", r"(?U)(?:\+44\s?|\b0)(?:\d\s?){9,10}\b", 75, digits=True,
                 lead=1),
        Detector(
            "person_name",
            r"(?U)\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof(?:essor)?|Sir|Dame)\.?\s+"
            r"[A-Z][a-z'\-]+(?:\s+[A-Z][a-z'\-]+){0,2}",
            70,
            marks=("Mr", "Ms", "Miss", "Mx", "Dr", "Prof", "Sir", "Dame"),
        ),
        Detector("company_number", r"(?U)\b(?:[A-Z]{2}\d{6}|\d{8})\b", 60, digits=True,
                 lead=2),
        Detector(
            "money",
            r"(?iU)£\s?(\d[\d,]*(?:\.\d{2})?)|\b(\d[\d,]*(?:\.\d{2})?)\s?(?:GBP|pounds)\b",
            50,
            ((1, "end"), (2, "start")),
            digits=True,
            lead=2,
        ),
    )
}

# What stands in for an entity of each kind.
TOKEN_NAMES = {
    "person_name": "PERSON",
    "email": "EMAIL",
    "uk_phone": "PHONE",
    "uk_postcode": "POSTCODE",
    "company_number": "COMPANY_NO",
    "ni_number": "NINO",
    "url": "URL",
    "date_of_birth": "DOB",
}
AMOUNT_TOKEN = "[AMOUNT]"

# Shapes that must not be left in text about to leave the cluster.
RESIDUAL_PATTERNS = (
    r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"(?U)\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
    r"(?U)(?:\+44\s?|\b0)(?:\d\s?){9,10}\b",
)

GAZETTEER_PRIORITY = 200


def no_spans() -> Column:
    return F.array().cast(SPANS)


def from_word(text: Column, at: Column) -> Column:
    """A text from the start of the word that holds its character ``at`` (0 is the first), and how much is left out.

    The cut is behind a space, so a pattern finds the same boundaries in the rest as in the whole text.
    """
    head = F.substring(text, F.lit(1), at)
    cut = F.length(head) - F.length(F.substring_index(head, " ", -1))
    return let(cut, lambda c: F.struct(c.alias("cut"), F.substring(text, c + 1, F.length(text)).alias("rest")))


def pattern_spans(
    text: Column,
    pattern: Column | str,
    kind: str,
    priority: int,
    groups: Sequence[tuple[int, str]] = (),
    left_out: Column | None = None,
) -> Column:
    """The spans of one pattern in one text, or in the rest of one of which ``left_out`` characters are cut off.

    Groups are read in the hit, so nothing in a pattern may look beyond its match, but for a boundary at its ends.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def locate(hits: Column) -> Column:
        gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
        rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))

        def part_of(row: Column, begin: Column, stop: Column) -> tuple[Column, Column]:
            left, right = begin, stop
            for group, anchor in reversed(groups):
                size = F.length(F.regexp_extract(row["hit"], pattern, group))
                here = size > 0
                a = (stop - size) if anchor == "end" else begin
                b = stop if anchor == "end" else (begin + size)
                left, right = F.when(here, a).otherwise(left), F.when(here, b).otherwise(right)
            return left, right

        def step(acc: Column, row: Column) -> Column:
            begin = acc["at"] + row["gap"]
            stop = begin + F.length(row["hit"])
            left, right = part_of(row, begin, stop)
            span = F.struct(
                left.cast("int").alias("start"), right.cast("int").alias("end"),
                F.lit(kind).alias("kind"), F.lit(priority).alias("priority"),
            )
            return F.struct(
                stop.cast("int").alias("at"),
                F.concat(acc["out"], F.array(span).cast(SPANS)).alias("out"),
            )

        first = F.lit(0) if left_out is None else left_out.cast("int")
        start = F.struct(first.alias("at"), no_spans().alias("out"))
        found = F.slice(rows, F.lit(1), F.size(hits))
        return F.aggregate(found, start, step, lambda acc: acc["out"])

    return let(
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, no_spans()).otherwise(locate(hits)),
    )


def detector_spans(text: Column, names: Sequence[str]) -> Column:
    """All spans of the enabled detectors; unknown names are ignored.

    A pattern runs on the part of a text that can hold a match: not before the
    word of the first mark, or of the first digit less the pattern's lead.
    """
    known = [DETECTORS[n] for n in names if n in DETECTORS]
    if not known:
        return no_spans()

    def spans_of(d: Detector, part: Column, left_out: Column | None = None) -> Column:
        return pattern_spans(part, d.pattern, d.name, d.priority, d.groups, left_out)

    def beside_mark(d: Detector) -> Column:
        at = F.least(F.lit(None).cast("int"), *[F.nullif(F.instr(text, F.lit(m)), F.lit(0)) for m in d.marks])
        return let(at, lambda a: F.when(a.isNull(), no_spans()).otherwise(
            let(from_word(text, a - 1), lambda w: spans_of(d, w["rest"], w["cut"]))
        ))

    def with_mark(d: Detector) -> Column:
        possible = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in d.marks])
        return F.when(possible, spans_of(d, text)).otherwise(no_spans())

    def beside_digits(word: Column) -> Column:
        """``word``: the part of the text that holds all digits and the patterns' leads."""
        parts = []
        for d in with_digits:
            spans = spans_of(d, text) if d.lead is None else spans_of(d, word["rest"], word["cut"])
            if d.needs:
                spans = F.when(F.regexp_like(word["rest"], F.lit(d.needs)), spans).otherwise(no_spans())
            parts.append(spans)
        return F.concat(*parts)

    def run_digits(before: Column) -> Column:
        """``before``: the number of characters before the first digit."""
        at = F.greatest(before - max(d.lead or 0 for d in with_digits), F.lit(0))
        found = let(from_word(text, at), beside_digits)
        return F.when(before < F.length(text), found).otherwise(no_spans())

    with_digits = [d for d in known if d.digits]
    parts = [
        beside_mark(d) if d.solid else with_mark(d) if d.marks else spans_of(d, text)
        for d in known if not d.digits
    ]
    if with_digits:
        parts.append(let(F.length(F.regexp_extract(text, r"^\P{Nd}*+", 0)), run_digits))
    return F.concat(*parts)


def quote(term: Column) -> Column:
    r"""A term as a literal inside a Java pattern (``\E`` inside it is kept)."""
    safe = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), safe, F.lit("\\E"))


def gazetteer_terms(values: Column) -> Column:
    return F.filter(values, lambda v: F.length(strip(v)) >= 3)


def any_term_pattern(terms: Column) -> Column:
    """One alternation that matches when any whole-word term occurs."""
    body = F.array_join(F.transform(terms, lambda t: quote(strip(t))), "|")
    return F.concat(F.lit(r"(?iU)\b(?:"), body, F.lit(r")\b"))


def gazetteer_spans(text: Column, terms: Column, guard: Column) -> Column:
    """Whole-word, case-blind hits of the record's own terms.

    ``guard`` is the alternation of all terms: most texts contain none of them
    and are dismissed by that single pattern; others are searched from its first hit.
    """
    def one(part: Column) -> Callable[[Column], Column]:
        def spans_of(term: Column) -> Column:
            regex = F.concat(F.lit(r"(?iU)\b"), quote(strip(term)), F.lit(r"\b"))
            return pattern_spans(part["rest"], regex, "person_name", GAZETTEER_PRIORITY, (), part["cut"])

        return spans_of

    def search(before: Column) -> Column:
        found = let(from_word(text, before), lambda part: F.flatten(F.transform(terms, one(part))))
        return F.when(before < F.length(text), found).otherwise(no_spans())

    at = F.length(F.get(F.split(text, guard, 2), F.lit(0)))
    return F.when(F.size(terms) > 0, let(at, search)).otherwise(no_spans())


def resolve_overlaps(spans: Column) -> Column:
    """Greedy by priority, then length, then position; result by start."""
    def rank(s: Column) -> Column:
        return F.struct(
            (-s["priority"]).alias("p"), (s["start"] - s["end"]).alias("l"),
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
            s["priority"].alias("priority"),
        )

    def keep(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
        span = F.struct(s["start"].alias("start"), s["end"].alias("end"),
                        s["kind"].alias("kind"), s["priority"].alias("priority"))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(span).cast(SPANS)))

    def greedy(all_spans: Column) -> Column:
        ranked = F.array_sort(F.transform(all_spans, rank))
        return F.array_sort(F.aggregate(ranked, no_spans(), keep))

    return let(
        spans,
        lambda s: F.when(F.size(s) == 0, no_spans()).otherwise(greedy(s)),
    )


def cut_words(value: Column) -> Column:
    """The blank-separated parts of a value."""
    return F.filter(
        F.split(strip(value), f"[{WHITESPACE}]+"), lambda p: F.length(p) > 0
    )
