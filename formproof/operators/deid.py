"""De-identification of records (E1-E24), one row at a time and shuffle-free.

All free texts of a record are scanned inside one array expression, so the
plan stays small however many text fields a form has.  Surrogate numbers are
scoped to the record and shared by its fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DeidPolicy, FormSpec
from ..functions.plan import once
from ..functions.spans import (
    AMOUNT_TOKEN,
    RESIDUAL_PATTERNS,
    TOKEN_NAMES,
    any_term_pattern,
    cut_words,
    detector_spans,
    gazetteer_spans,
    gazetteer_terms,
    resolve_overlaps,
)
from ..functions.text import is_blank, let, strip

REPORT = (
    "struct<field_actions:map<string,string>,entity_counts:map<string,int>,"
    "fields_with_entities:array<string>,total_entities:int,is_clean:boolean>"
)


def known_values(df: DataFrame, spec: FormSpec, policy: DeidPolicy) -> Column:
    """Names and identifiers the record itself declares."""
    have = set(df.columns)
    groups: list[Column] = []
    for names in policy.name_groups:
        parts = F.array_compact(
            F.array(*[
                F.when(~is_blank(F.col(n)), strip(F.col(n)))
                for n in names if n in have
            ])
        )
        groups.append(F.when(F.size(parts) > 1, F.array_join(parts, " ")))
    whole: list[Column] = []
    for f in spec.pii_fields:
        if f.pii_class == "quasi_identifier" or f.id not in have:
            continue
        value = strip(F.col(f.id))
        whole.append(F.when(F.length(value) > 0, value))
    if not groups and not whole:
        return F.array().cast("array<string>")
    parts_of = [
        F.coalesce(
            F.filter(cut_words(w), lambda p: F.length(p) > 2), F.array().cast("array<string>")
        )
        for w in whole
    ]
    singles = F.array_compact(F.array(*groups, *whole)).cast("array<string>")
    return F.array_distinct(F.concat(singles, *parts_of))


def surrogate(kind: Column, number: Column) -> Column:
    """The stand-in token; amounts carry no number."""
    names = F.create_map(*[F.lit(x) for kv in TOKEN_NAMES.items() for x in kv])
    prefix = F.coalesce(F.element_at(names, kind), F.upper(kind))
    numbered = F.concat(F.lit("["), prefix, F.lit("_"), number.cast("string"), F.lit("]"))
    return F.when(kind == "money", F.lit(AMOUNT_TOKEN)).otherwise(numbered)


def _surface(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def _occurrence(text: Column, s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), F.lower(_surface(text, s)).alias("key"))


def scan(df: DataFrame, spec: FormSpec, policy: DeidPolicy) -> DataFrame:
    """Add ``_scan``: the record's texts with their resolved spans."""
    have = set(df.columns)
    texts = [f.id for f in spec.of_type("free_text") if f.id in have]
    boxes = F.filter(
        F.array(*[F.struct(F.lit(t).alias("field"), F.col(t).alias("text")) for t in texts]),
        lambda b: ~is_blank(b["text"]),
    ) if texts else F.array().cast("array<struct<field:string,text:string>>")

    names_on = "person_name" in policy.detectors
    terms = (
        gazetteer_terms(known_values(df, spec, policy))
        if names_on else F.array().cast("array<string>")
    )

    def scan_all(known: Column, guard: Column) -> Column:
        def spans_of(box: Column) -> Column:
            found = detector_spans(box["text"], policy.detectors)
            if names_on:
                found = F.concat(found, gazetteer_spans(box["text"], known, guard))
            return F.struct(
                box["field"].alias("field"), box["text"].alias("text"),
                resolve_overlaps(found).alias("spans"),
            )

        return F.transform(boxes, spans_of)

    # terms and their alternation are bound once per record, not once per text
    scanned = let(
        terms, lambda known: let(any_term_pattern(known), lambda g: scan_all(known, g))
    )
    return once(df, {"_scan": scanned})


def number_surrogates(scanned: DataFrame) -> DataFrame:
    """Add ``_index``: distinct (kind, key) in numbering order.

    Fields count in form order; inside a field the rightmost entity comes
    first, so numbers grow from right to left.
    """
    per_field = F.transform(
        "_scan",
        lambda f: F.transform(F.reverse(f["spans"]), lambda s: _occurrence(f["text"], s)),
    )
    return scanned.withColumn("_index", F.array_distinct(F.flatten(per_field)))


def rewrite(scanned: DataFrame) -> DataFrame:
    """Add ``_clean``: field -> text with every span replaced."""
    def token(index: Column, text: Column, s: Column) -> Column:
        same_kind = F.filter(index, lambda x: x["kind"] == s["kind"])
        return surrogate(s["kind"], F.array_position(same_kind, _occurrence(text, s)))

    def clean(index: Column, f: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            return F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(f["text"], acc["at"] + 1, s["start"] - acc["at"]),
                    token(index, f["text"], s),
                ).alias("out"),
            )

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        rest = F.aggregate(
            f["spans"], start, step,
            lambda acc: F.concat(
                acc["out"],
                F.substring(f["text"], acc["at"] + 1, F.length(f["text"]) - acc["at"]),
            ),
        )
        return F.struct(
            f["field"].alias("key"),
            F.when(F.size(f["spans"]) == 0, f["text"]).otherwise(rest).alias("value"),
        )

    cleaned = let(
        F.col("_index"), lambda index: F.transform("_scan", lambda f: clean(index, f))
    )
    return once(scanned, {"_clean": F.map_from_entries(cleaned)})


def pseudonym(value: Column, salt: str) -> Column:
    """Salted, shortened hash, equal for equal inputs."""
    hashed = F.sha2(F.concat(F.lit(salt), F.lit("|"), value), 256)
    return F.concat(F.lit("qi_"), F.substring(hashed, 1, 10))


def field_treatment(name: str, value: Column, action: str, salt: str) -> Column:
    """What a field's policy leaves of its value."""
    if action == "replace":
        new: Column = F.lit(f"[REDACTED:{name}]")
    elif action == "pseudonymise":
        new = pseudonym(value, salt)
    elif action == "mask":
        new = F.lit(f"[MASKED:{name}]")
    else:
        return value
    return F.when(is_blank(value), value).otherwise(new)


def apply_field_policy(df: DataFrame, spec: FormSpec, policy: DeidPolicy) -> DataFrame:
    """E16-E18 alone: treat the declared identifier fields, leave texts as they are."""
    have = set(df.columns)
    treated = {}
    for f in spec.fields:
        action = policy.field_policy.get(f.pii_class, "keep")
        if f.id in have and action != "keep":
            treated[f.id] = field_treatment(f.id, F.col(f.id), action, policy.salt)
    return df.withColumns(treated)


def deidentify(
    df: DataFrame, spec: FormSpec, policy: DeidPolicy = DeidPolicy(), *, report: bool = True
) -> DataFrame:
    """The record with identifiers removed, plus a ``deid`` report struct.

    The report holds counts and field names only, never values.
    """
    if not policy.enabled:
        return df
    have = set(df.columns)
    use = policy if policy.scrub_entities else DeidPolicy(detectors=(), name_groups=())
    work = rewrite(number_surrogates(scan(df, spec, use)))

    new_columns: dict[str, Column] = {}
    actions: list[Column] = []
    for f in spec.fields:
        if f.id not in have:
            continue
        action = policy.field_policy.get(f.pii_class, "keep")
        base = F.col(f.id)
        if f.type == "free_text":
            base = F.coalesce(F.element_at(F.col("_clean"), F.lit(f.id)), base)
        treated = field_treatment(f.id, base, action, policy.salt)
        if f.type == "free_text" or action != "keep":
            new_columns[f.id] = treated
        actions.append(
            F.when(
                F.col(f.id).isNotNull(),
                F.struct(F.lit(f.id).alias("key"), F.lit(action).alias("value")),
            )
        )
    if report:
        kinds = F.flatten(F.transform("_scan", lambda f: F.transform(f["spans"], lambda s: s["kind"])))
        counts = let(
            kinds,
            lambda ks: F.map_from_entries(
                F.transform(
                    F.array_sort(F.array_distinct(ks)),
                    lambda k: F.struct(
                        k.alias("key"), F.size(F.filter(ks, lambda x: x == k)).alias("value")
                    ),
                )
            ),
        )
        touched = F.transform(
            F.filter("_scan", lambda f: F.size(f["spans"]) > 0), lambda f: f["field"]
        )
        total = F.aggregate(
            "_scan", F.lit(0), lambda acc, f: acc + F.size(f["spans"])
        )
        new_columns["deid"] = F.struct(
            F.map_from_entries(F.array_compact(F.array(*actions))).alias("field_actions"),
            counts.alias("entity_counts"),
            touched.alias("fields_with_entities"),
            total.alias("total_entities"),
            (total == 0).alias("is_clean"),
        ).cast(REPORT)
    return work.withColumns(new_columns).drop("_scan", "_index", "_clean")


def scrub_text(df: DataFrame, text: str, policy: DeidPolicy = DeidPolicy()) -> DataFrame:
    """E14 for one bare text column: adds ``<text>_clean`` and ``entity_spans``."""
    from ..config import FieldSpec

    spec = FormSpec(fields=(FieldSpec(id=text, type="free_text"),))
    work = rewrite(number_surrogates(scan(df, spec, policy)))
    spans = F.flatten(F.transform("_scan", lambda f: f["spans"]))
    return work.withColumns(
        {
            f"{text}_clean": F.coalesce(
                F.element_at(F.col("_clean"), F.lit(text)), F.col(text)
            ),
            "entity_spans": spans,
        }
    ).drop("_scan", "_index", "_clean")


def batch_report(deidentified: DataFrame) -> DataFrame:
    """One row over a whole batch."""
    return deidentified.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum("deid.total_entities"), F.lit(0)).alias("total_entities"),
        F.count_if(F.col("deid.total_entities") > 0).alias("records_with_entities"),
        F.count_if(F.col("deid").isNull()).alias("records_with_errors"),
    )


def has_residual(text: Column) -> Column:
    """Does a text still look as if it carries an identifier?"""
    hits = [text.rlike(p) for p in RESIDUAL_PATTERNS]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def split_safe(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Whole records fit to leave, and records to quarantine.

    A record whose scrub gave nothing, or left an identifier, never passes on.
    """
    unsafe = reduce(lambda a, b: a | b, [has_residual(F.col(c)) for c in columns])
    if "deid" in df.columns:
        unsafe = unsafe | F.col("deid").isNull()
    return df.where(~unsafe), df.where(unsafe)
