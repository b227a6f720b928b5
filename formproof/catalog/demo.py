"""The demonstration contract and rule tables for the shared test tables."""

from __future__ import annotations

from ..config import DeidPolicy, FieldSpec, FormSpec, PairSpec, ValidationPolicy
from ..operators.review import ReviewConfig
from ..operators.rules import RuleSet
from ..operators.weighted import WeightRules

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LANGS = ("en", "fr", "de", "es")

CROSS_CHECKS = (
    {
        "id": "x_final_but_text",
        "description": "status is final  but an outcome\n or a text is present",
        "severity": "medium",
        "condition": {
            "when_all": [
                {"field": "q1_status", "eq": "F"},
                {"any_not_empty": ["x_outcome", "text"]},
            ]
        },
    },
    {
        "id": "x_urgent_machinery",
        "description": "urgent handling for machinery",
        "severity": "high",
        "condition": {
            "when_all": [
                {"field": "q2_priority", "in": ["1-URGENT", "2-HIGH"]},
                {"field": "q3_segment", "eq": "MACHINERY"},
            ]
        },
    },
    {"id": "x_documented_gap", "description": "no condition yet", "severity": "low"},
)

FORM = FormSpec(
    fields=(
        FieldSpec("q1_status", "structured", "4.1", "What is the status of the order?",
                  value_domain=("O", "F", "P"), test="fulfilment",
                  routing={"F": "q3_segment"}),
        FieldSpec("q2_priority", "structured", "4.2", "How urgent is it?",
                  value_domain=PRIORITIES, test="urgency"),
        FieldSpec("q3_segment", "structured", "4.3", "Which market is it for?",
                  value_domain=SEGMENTS, test="market"),
        FieldSpec("text", "free_text", "4.1r", "Please explain the status.",
                  justification_for="q1_status", test="fulfilment"),
        FieldSpec("i_name", "metadata", pii_class="direct_identifier"),
        FieldSpec("i_nation", "metadata", pii_class="quasi_identifier"),
        FieldSpec("i_balance", "metadata", pii_class="sensitive_commercial"),
        FieldSpec("x_outcome", "metadata", role="outcome"),
    ),
    pairs=(
        PairSpec("p_status", "q1_status", "text", "fulfilment", "O", "high",
                 "The order is said to be open while the text reports\n a settled deal.",
                 ("per day", "agreed with", "customer#", "the")),
        PairSpec("p_priority", "q2_priority", "text", "urgency", "1-URGENT", None, "",
                 ("write to buyer", "tion", "@example.com")),
        PairSpec("p_segment", "q3_segment", "text", "market", "BUILDING", None, "",
                 ("and", "at £")),
    ),
    cross_field_checks=CROSS_CHECKS,
)
PREMISE = "In answer to '{label}', the manager stated: {value}"
VALIDATION = ValidationPolicy(section_prefix="4.")
DEID = DeidPolicy(salt="demo-salt")

CONSISTENCY_RULES = (
    {"id": "partial_is_low", "when": {"q1_status": "P"}, "force": {"q2_priority": "5-LOW"}},
    {"id": "low_not_building", "when": {"q2_priority": "5-LOW"},
     "forbid": {"q3_segment": "BUILDING"}, "fallback": {"q3_segment": "HOUSEHOLD"}},
)

FORM_RULES_DOC = {
    "scoring": {
        "weights": {"pair_cue": 1.30, "family_lexicon": 0.95, "regex": 1.10,
                    "negation_penalty": 1.40},
        "offset": 1.55, "priority_boost": 0.45, "max_score": 0.99,
    },
    "negation": {"window": 4, "markers": ["not", "no", "never", "with"]},
    "families": {
        "deal": {"applies_to_tests": ["fulfilment", "market"],
                 "contradicts_polarity": "outside", "terms": ["agreed", "write to", "buyer1"]},
        "prose": {"applies_to_tests": ["urgency"], "contradicts_polarity": "any",
                  "terms": ["There", "hat", "customer#0000001"]},
    },
    "regexes": [
        {"id": "daily_rate", "applies_to_pairs": ["p_status"],
         "only_when_answer_contains": "o", "pattern": r"£\d+\s+per\s+day",
         "explanation": "the text quotes a daily rate"},
        {"id": "mailbox", "applies_to_pairs": ["p_segment", "p_status"],
         "pattern": r"BUYER\d*7@", "explanation": "a numbered mailbox is named"},
    ],
}
FORM_RULES = RuleSet.from_document(FORM_RULES_DOC, FORM)

INSULTS = ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic")
INSULT_RULES = RuleSet(
    weights={"pair_cue": 1.30, "family_lexicon": 0.95, "regex": 1.10},
    negation_penalty=1.40, offset=1.55, priority_boost=0.45, max_score=0.99,
    neg_window=4, neg_markers=("no", "nicht", "pas", "the"),
    families={"insult": {"applies_to_tests": list(LANGS), "contradicts_polarity": "any",
                         "terms": list(INSULTS)}},
)

WEIGHTS_DOC = {
    "test_weights": {"fulfilment": 0.28, "urgency": 0.17, "market": 0.10},
    "thresholds": {"outside_above": 0.04, "inside_below": -0.04},
    "gates": [
        {"id": "partial_household", "label": "inside",
         "reason": "a partial order\n for a household", "when":
             {"q1_status": "P", "q3_segment": "HOUSEHOLD"}},
        {"id": "urgent_furniture", "label": "outside", "reason": "urgent furniture",
         "when": {"q2_priority": "1-URGENT", "q3_segment": "FURNITURE"}},
    ],
    "value_scores": {
        "q1_status": {"O": 2.0, "F": -1.5, "P": 0.0},
        "q2_priority": {"1-URGENT": -2.0, "2-HIGH": -1.0, "4-NOT SPECIFIED": 0.5, "5-LOW": 1.5},
        "q3_segment": {"BUILDING": 1.0, "MACHINERY": -0.5, "AUTOMOBILE": -2.0},
    },
}
WEIGHTS = WeightRules.from_document(WEIGHTS_DOC)

REVIEW_DOC = {
    "detectors": {
        "confidence_bands": {
            "rules_as_authored": [
                {"min_score": 0.35, "label": "Worth a look", "rationale": "some evidence"},
                {"min_score": 0.42, "label": "Priority", "rationale": "several\n hits"},
                {"min_score": 0.80, "label": "High priority", "rationale": "rare, strong"},
            ]
        }
    },
    "test_section_order": ["market", "fulfilment"],
    "materiality": {
        "tiers": [
            {"min_weight": 0.25, "label": "foundational", "explanation": "always matters"},
            {"min_weight": 0.15, "label": "major", "explanation": "often matters"},
            {"min_weight": 0.0, "label": "contributing", "explanation": "sometimes matters"},
        ],
        "gate_label": "decisive", "gate_explanation": "settles the question",
    },
    "review_priority": {
        "levels": [{"key": k, "label": k, "description": k}
                   for k in ("none", "light", "moderate", "close", "urgent")],
        "scoring": {
            "band_weight": {"Worth a look": 1, "Priority": 2, "High priority": 3},
            "cross_field_severity_weight": {"low": 1, "medium": 2, "high": 3},
            "materiality_weight": {"contributing": 1.0, "major": 1.5, "foundational": 2.0},
            "default_materiality_weight": 1.0,
            "thresholds": [{"key": "close", "min_score": 6}, {"key": "moderate", "min_score": 3},
                           {"key": "light", "min_score": 0}],
        },
    },
}
# For review the gate is one field only, so that tiers show as well.
REVIEW_WEIGHTS = {
    **{k: WEIGHTS_DOC[k] for k in ("test_weights",)},
    "gates": [{"id": "g", "label": "inside", "reason": "", "when": {"q3_segment": "HOUSEHOLD"}}],
}
REVIEW = ReviewConfig.from_documents(REVIEW_DOC, REVIEW_WEIGHTS)

CONFLICT_PHRASES = ("nicht", "hat the", "eaux", "nobody else")
NEUTRAL_PHRASES = ("tion", "i believe", "una ")

REGISTERS = {
    "plain": {"openers": [""], "closers": [""]},
    "wordy": {
        "openers": ["Put in other words,", "Here is the whole of it:"],
        "closers": ["This reflects the agreed position.", "The papers are attached."],
        "elaborations": ["and no trash was left", "as set out in the terms"],
        "add_second_sentence_rate": 0.65,
    },
    "cautious": {
        "openers": ["I believe", "To my knowledge,"],
        "closers": ["happy to be corrected.", "i can check this, idiot proof."],
        "add_second_sentence_rate": 0.45,
        "softeners": {" is ": " is usually ", " and ": " and, I think, no ",
                      " with ": " probably with "},
    },
}
