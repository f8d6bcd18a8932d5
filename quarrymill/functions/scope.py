"""Topic labels by patterns, and the scope they put a question in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and case-insensitive patterns, in the order in which matches are listed.
RULES: list[tuple[str, str]] = [
    ("psychiatry", r"\bpsychiatr\w*\b"),
    ("mental health", r"\bmental\s+health\b"),
    ("depression", r"\bdepress\w*\b"),
    ("anxiety", r"\banx\w*\b"),
    ("schizophrenia", r"\bschizophren\w*\b"),
    ("psychosis", r"\bpsychos\w*\b"),
    ("bipolar", r"\bbipolar\b"),
    ("mania", r"\bmanic\b|\bmania\b"),
    ("obsessive compulsive", r"\bobsessive[-\s]+compulsive\b|\bOCD\b"),
    ("panic", r"\bpanic\s+attack\w*\b|\bpanic\s+disorder\b"),
    ("phobia", r"\bphobi\w*\b"),
    ("post-traumatic stress", r"\bpost[-\s]?traumatic\s+stress\b|\bPTSD\b"),
    ("personality disorder", r"\bpersonality\s+disorder\w*\b"),
    ("autism", r"\bautis\w*\b"),
    ("attention deficit", r"\bADHD\b|\battention[-\s]+deficit\b"),
    ("delirium", r"\bdeliri\w*\b"),
    ("suicide", r"\bsuicid\w*\b"),
    ("hallucination", r"\bhallucination\w*\b"),
    ("delusion", r"\bdelusion\w*\b"),
    ("psychotherapy", r"\bpsychotherap\w*\b|\bcognitive[-\s]+behavioral\s+therapy\b"),
    ("psychiatric medication", r"\bantipsychotic\w*\b|\bantidepressant\w*\b"),
    ("mood stabilizer", r"\bmood\s+stabilizer\w*\b"),
]
#: Lower-case letters of which every match of a rule holds one of these runs: a plain search for them is
#: much cheaper than the rule, which then decides.
STEMS: dict[str, tuple[str, ...]] = {
    "psychiatry": ("psychiatr",), "mental health": ("mental",), "depression": ("depress",), "anxiety": ("anx",),
    "schizophrenia": ("schizophren",), "psychosis": ("psychos",), "bipolar": ("bipolar",), "mania": ("manic", "mania"),
    "obsessive compulsive": ("obsessive", "ocd"), "panic": ("panic",), "phobia": ("phobi",),
    "post-traumatic stress": ("traumatic", "ptsd"), "personality disorder": ("personality",), "autism": ("autis",),
    "attention deficit": ("adhd", "attention"), "delirium": ("deliri",), "suicide": ("suicid",), "hallucination": ("hallucination",),
    "delusion": ("delusion",), "psychotherapy": ("psychotherap", "cognitive"),
    "psychiatric medication": ("antipsychotic", "antidepressant"), "mood stabilizer": ("stabilizer",),
}
#: The letters outside ASCII that patterns without regard to case take for i, k or s; texts with one of
#: them go to every rule.
ODD = "\u0130\u0131\u017f\u212a"
#: Fixed values of the two outcomes: scope, evidence expected, topic, reason.
IN_SCOPE = ("psychiatry_relevant", True, "psychiatry", "Explicit psychiatry-related term matched in question or options")
OUT_OF_SCOPE = ("out_of_corpus", False, "general_medical", "No explicit psychiatry-related term matched in question or options")
ANNOTATOR, VERSION = "lexical_candidate", "scope_v1"


def question_text(question: Column, options: Column | None = None) -> Column:
    """The question and the texts of its options, joined by spaces."""
    if options is None:
        return question
    return F.concat_ws(" ", question, F.concat_ws(" ", F.transform(options, lambda o: o["text"])))


def matched_terms(text: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Names of the rules that match, in rule order."""
    either = lambda tests: reduce(Column.__or__, tests)

    def hit(x: Column, name: str, pattern: str) -> Column:
        found = x["text"].rlike(f"(?iU){pattern}")
        if (name, pattern) not in RULES or name not in STEMS:
            return found
        return either([x["odd"], *[F.contains(x["low"], F.lit(stem)) for stem in STEMS[name]]]) & found

    def named(x: Column) -> Column:
        return F.filter(F.array(*[F.when(hit(x, name, pattern), F.lit(name)) for name, pattern in rules]), lambda n: n.isNotNull())

    # Arrays of one element give a name to what all rules share, so that it is made once for a text.
    known = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), either([F.contains(t, F.lit(c)) for c in ODD]).alias("odd"))
    return F.get(F.transform(F.transform(F.array(text), known), named), F.lit(0))


def annotate(
    questions: DataFrame, text: Column, rules: list[tuple[str, str]] = RULES, annotator: str = ANNOTATOR, version: str = VERSION
) -> DataFrame:
    """``questions`` with matched terms, scope, evidence flag, topic, reason and provenance."""
    hit = F.size("matched_terms") > 0
    pick = lambda k: F.when(hit, F.lit(IN_SCOPE[k])).otherwise(F.lit(OUT_OF_SCOPE[k]))
    named = questions.withColumn("matched_terms", matched_terms(text, rules))
    return named.withColumns(
        {
            "scope": pick(0),
            "evidence_expected": pick(1),
            "topic": pick(2),
            "reason": pick(3),
            "annotator": F.lit(annotator),
            "annotation_version": F.lit(version),
        }
    )


def scope_counts(annotations: DataFrame) -> DataFrame:
    """Annotations per scope, by name."""
    return annotations.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).orderBy("scope")
