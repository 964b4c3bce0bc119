"""Column builders for label -> score maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: label names of the supported classifiers
TOXIC_LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_attack"]
LABEL_ALIASES = {"identity_hate": "identity_attack"}
PRIMARY_LABEL = {"toxic_bert": "toxic", "roberta_toxicity": "toxic", "dynabench_hate": "hate"}
CLASSIFIER_LABELS = {
    "toxic_bert": TOXIC_LABELS,
    "roberta_toxicity": ["toxic", "neutral"],
    "dynabench_hate": ["hate", "not_hate"],
}


def _normal_name(classifier: Column, label: Column) -> Column:
    low = F.lower(label)
    named = (
        F.when((classifier == "roberta_toxicity") & low.contains("toxic"), F.lit("toxic"))
        .when((classifier == "roberta_toxicity") & low.contains("neutral"), F.lit("neutral"))
        .when((classifier == "dynabench_hate") & low.contains("hate") & ~low.contains("not"), F.lit("hate"))
        .when((classifier == "dynabench_hate") & (low.contains("not") | low.contains("non")), F.lit("not_hate"))
        .otherwise(low)
    )
    for alias, name in LABEL_ALIASES.items():
        named = F.when(named == alias, F.lit(name)).otherwise(named)
    return named


def normalize_labels(classifier: Column, predictions: Column) -> Column:
    """Map from an array of (label, score) with normal label names; the last duplicate wins."""
    pairs = F.transform(
        predictions, lambda p: F.struct(_normal_name(classifier, p["label"]).alias("k"), p["score"].alias("v"))
    )
    names = F.transform(pairs, lambda p: p["k"])
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: ~F.array_contains(F.slice(names, p["i"] + 2, F.size(names)), p["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def normalize_map(classifier: Column, labels: Column) -> Column:
    """``normalize_labels`` for a map input, in key order."""
    entries = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.struct(e["key"].alias("label"), e["value"].alias("score")),
    )
    return normalize_labels(classifier, entries)


def primary_label(classifier: Column, default: Column | None = None) -> Column:
    cases = F.lit(None).cast("string")
    for name, label in PRIMARY_LABEL.items():
        cases = F.when(classifier == name, F.lit(label)).otherwise(cases)
    return F.coalesce(cases, default) if default is not None else cases


def primary_score(classifier: Column, labels: Column, default_label: Column | None = None) -> Column:
    """Score of the classifier's primary label; a missing label is 0."""
    return F.coalesce(F.try_element_at(labels, primary_label(classifier, default_label)), F.lit(0.0))


def detailed_scores(classifier: Column, text_type: Column, labels: Column) -> Column:
    """Array of (series, label, score): all categories of the multi-label classifier, else the main label."""
    main = F.when(classifier.contains("toxic"), F.lit("toxic")).otherwise(F.lit("hate"))

    def one(label: Column, series: Column) -> Column:
        return F.struct(
            series.alias("series"),
            label.alias("label"),
            F.coalesce(F.try_element_at(labels, label), F.lit(0.0)).alias("score"),
        )

    multi = F.array(
        *[one(F.lit(c), F.concat_ws("_", text_type, classifier, F.lit(c))) for c in TOXIC_LABELS]
    )
    return F.when(classifier == "toxic_bert", multi).otherwise(
        F.array(one(main, F.concat_ws("_", text_type, classifier)))
    )


def parse_label_map(text: Column) -> Column:
    """Map from a JSON object or from the printed form of a Python dict; malformed text is NULL."""
    fixed = F.regexp_replace(F.regexp_replace(text, r":\s*None\b", ": null"), r":\s*nan\b", ": NaN")
    return F.from_json(fixed, "map<string,double>", {"allowNonNumericNumbers": "true"})


def label_map_text(labels: Column) -> Column:
    return F.to_json(labels)
