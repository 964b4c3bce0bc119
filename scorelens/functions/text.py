"""Column builders for prompt, completion and name strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def full_text(prompt: Column, output: Column, *, sep: str = " ", strip_result: bool = False) -> Column:
    """Prompt followed by output; an empty prompt adds no separator."""
    joined = F.when(prompt == "", output).otherwise(F.concat(prompt, F.lit(sep), output))
    return strip(joined) if strip_result else joined


def text_variants(prompt: Column, original: Column, detoxified: Column, *, sep: str = " ") -> Column:
    """Array of (variant, text): the prompt, each output, and each prompt with its output."""
    return F.array(
        F.struct(F.lit("prompt_only").alias("variant"), prompt.alias("text")),
        F.struct(F.lit("prompt_original").alias("variant"), full_text(prompt, original, sep=sep).alias("text")),
        F.struct(F.lit("prompt_detoxified").alias("variant"), full_text(prompt, detoxified, sep=sep).alias("text")),
        F.struct(F.lit("original_output").alias("variant"), original.alias("text")),
        F.struct(F.lit("detoxified_output").alias("variant"), detoxified.alias("text")),
    )


def remove_prompt(completion: Column, prompt: Column) -> Column:
    """Drop the first literal occurrence of the prompt, then strip."""
    at = F.instr(completion, prompt)
    head = F.substring(completion, F.lit(1), at - 1)
    tail = F.substring(completion, at + F.length(prompt), F.length(completion))
    return strip(F.when(at > 0, F.concat(head, tail)).otherwise(completion))


def shorten(text: Column, limit: int, mark: str = "...") -> Column:
    """Text cut for display with a mark where something was cut; the source column stays whole."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


# fixed values: checkpoint name patterns, first match wins
EPOCH_PATTERNS = [r"checkpoint-(\d+)", r"epoch-(\d+)", r"epoch_(\d+)", r"-(\d+)$", r"-(\d+)-"]
EPOCH_SUFFIXES = [r"-checkpoint-\d+$", r"-epoch-\d+$", r"-\d+$"]


def epoch_of(name: Column, *, default: int | None = None) -> Column:
    """Training epoch in a model name; ``base`` is 0, an unknown name is ``default``."""
    found = [
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast("int") for pattern in EPOCH_PATTERNS
    ]
    return F.when(name == "base", F.lit(0)).otherwise(F.coalesce(*found, F.lit(default).cast("int")))


def base_model_name(name: Column) -> Column:
    """Model name without its checkpoint, epoch or number suffix."""
    return reduce(lambda c, pattern: F.regexp_replace(c, pattern, ""), EPOCH_SUFFIXES, name)


def checkpoint_name(base: Column, epoch: Column) -> Column:
    return F.concat(base, F.lit("-checkpoint-"), epoch.cast("string"))


def dataset_fields(dataset_id: Column) -> Column:
    """Struct of model size, toxicity threshold, temperature and sample count parsed from a dataset name."""
    low = F.lower(dataset_id)

    def field(pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
        return F.coalesce(found, F.lit("unknown"))

    def number(pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
        return F.coalesce(F.replace(found, F.lit("p"), F.lit(".")), F.lit("unknown"))

    return F.struct(
        field(r"pythia-(\d+[mb])").alias("model_size"),
        number(r"tox(\d+p\d+)").alias("toxicity_threshold"),
        number(r"temp(\d+p\d+)").alias("temperature"),
        field(r"(\d+)_samples").alias("sample_count"),
    )


def dataset_name(
    model: Column, samples: Column, temperature: Column, threshold: Column, original: Column
) -> Column:
    """Dataset name that ``dataset_fields`` can parse back."""

    def dotted(value: Column) -> Column:
        return F.replace(value.cast("string"), F.lit("."), F.lit("p"))

    return F.concat(
        F.replace(model, F.lit("/"), F.lit("_")),
        F.lit("_"),
        samples.cast("string"),
        F.lit("_samples_temp"),
        dotted(temperature),
        F.lit("_tox"),
        dotted(threshold),
        F.when(original, F.lit("_original")).otherwise(F.lit("_detoxified")),
    )


# fixed values: name keywords, first family with a hit wins
FAMILY_KEYWORDS = [
    ("sequence_classification", ["toxicity", "toxic", "classifier", "sequence_classification"]),
    ("roberta", ["roberta"]),
    ("bert", ["bert"]),
    ("xlnet", ["xlnet"]),
    ("electra", ["electra"]),
    ("reward_model", ["pythia", "llama", "gpt", "neo"]),
]
SIZE_KEYWORDS = [
    ("large_models", ["1b", "2.7b", "6b", "7b", "12b", "70b", "large"]),
    ("medium_models", ["410m", "160m", "125m", "70m"]),
]
MULTI_LABEL_KEYWORDS = ["toxic-bert", "toxigen", "detoxify"]


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def _first_class(text: Column, classes: list, default: str) -> Column:
    return F.coalesce(
        *[F.when(contains_any(text, words), F.lit(name)) for name, words in classes], F.lit(default)
    )


def model_family(name: Column) -> Column:
    return _first_class(F.lower(name), FAMILY_KEYWORDS, "sequence_classification")


def size_class(name: Column) -> Column:
    return _first_class(F.lower(name), SIZE_KEYWORDS, "small_models")


def is_multi_label(name: Column) -> Column:
    return contains_any(F.lower(name), MULTI_LABEL_KEYWORDS)


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1] from the md5 of the ':'-joined parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
