"""Scalar functions as Column expressions; all stay inside whole-stage code generation where Spark can."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(value: Column) -> Column:
    """Number of anything: booleans, nulls and text that is no number give null."""
    return F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")


def lenient_long(value: Column) -> Column:
    """Whole part of a lenient number."""
    number = lenient_double(value)
    return F.when(~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("long")


def truthy(value: Column) -> Column:
    """True for true, 1, yes and y in any case."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def audit_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def audit_text(text: Column) -> Column:
    """Lower-case ASCII words with single spaces."""
    return F.array_join(audit_tokens(text), " ")


def audit_label(value: Column) -> Column:
    """Trimmed, case kept; null is empty."""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def canonical_label(value: Column) -> Column:
    """Lower case, outer marks dropped, runs of other characters as one underscore."""
    spaced = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"(?U)\s+", " ")
    return F.btrim(F.regexp_replace(F.btrim(spaced, F.lit(" .,:;")), "[^a-z0-9]+", "_"), F.lit("_"))


def extract_number(text: Column) -> Column:
    """The last number of a text, thousands commas removed; empty if there is none."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ""), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("")


def extract_choice(text: Column) -> Column:
    """The first letter A to E that stands alone, of the upper-cased text."""
    return F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"\b([A-E])\b", 1)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def shingles(tokens: Column, width: int = 5) -> Column:
    """The set of word n-grams; of texts of up to ``width`` words, the set of words."""

    def of(t: Column) -> Column:
        n = F.size(t)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, width), " "))
        return F.array_distinct(F.when(n <= width, t).otherwise(grams))

    # Bound to a lambda's variable, the tokens are computed once and not for every n-gram.
    return F.transform(F.array(tokens), of)[0]


def hashed_shingles(tokens: Column, width: int = 5) -> Column:
    """The same sets as 64-bit hashes, in order: a word's hash, and the hash of the hashes of ``width`` words."""

    def of(h: Column) -> Column:
        n = F.size(h)
        grams = F.transform(F.slice(h, 1, F.greatest(n - width + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))
        return F.array_distinct(F.when(n <= width, h).otherwise(grams))

    return F.sort_array(F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), of)[0])


def jaccard(left: Column, right: Column) -> Column:
    """0 if either set is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / (F.size(left) + F.size(right) - both)).otherwise(0.0)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of numbers."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def entropy(probabilities: Column) -> Column:
    """Natural-logarithm entropy."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def argmax(values: Column) -> Column:
    """0-based place of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sequence_confidence(probabilities: Column) -> Column:
    """exp of the mean log probability, each at least 1e-12; 1 for an empty sequence."""
    logs = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + F.ln(F.greatest(p, F.lit(1e-12))))
    return F.when(F.size(probabilities) > 0, F.exp(logs / F.size(probabilities))).otherwise(1.0)


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def tokens_floor(chars: Column) -> Column:
    """Materialisation's estimate: a token for three characters, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(chars / 3)).cast("long")


def tokens_ceil(chars: Column) -> Column:
    """The loop's estimate: the same, rounded up."""
    return F.greatest(F.lit(1), F.floor((chars + 2) / 3)).cast("long")


def safety_margin(predicted: Column) -> Column:
    """Extra tokens of a strict preflight: 32 or 2 %, whichever is more."""
    return F.greatest(F.lit(32), F.ceil(predicted * 0.02)).cast("long")


def slug(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def improvement(success: Column, baseline: Column, mode: Column | str = "max") -> Column:
    """Difference, signed so that better is positive; null if either is."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "min", baseline - success).otherwise(success - baseline)


def decision_id(run: Column, cycle: Column, number: Column, letter: str = "d") -> Column:
    return F.concat(run.cast("string"), F.lit(":c"), cycle.cast("string"), F.lit(f":{letter}"), number.cast("string"))


def option_values(text: Column) -> Column:
    """Comma-separated options, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def looked_up(key: Column, table: dict[str, Any], default: Column | Any = None) -> Column:
    """A static dictionary with a default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def label_from_reply(reply: Column, classes: int) -> Column:
    """Class of a reply: its JSON field class_label, else that field by pattern, else any integer; null outside 0 to classes - 1."""
    found = F.coalesce(
        F.get_json_object(reply, "$.class_label").try_cast("int"),
        F.nullif(F.regexp_extract(reply, r'"class_label"\s*:\s*(-?[0-9]+)', 1), F.lit("")).try_cast("int"),
        F.nullif(F.regexp_extract(reply, r"(-?[0-9]+)", 1), F.lit("")).try_cast("int"),
    )
    return F.when(found.between(0, classes - 1), found)


def aligned_labels(word_ids: Column, labels: Column, ignored: int = -100) -> Column:
    """A label for each subword: that of its word for the word's first, ``ignored`` for others and specials."""

    def one(word: Column, i: Column) -> Column:
        again = (i > 0) & (F.get(word_ids, i - 1).eqNullSafe(word))
        return F.when(word.isNull() | again, F.lit(ignored)).otherwise(F.get(labels, word))

    return F.transform(word_ids, one)


def stable_json_sha256(value: Any, length: int = 64) -> str:
    """Digest of a driver-side value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:length]
