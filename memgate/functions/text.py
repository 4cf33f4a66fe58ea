"""Terms, n-gram features, token estimates and normalisation as Columns. Only ASCII letters are folded."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def extract_terms(text: Column) -> Column:
    """Sorted distinct runs of [a-z0-9._:/@-], trimmed of punctuation, of 3 characters or more."""
    # runs are ASCII, so they are folded alone; sort_array compares in generated code
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9._:/@-]+"), F.lit(0)))
    return F.sort_array(F.array_distinct(F.filter(F.transform(runs, lambda x: F.lower(F.btrim(x, F.lit(".-_:/@")))), lambda x: F.length(x) >= 3)))


def harness_terms(text: Column) -> Column:
    """Sorted distinct runs of letters, digits and '-', untrimmed, of 3 characters or more."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z0-9-]+"), F.lit(0)), lambda x: F.length(x) >= 3)))


def ngrams(terms: Column, n: int) -> Column:
    """Windows of n over the sorted terms."""
    at = F.sequence(F.lit(1), F.size(terms) - (n - 1))
    return F.when(F.size(terms) >= n, F.transform(at, lambda i: F.array_join(F.slice(terms, i, n), " "))).otherwise(F.array().cast("array<string>"))


def features(terms: Column) -> Column:
    return F.concat(terms, ngrams(terms, 2), ngrams(terms, 3))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")))


def first_line(text: Column) -> Column:
    return F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))


def normalize_category(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), "_ ", "--")


def normalize_message_key(speaker: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.lower(F.trim(speaker)), F.lower(F.trim(text)))


def normalize_claim(text: Column, speaker: Column) -> Column:
    """Trimmed of blanks and .!,; at its ends, blanks squeezed, with the speaker before first-person claims."""
    clean = F.regexp_replace(F.btrim(F.btrim(text), F.lit(".!,;")), r"\s+", " ")
    return F.when(clean.rlike(r"(?i)^(i|my|our|we)\b") & (F.coalesce(speaker, F.lit("")) != ""), F.concat_ws(": ", speaker, clean)).otherwise(clean)


def needs_concrete_answer(question: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda x: F.contains(F.lower(question), x))
