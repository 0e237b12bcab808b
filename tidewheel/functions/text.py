"""String and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_prompt(text: Column) -> Column:
    """White space stripped at both ends; underscores and line feeds become blanks."""
    return F.translate(F.regexp_replace(text, r"^\s+|\s+$", ""), "_\n", "  ")


def prompt_with_state(prompt: Column, bins: Column) -> Column:
    """The prompt template for a discretised state."""
    return F.concat(F.lit("Task: "), prompt, F.lit(", State: "), F.array_join(bins.cast("array<string>"), " "), F.lit(";\nAction: "))


def pad_tokens(tokens: Column, n: int, filler: str = "") -> Column:
    """Cut or padded at the end to n tokens."""
    return F.concat(F.slice(tokens, 1, n), F.array_repeat(F.lit(filler), F.greatest(F.lit(n) - F.size(tokens), F.lit(0))))


def token_mask(tokens: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.size(tokens))


def safe_name(text: Column, default: str = "item") -> Column:
    """Letters, digits, dot, dash and underscore only; the default if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.when(kept != "", kept), F.lit(default))


def dim_name(names: Column, i: Column) -> Column:
    """The i-th name (from 0), or dim_NN."""
    return F.coalesce(F.get(names, i), F.format_string("dim_%02d", i))


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON of the columns in the order of their names, nulls left out; for integers and strings, whose text is the same everywhere."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))))


def spec_ranges(spec: Column, separator: str, inclusive: bool) -> Column:
    """'14:21,28' or '0,2,5-9' to the distinct numbers in order of mention; the range's end is left out or not."""
    part = F.split(F.regexp_replace(spec, r"\s+", ""), ",")
    last = lambda x: F.try_element_at(F.split(x, separator), F.lit(2)).cast("int")
    first = lambda x: F.element_at(F.split(x, separator), 1).cast("int")
    end = lambda x: F.coalesce(last(x) - (0 if inclusive else 1), first(x))
    return F.array_distinct(F.flatten(F.transform(F.filter(part, lambda x: x != ""), lambda x: F.sequence(first(x), end(x)))))
