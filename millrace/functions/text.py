"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker that ends a function body, and the wrapping of a candidate program.
BODY_END = "\n}"
PROGRAM_HEAD = "package main\n\n"
PROGRAM_TAIL = "\n\nfunc main() {}"


def ascii_strip(c: Column) -> Column:
    """Without characters beyond ASCII; most texts have none and are not searched."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def strip_ws(c: Column) -> Column:
    """Whitespace off both ends, Unicode blanks and the four ASCII separators included."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def truncate_after(c: Column, marker: str = BODY_END) -> Column:
    at = F.instr(c, marker)
    return F.when(at > 0, F.substring(c, F.lit(1), at + F.lit(len(marker) - 1))).otherwise(c)


def test_source(test_setup: Column, test: Column) -> Column:
    return F.concat(test_setup, F.lit("\n"), test)


def candidate_source(prompt: Column, candidate: Column) -> Column:
    return F.concat(F.lit(PROGRAM_HEAD), prompt, candidate, F.lit(PROGRAM_TAIL))


def fixed_decimals(value: Column, digits: int | Column) -> Column:
    """Half-even on the exact binary value, as C's and Python's ``%.nf``.

    ``format_string`` rounds the shortest decimal form half up instead.
    """
    digits = F.lit(digits) if isinstance(digits, int) else digits
    shown = F.call_function("format_number", value.cast("double"), digits)
    return F.replace(shown, F.lit(","), F.lit(""))


def human_bytes(n: Column) -> Column:
    def scaled(power: int, unit: str) -> Column:
        return F.concat((n / F.lit(1000.0**power)).cast("string"), F.lit(f" {unit}"))

    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1000**2, scaled(1, "KB"))
        .when(n < 1000**3, scaled(2, "MB"))
        .when(n < 1000**4, scaled(3, "GB"))
        .otherwise(scaled(4, "TB"))
    )


def human_count(n: Column) -> Column:
    size = F.abs(n)
    return (
        F.when(size < 1000, fixed_decimals(n, 0))
        .when(size < 1e6, F.concat(fixed_decimals(n / 1e3, 1), F.lit("k")))
        .when(size < 1e9, F.concat(fixed_decimals(n / 1e6, 1), F.lit("M")))
        .otherwise(F.concat(fixed_decimals(n / 1e9, 1), F.lit("B")))
    )


# Name prefix of a metric by the phase that reports it.
PHASE_PREFIX = {
    "step": "train/step/",
    "train_batch": "train/batch/",
    "validation": "validation/",
    "validation_batch": "validation/batch/",
    "test": "test/",
    "test_batch": "test/batch/",
}


def metric_path(phase: Column, name: Column) -> Column:
    prefix = F.lit(None).cast("string")
    for known, text in PHASE_PREFIX.items():
        prefix = F.when(phase == known, text).otherwise(prefix)
    return F.concat(prefix, name)


def fill_filename(pattern: Column | str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` and ``{name:.Nf}`` fields, N up to 99; what is unknown stays in place.

    N is read from the pattern, row by row where it is a column.
    """
    out = F.lit(pattern) if isinstance(pattern, str) else pattern
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        field = r"\{%s:\.([0-9]{1,2})f\}" % name
        fields = F.array_distinct(F.regexp_extract_all(out, F.lit(field), F.lit(1)))
        out = F.aggregate(
            fields,
            out,
            lambda text, digits: F.replace(
                text,
                F.concat(F.lit("{%s:." % name), digits, F.lit("f}")),
                fixed_decimals(value, digits.cast("int")),
            ),
        )
    return out


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def metrics_line(metrics: Column, prefix: str | None = None) -> Column:
    """``Name: 0.1234`` of an array of (name, value) structs, joined by commas."""
    head = F.lit(f"{prefix} " if prefix else "")
    return F.array_join(
        F.transform(
            metrics,
            lambda m: F.concat(
                head, capitalised(m["name"]), F.lit(": "), fixed_decimals(m["value"], 4)
            ),
        ),
        ", ",
    )


def object_url_parts(url: Column, scheme: str = "s3://") -> list[Column]:
    """Bucket, key and base name of an object address."""
    path = F.replace(url, F.lit(scheme), F.lit(""))
    slash = F.instr(path, "/")
    key = F.when(slash > 0, F.substring(path, slash + F.lit(1), F.length(path)))
    return [
        F.when(slash > 0, F.substring(path, F.lit(1), slash - F.lit(1))).alias("bucket"),
        key.alias("key"),
        F.substring_index(key, "/", -1).alias("base_name"),
    ]


def char_token_ratio(text: Column, ids: Column) -> Column:
    ratio = F.length(text) / F.nullif(F.size(ids), F.lit(0))
    return fixed_decimals(ratio, 2).cast("double")


def string_inner(literal: Column) -> Column:
    return F.substring(literal, F.lit(2), F.greatest(F.length(literal) - 2, F.lit(0)))


def comment_inner(literal: Column) -> Column:
    return F.when(
        F.startswith(literal, F.lit("//")), F.substring(literal, F.lit(3), F.length(literal))
    ).otherwise(string_inner(literal))


def tokens_of_type(tokens: Column, name: str) -> Column:
    """Literals of the tokens of one kind, in order."""
    return F.transform(F.filter(tokens, lambda t: t["tok_name"] == name), lambda t: t["literal"])
