"""Prompt messages, prompt plans and recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import hex_to_unit, seeded_md5
from millrace.functions.text import strip_ws

# Wording of the user messages.
DESCRIBED_PROMPT = ("New Snippet. Description: ", " Package: ")
PACKAGE_PROMPT = "New Snippet. Package: "
# Chance of a test package, temperature range, responses per prompt.
TEST_SHARE = 0.2
PACKAGE_TEMPERATURE = (0.3, 1.2)
DESCRIBED_TEMPERATURE = (0.2, 0.6)
RESPONSES_PER_PROMPT = 2


def described_prompt(description: Column, package: Column) -> Column:
    return F.concat(F.lit(DESCRIBED_PROMPT[0]), description, F.lit(DESCRIBED_PROMPT[1]), package)


def package_prompt(package: Column) -> Column:
    return F.concat(F.lit(PACKAGE_PROMPT), package)


def temperature_range(described: bool) -> tuple[float, float]:
    """Range of the temperatures for prompts with a description, or with a package only."""
    return DESCRIBED_TEMPERATURE if described else PACKAGE_TEMPERATURE


def conversation(system: str, example_user: str, example_answer: str, user: Column) -> Column:
    """System text, one worked example, and the request."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system)),
        message("user", F.lit(example_user)),
        message("assistant", F.lit(example_answer)),
        message("user", user),
    )


def prompt_plan(draws: DataFrame, packages: list[str], seed, temperature=PACKAGE_TEMPERATURE) -> DataFrame:
    """Package, test suffix and temperature for each row of ``draws`` (column ``draw``)."""
    digest = F.col("_md5")
    which = F.floor(hex_to_unit(digest, 0) * len(packages)).cast("int")
    name = F.element_at(F.array(*[F.lit(p) for p in packages]), which + 1)
    low, high = temperature
    return draws.withColumn("_md5", seeded_md5(seed, F.col("draw"))).select(
        "draw",
        F.when(hex_to_unit(digest, 1) < 1 - TEST_SHARE, name)
        .otherwise(F.concat(name, F.lit("_test")))
        .alias("package"),
        (F.lit(low) + F.lit(high - low) * hex_to_unit(digest, 2)).alias("temperature"),
        F.lit(RESPONSES_PER_PROMPT).alias("n_samples"),
    )


def explode_choices(responses: DataFrame) -> DataFrame:
    """One trimmed sample per choice of each recorded response."""
    return responses.select("response_id", F.posexplode("choices").alias("choice", "content")).select(
        "response_id", "choice", strip_ws(F.col("content")).alias("sample")
    )
