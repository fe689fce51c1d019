"""Model calls as row functions: a registry of providers, and columns that call one. The default is a deterministic stub."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[str], str]
_PROVIDERS: dict[str, Provider] = {}
FALLBACK = "stub"


def register_provider(name: str, call: Provider) -> None:
    _PROVIDERS[name] = call


def providers() -> list[str]:
    return sorted(_PROVIDERS)


def provider(name: str | None) -> Provider:
    """The named provider, else the fallback."""
    return _PROVIDERS.get(name or FALLBACK, _PROVIDERS[FALLBACK])


def stub(prompt: str) -> str:
    """An answer that depends on the prompt alone."""
    return f"译文：{hashlib.sha256(prompt.encode()).hexdigest()[:12]}"


register_provider(FALLBACK, stub)


# Parts of the names of models that read images.
VISION = ("vision", "-vl", "vl-", "vlm", "llava", "gpt-4o", "gemini", "claude-3")


def is_vision(model: Column) -> Column:
    """Whether a model reads images, from its name."""
    return F.coalesce(F.lower(model).rlike("|".join(VISION)), F.lit(False))


def env_overrides(configured: DataFrame, names: DataFrame, env: DataFrame) -> DataFrame:
    """Providers (id, api_key) with keys from the environment (name, value) in place of saved ones, and from_env.

    names (id, n, name) lists the variables of each provider in order of preference; PROVIDER_<ID>_API_KEY comes last.
    """
    known = env.select("name", F.trim("value").alias("value")).where("value <> ''")
    general = configured.select("id", F.lit(2**31 - 1).alias("n"), F.concat(F.lit("PROVIDER_"), F.upper("id"), F.lit("_API_KEY")).alias("name"))
    best = names.select("id", "n", "name").unionByName(general).join(known, "name").groupBy("id").agg(F.min_by("value", "n").alias("_key"))
    return configured.join(best, "id", "left").select("id", F.coalesce("_key", "api_key").alias("api_key"), F.col("_key").isNotNull().alias("from_env"))


def resolve_setting(*choices: Column) -> Column:
    """First choice that isn't blank: the task's, the document's, the general one, the fallback."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))


def call_model(prompt: Column, name: str | None = None, error_mark: str = "[翻译调用异常", workers: int = 1, tries: int = 1) -> Column:
    """A model's answer to each prompt. A call that fails `tries` times gives the error mark and its message, so one row doesn't fail the rest.

    Each task has at most `workers` calls in flight; the tasks that run at once (cores, or coalesce before the call) bound the rest.
    """
    run = provider(name)

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        def one(p):
            for left in range(tries - 1, -1, -1) if p is not None else ():
                try:
                    return run(p)
                except Exception as e:  # a provider may raise anything
                    if not left:
                        return f"{error_mark}: {e}]"

        with ThreadPoolExecutor(workers) as pool:
            return pd.Series(list(pool.map(one, prompts)), dtype=object)

    return ask(prompt)


def register_functions(spark: SparkSession) -> None:
    """Registers the default provider and the answer parser as SQL functions."""
    from lectern.functions.answers import translation

    spark.udf.register("parse_translation", translation)
    spark.udf.register("stub_model", F.pandas_udf(lambda p: p.map(stub), "string"))
