"""Result files in several versions, settings, and tables that are written anew as a whole."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


# --- settings and texts ----------------------------------------------------------


def setting(spark: SparkSession, name: str, env_file: str | None = None, required: bool = False) -> str:
    """A setting from the session's configuration, the environment, or a file of NAME=value lines on the driver;
    empty if there is none, an error if it is required."""
    found = spark.conf.get(f"spark.glyphtrail.{name}", None) or os.environ.get(name, "").strip()
    if not found and env_file:
        lines = [v.strip() for v in Path(env_file).read_text(encoding="utf-8").splitlines()]
        found = next((v.split("=", 1)[1].strip().strip("\"'") for v in lines if v.startswith(f"{name}=")), "")
    if required and not found:
        raise KeyError(f"{name} is not set: give it in the environment or in a settings file")
    return found or ""


def answer_text(spark: SparkSession, path: str | None = None, text: str | None = None, generate: Callable[[], str] | None = None) -> str:
    """The answer to trace, from the first source given: a file, the text itself, or a generator. Blank is refused."""
    if path is not None:
        found = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    elif text is not None:
        found = text
    elif generate is not None:
        found = generate()
    else:
        raise ValueError("give a file, a text or a generator")
    if not found.strip():
        raise ValueError("the answer is empty")
    return found


def text_column(df: DataFrame, name: str) -> Column:
    """A column as text, by the table's own schema: strings as they are, anything else as JSON."""
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, StringType) else F.to_json(F.col(name))


# --- versions of a summary ---------------------------------------------------------


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def latest(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The path of the first of ``names`` (newest version first) that is in ``folder``."""
    for name in names:
        if _there(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def load_json(spark: SparkSession, path: str) -> Any:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


class Summary:
    """A summary of any version: newer ones count prompts by condition, older ones per model."""

    def __init__(self, data: Mapping[str, Any]):
        self.data = data
        self.by_condition = "n_prompts" in data

    def conditions(self) -> list[str]:
        return list(self.data["n_prompts"]) if self.by_condition else ["advice", "factual"]

    def prompts(self, model: str, condition: str) -> int:
        return int(self.data["n_prompts"][condition] if self.by_condition else self._model(model)[f"n_{condition}"])

    def _model(self, model: str) -> Mapping[str, Any]:
        return self.data["per_model"][model]

    def _either(self, model: str, new: str, old: str) -> Any:
        block = self._model(model)
        return block[new] if block.get(new) else block[old]

    def rates(self, model: str) -> Any:
        return self._either(model, "condition_emission", "emission_rate")

    def rates_by_threshold(self, model: str) -> Any:
        return self._either(model, "condition_emission_by_threshold", "emission_rate_by_threshold")

    def stagewise(self, model: str) -> Any:
        return self._model(model).get("stagewise_emission")


def corrected(value: Any, draws: int = 10_000, key: str = "perm_p") -> Any:
    """A result of nested lists and maps in which each ``key``, a share of ``draws``, counts the
    observed order as one draw more."""
    if isinstance(value, Mapping):
        return {k: (round(v * draws) + 1) / (draws + 1) if k == key and v is not None else corrected(v, draws, key) for k, v in value.items()}
    return [corrected(v, draws, key) for v in value] if isinstance(value, list) else value


# --- whole tables ------------------------------------------------------------------


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes ``path`` anew, though ``df`` may be read from it: beside it first, then by two renames, so that
    a whole version, old or new, is there at any time, as ``path`` or as ``path`` with -old behind it."""
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fresh, old = make(f"{path}-new"), make(f"{path}-old")
    df.write.mode("overwrite").format(kind).save(f"{path}-new")
    if fs.exists(make(path)):
        fs.delete(old, True)
        fs.rename(make(path), old)
    fs.rename(fresh, make(path))
    fs.delete(old, True)


def spilled(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to disk and read again, for use by several later steps."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- models given by the caller -----------------------------------------------------


def generated(prompts: DataFrame, make: Callable[[list[str], list[int]], list[str]], batch: int = 8, base_seed: int = 1000) -> DataFrame:
    """``prompts`` (prompt, seed, ...) with ``answer``, by a function of prompts and seeds that runs on
    executors; its batches are fixed by the order in a partition."""
    schema = StructType(list(prompts.schema.fields)).add("answer", "string")

    def run(parts):
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                out += make(list(rows["prompt"]), [base_seed + int(s) for s in rows["seed"]])
            yield part.assign(answer=out)

    return prompts.mapInPandas(run, schema)


def encoded(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], column: str = "text") -> DataFrame:
    """``texts`` with ``vec``: vectors of unit length by a function that runs on executors, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(encode(list(v)))

    raw = texts.withColumn("_v", run(F.col(column)))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("_n", length).withColumn("vec", F.transform("_v", lambda x: F.try_divide(x, F.col("_n")))).drop("_v", "_n")
