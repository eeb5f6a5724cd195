"""Golden sets, traces, evaluation reports and settings."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema

_CASE = "query string, user_input string, reference string, expected_chunk_ids array<string>, expected_sources array<string>, reference_contexts array<string>, persona_name string, query_style string, query_length string"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a .jsonl file, of a JSON array, or of an object with test_cases; a bad line fails the job."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema(_CASE).json(path, mode="FAILFAST")
    else:
        whole = spark.read.text(path, wholetext=True)
        cases = F.from_json("value", f"array<struct<{_CASE.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})
        listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.test_cases"))
        rows = whole.withColumn("value", listed).select(F.explode(cases).alias("c")).select("c.*")
    return rows.withColumn("query", F.coalesce("query", "user_input")).select(*schema.struct(schema.GOLDEN).fieldNames())


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema.TRACES).json(path, mode="DROPMALFORMED").filter("trace_id is not null")


def append_traces(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def reports(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Evaluation reports (eval_*.json), newest file first."""
    rows = spark.read.schema(columns).option("pathGlobFilter", "eval_*.json").option("multiLine", True).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).orderBy(F.desc("modified"))


def report_history(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).json(path, mode="DROPMALFORMED")


def write_cases(rows: DataFrame, path: str) -> None:
    """Test cases as JSON lines, fields in order and null where missing."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


@dataclass(frozen=True)
class Retrieval:
    dense_top_k: int = 20
    sparse_top_k: int = 20
    fusion_top_k: int = 10
    rrf_k: int = 60


@dataclass(frozen=True)
class Splitting:
    splitter: str = "recursive"
    chunk_size: int = 1000
    chunk_overlap: int = 200


@dataclass(frozen=True)
class Reranking:
    enabled: bool = False
    provider: str = "none"
    top_k: int = 5
    pool_multiplier: int = 2


@dataclass(frozen=True)
class Model:
    provider: str = "none"
    model: str = ""
    address: str = ""
    dimensions: int = 0


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = Retrieval()
    splitting: Splitting = Splitting()
    reranking: Reranking = Reranking()
    embedding: Model = Model("hashing", dimensions=256)
    llm: Model = Model()
    vision: Model = Model()


#: What a setting may be.
CHOICES = {"splitting.splitter": ("recursive",), "reranking.provider": ("none", "cross_encoder", "llm")}


def settings(source: dict[str, Any] | str) -> Settings:
    """Settings of a nested dict, or of a JSON or YAML file; unknown names, wrong types and choices are errors."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as file:
            source = _yaml(file.read()) if source.lower().endswith((".yaml", ".yml")) else json.load(file)
    if not isinstance(source, dict) or any(not isinstance(v, dict) for v in source.values() if v is not None):
        raise ValueError("settings are sections of names and values")
    parts = {f.name: f.default for f in fields(Settings)}
    for section, values in source.items():
        if section not in parts:
            raise ValueError(f"no section {section!r} in settings")
        known = {f.name: type(f.default) for f in fields(parts[section])}
        for name, value in (values or {}).items():
            place = f"{section}.{name}"
            if name not in known:
                raise ValueError(f"no setting {section}.{name}")
            if not isinstance(value, known[name]) or (place in CHOICES and value not in CHOICES[place]):
                raise ValueError(f"{section}.{name} can't be {value!r}")
        parts[section] = replace(parts[section], **(values or {}))
    return Settings(**parts)


def _yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml package") from missing
    return yaml.safe_load(text) or {}


def cards(spark: SparkSession, held: Settings) -> DataFrame:
    """component, provider, model and details (JSON) of each part of a library; vision only where there is one."""
    r, s, rr = held.retrieval, held.splitting, held.reranking
    rows = [("llm", held.llm.provider, held.llm.model, {}), ("embedding", held.embedding.provider, held.embedding.model, {"dimensions": held.embedding.dimensions})]
    rows.append(("retrieval", "hybrid", "dense + sparse + RRF", {"dense_top_k": r.dense_top_k, "sparse_top_k": r.sparse_top_k, "fusion_top_k": r.fusion_top_k}))
    rows.append(("reranking", rr.provider if rr.enabled else "disabled", "-", {"enabled": rr.enabled, "top_k": rr.top_k}))
    if held.vision.provider != "none":
        rows.append(("vision", held.vision.provider, held.vision.model, {}))
    rows.append(("splitting", s.splitter, "-", {"chunk_size": s.chunk_size, "chunk_overlap": s.chunk_overlap}))
    return spark.createDataFrame([(*x[:3], json.dumps(x[3])) for x in rows], "component string, provider string, model string, details string")


class JsonLines(logging.Formatter):
    """A log record as one JSON object on a line: timestamp, level, logger, message, what the caller added, exception."""

    OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        shown = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        shown = {k: v for k, v in vars(record).items() if k not in self.OWN} | shown
        if record.exc_info and record.exc_info[0]:
            shown["exception"] = self.formatException(record.exc_info)
        return json.dumps(shown, ensure_ascii=False, default=str)
