"""Run folders as tables: fold catalogues and model sources.

``fold_folders`` is a Spark data source over a method folder with one partition per
``held-out-<speaker>`` folder. Planning lists names only; each folder's config and
model files are looked at in the task that reads it. A filter on ``speaker`` drops
folders before they become tasks, so a catalogue of thousands of runs is not opened
to look at one.

A fold needs a ``run_config.json`` (a JSON object) whose ``held_out_speaker``, if it
has one, is the folder's speaker, and a ``final-model`` folder of a known kind;
anything else raises and names the folder. Listing and reading go through the file
system of the path's scheme.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from vocalframe.functions.paths import FOLD_PREFIX
from vocalframe.sources import remote

# File and key names of run folders, the kinds, and the model that a run config without a name means.
RUN_CONFIG, MODEL_FOLDER = "run_config.json", "final-model"
ADAPTER_CONFIG, MODEL_CONFIG, BOTTLENECK_KEY = "adapter_config.json", "config.json", "bottleneck_adapter_dim"
ADAPTER, BOTTLENECK, FULL, PRETRAINED = "lora_adapter", "bottleneck_adapter", "whisper_finetuned", "whisper_pretrained"
DEFAULT_MODEL = "openai/whisper-small"
ALL_SPEAKERS = "all"

SCHEMA = "speaker string, fold_dir string, model_dir string, run_config string, model_type string, base_model string"


def json_object(uri: str) -> dict:
    value = json.loads(remote.read_text(uri))
    if not isinstance(value, dict):
        raise ValueError(f"expected a JSON object in {uri}")
    return value


def model_kind(folder: str) -> str:
    """The kind of a model folder, by its files."""
    names = {n for n, k in remote.children(folder) if k == "file"}
    if ADAPTER_CONFIG in names:
        return ADAPTER
    if MODEL_CONFIG in names:
        return BOTTLENECK if BOTTLENECK_KEY in json_object(f"{folder}/{MODEL_CONFIG}") else FULL
    raise ValueError(f"{folder} is neither a full checkpoint nor an adapter")


def source_kind(source: str) -> tuple[str, str | None]:
    """(kind, folder) of a model source: an existing folder's kind; a name that is no path is
    a pretrained model without a folder; a missing local path or a file raises."""
    path = os.path.expanduser(source) if source.startswith("~") else source
    found = remote.kind(path) if "://" in path or path.startswith(("/", ".", "~")) or os.path.exists(path) else "none"
    if found == "dir":
        return model_kind(path), path
    if found == "file":
        raise ValueError(f"model path is not a folder: {source}")
    if path.startswith(("/", "./", "../")) or "://" in path:
        raise ValueError(f"local model path does not exist: {source}")
    return PRETRAINED, None


def resolved_base(source: str, kind: str, folder: str | None, override: str | None) -> str:
    """The override, else what an adapter declares, else the source itself."""
    if override:
        return override
    if kind != ADAPTER:
        return source
    base = json_object(f"{folder}/{ADAPTER_CONFIG}").get("base_model_name_or_path")
    if not base:
        raise ValueError(f"adapter {folder} does not declare base_model_name_or_path; give a base model")
    return str(base)


@dataclass
class Fold(InputPartition):
    speaker: str
    folder: str


class FoldReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.requested = json.loads(options.get("speakers", "[]"))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if isinstance(x, (EqualTo, In)) and x.attribute == ("speaker",):
                self.filters.append(x)
            else:
                yield x

    def _wanted(self, speaker: str) -> bool:
        if self.requested and speaker not in self.requested:
            return False
        return all(speaker == x.value if isinstance(x, EqualTo) else speaker in x.value for x in self.filters)

    def partitions(self) -> list[Fold]:
        if remote.kind(self.root) != "dir":
            raise ValueError(f"method folder does not exist: {self.root}")
        names = [n[len(FOLD_PREFIX):] for n, k in remote.children(self.root) if k == "dir" and n.startswith(FOLD_PREFIX)]
        if missing := sorted(set(self.requested) - set(names)):
            raise ValueError(f"requested speakers are missing from {self.root}: {', '.join(missing)}")
        if not names:
            raise ValueError(f"no {FOLD_PREFIX}* models found in {self.root}")
        return [Fold(n, f"{self.root}/{FOLD_PREFIX}{n}") for n in names if self._wanted(n)]

    def read(self, partition: Fold) -> Iterator[tuple]:
        at, speaker = partition.folder, partition.speaker
        if remote.kind(f"{at}/{RUN_CONFIG}") != "file":
            raise ValueError(f"missing {RUN_CONFIG} for fold: {at}")
        if remote.kind(f"{at}/{MODEL_FOLDER}") != "dir":
            raise ValueError(f"missing {MODEL_FOLDER} for fold: {at}")
        config = json_object(f"{at}/{RUN_CONFIG}")
        configured = str(config.get("held_out_speaker", speaker)).strip()
        if configured != speaker:
            raise ValueError(f"fold folder says {speaker!r}, but {at}/{RUN_CONFIG} says {configured!r}")
        model = f"{at}/{MODEL_FOLDER}"
        base = str((config.get("parameters") or {}).get("model_name") or DEFAULT_MODEL)
        yield speaker, at, model, json.dumps(config, ensure_ascii=False), model_kind(model), base


class FoldSource(DataSource):
    """``spark.read.format("fold_folders").load(method_dir)``; option ``speakers``: a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "fold_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FoldReader:
        return FoldReader(self.options)


def fold_catalogue(spark: SparkSession, method_dir: str, speakers: Sequence[str] | None = None) -> DataFrame:
    """A row per fold: speaker, fold_dir, model_dir, run_config (JSON), model_type, base_model.
    Filters on ``speaker`` reach the source. What is wrong with a fold raises when it is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FoldSource)
    return spark.read.format("fold_folders").option("speakers", json.dumps(list(speakers or []))).load(method_dir)


def model_sources(df: DataFrame, source: Column, override: Column | None = None) -> DataFrame:
    """S7 + S8 for a table of model sources: ``df`` with model_type, model_dir (null for a pretrained
    name) and base_model. Folders are looked at in tasks; a bad source raises and is named; a null
    source gives nulls."""
    @F.arrow_udf("struct<model_type:string,model_dir:string,base_model:string>")
    def look(sources: pa.Array, overrides: pa.Array) -> pa.Array:
        out = []
        for s, o in zip(sources.to_pylist(), overrides.to_pylist()):
            if s is None:
                out.append(None)
                continue
            kind, folder = source_kind(s)
            out.append({"model_type": kind, "model_dir": folder, "base_model": resolved_base(s, kind, folder, o)})
        return pa.array(out, pa.struct([("model_type", pa.string()), ("model_dir", pa.string()), ("base_model", pa.string())]))

    made = df.withColumn("_model", look(source.cast("string"), (F.lit(None) if override is None else override).cast("string")))
    return made.select(*df.columns, "_model.model_type", "_model.model_dir", "_model.base_model")


def single_model(spark: SparkSession, source: str, held_out_speaker: str | None = None, base_model: str | None = None) -> DataFrame:
    """A catalogue of one model that is no fold: the columns of ``fold_catalogue``. A folder's
    ``fold_dir`` is its parent; a pretrained name has ``.``."""
    kind, folder = source_kind(source)
    where = folder.rstrip("/") if folder else source
    parent = where.rsplit("/", 1)[0] if folder and "/" in where else "."
    row = (held_out_speaker or ALL_SPEAKERS, parent, where, "{}", kind, resolved_base(source, kind, folder, base_model))
    return spark.createDataFrame([row], SCHEMA)


def write_run_folders(folds: DataFrame, method_dir: str) -> DataFrame:
    """Write a run folder per row (speaker, run_config, files), ``files`` mapping names in the model
    folder to their text; returns the number of folders per task. A rewritten folder is the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for r in batch.to_pylist():
                at = f"{method_dir}/{FOLD_PREFIX}{r['speaker']}"
                for name, text in r["files"]:
                    remote.write_text(f"{at}/{MODEL_FOLDER}/{name}", text)
                remote.write_text(f"{at}/{RUN_CONFIG}", r["run_config"])
                n += 1
        yield pa.RecordBatch.from_pydict({"folders": pa.array([n], pa.int64())})

    return folds.select("speaker", "run_config", "files").mapInArrow(run, "folders bigint")
