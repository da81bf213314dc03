"""A model server as a data source: spark.read.format("model_server").option("url", ...), a row a model.

    server.register(spark)
    spark.read.format("model_server").option("url", "http://host:11434").load()

The list of models, and of those that are loaded, is asked for once, where the query is planned; their details are asked
for by the tasks, a few models each. A model whose details fail is a row that says why, with whatever the list said; a
server that cannot be reached is one row with the error and no name. Options: url, timeout (seconds), each (models a
task), details (false: only the lists).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from ..verdicts import Refused
from .models import Config, base_url, request

SCHEMA = (
    "name string, size bigint, family string, parameter_size string, quantization string, modified string, running boolean, size_vram bigint, expires string, "
    "model_info map<string,string>, parameters string, capabilities array<string>, error string"
)
_KINDS = [
    ("name", pa.string()), ("size", pa.int64()), ("family", pa.string()), ("parameter_size", pa.string()), ("quantization", pa.string()), ("modified", pa.string()), ("running", pa.bool_()),
    ("size_vram", pa.int64()), ("expires", pa.string()), ("model_info", pa.map_(pa.string(), pa.string())), ("parameters", pa.string()), ("capabilities", pa.list_(pa.string())), ("error", pa.string()),
]


class Models(InputPartition):
    """The rows of the list that a task completes."""

    def __init__(self, rows: list[dict]):
        self.value, self.rows = len(rows), rows


class ModelReader(DataSourceReader):
    def __init__(self, options):
        self.config = Config(base_url(options.get("url")), timeout=float(options.get("timeout", 30)))
        self.each, self.details = max(1, int(options.get("each", 4))), str(options.get("details", "true")).lower() == "true"

    def partitions(self) -> list[Models]:
        try:
            found = request(self.config, "GET", "/api/tags").get("models") or []
            loaded = {m.get("name"): m for m in request(self.config, "GET", "/api/ps").get("models") or []}
        except Refused as e:
            return [Models([{"error": f"{e.verdict}: {e.error}"}])]
        rows = []
        for m in found:
            name, about = m.get("name") or m.get("model"), m.get("details") or {}
            there = loaded.get(name)
            rows.append({
                "name": name, "size": m.get("size"), "family": about.get("family"), "parameter_size": about.get("parameter_size"), "quantization": about.get("quantization_level"), "modified": m.get("modified_at"),
                "running": there is not None, "size_vram": (there or {}).get("size_vram"), "expires": (there or {}).get("expires_at"),
            })
        return [Models(rows[a : a + self.each]) for a in range(0, len(rows), self.each)] or [Models([])]

    def read(self, partition: Models) -> Iterator[pa.RecordBatch]:
        for row in partition.rows:
            if self.details and row.get("name"):
                try:
                    d = request(self.config, "POST", "/api/show", {"model": row["name"]})
                    caps = d.get("capabilities")
                    row |= {"model_info": [(k, str(v)) for k, v in (d.get("model_info") or {}).items()], "parameters": d.get("parameters"), "capabilities": [str(c) for c in caps] if isinstance(caps, list) else None}
                except Refused as e:
                    row["error"] = f"{e.verdict}: {e.error}"
            yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], k) for c, k in _KINDS], [c for c, _ in _KINDS])


class ModelServer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "model_server"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ModelServer)


def models(spark: SparkSession, url: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("model_server").options(url=url, **options).load()
