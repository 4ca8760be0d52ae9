"""Structured log events of a run: JSON lines that Spark reads back."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
CATEGORIES = ("data", "detrend", "spectrum", "selection", "fit", "projection", "output", "search")
SCHEMA = "timestamp timestamp, run_id string, level string, category string, function string, message string, elapsed_seconds double, ticker string, timeframe string, context map<string,string>"


class RunLog:
    """Writes one JSON object a line to a handler of the standard library; values of context become text."""

    def __init__(self, run_id: str, handler: logging.Handler, level: str = "INFO"):
        if level not in LEVELS:
            raise ValueError(f"unknown level: {level}")
        self.run_id, self.level = run_id, level
        self.logger = logging.Logger(f"periodica.{run_id}")
        handler.setFormatter(logging.Formatter("%(message)s"))
        self.logger.addHandler(handler)

    def event(self, level: str, category: str, function: str, message: str, elapsed_seconds: float | None = None, ticker: str | None = None, timeframe: str | None = None, **context) -> None:
        if level not in LEVELS or category not in CATEGORIES:
            raise ValueError(f"unknown level or category: {level}, {category}")
        if LEVELS.index(level) < LEVELS.index(self.level):
            return
        row = {"timestamp": datetime.now(timezone.utc).isoformat(), "run_id": self.run_id, "level": level, "category": category, "function": function, "message": message, "elapsed_seconds": elapsed_seconds, "ticker": ticker, "timeframe": timeframe, "context": {k: str(v) for k, v in context.items()}}
        self.logger.log(getattr(logging, level), json.dumps(row))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
