"""Inverted indexes of given tables, made at their first use in a session and read from then on."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import inverted
from plumbline.sources.shared import _file, scratch

_made: dict[tuple, inverted.Index] = {}
_lock = threading.Lock()


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when the table at path is written anew."""
    fs, target = _file(spark, path)
    status, sizes = fs.getFileStatus(target), fs.getContentSummary(target)
    return status.getModificationTime(), sizes.getLength(), sizes.getFileCount()


def index_of(spark: SparkSession, path: str, make: Callable[[], DataFrame], key: str, text: str = "text", name: str = "index") -> inverted.Index:
    """The index of make(), which reads the table at path; made anew once the table has changed."""
    own = (spark.sparkContext.applicationId, path, name, key, text)
    with _lock:
        now = _state(spark, path)
        if own not in _made or _made[own][0] != now:
            _made[own] = now, inverted.keep(inverted.build(make(), key, text), scratch(spark, name))
        return _made[own][1]
