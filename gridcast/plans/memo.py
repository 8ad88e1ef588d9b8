"""Results kept between runs: a frame computed once is read back as long as its plan and its input files are the same.

An entry is a table in a folder whose name holds the caller's name for it and a key: the plan in canonical form (names of
columns and expressions, not the numbers that a session gives them) with its semantic hash, the result's schema, and of every input
file the path, size and time of change. Another query, another parameter or a changed, added or removed file gives
another key. An entry counts once it is written whole; runs that write the same one at the same time do no harm. The store
never reads data to find a key, only the files' facts, which are summed where they are listed.

A plan with random or current-time parts is computed anew each time and not kept. So is what comes from memory instead of files:
its key holds for the session at most.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MOMENT = re.compile(r"\b(current_(date|timestamp|time)|localtimestamp|now)\b", re.IGNORECASE)
_PATTERN_CHARACTERS = re.compile(r"([\\*?\[\]{}])")
_LONG_TEXT = "spark.sql.debug.maxToStringFields"


class ResultStore:
    """Tables under ``root``, a folder that every executor reaches and that outlives the session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def fetch(self, df: DataFrame, name: str) -> tuple[DataFrame, bool]:
        """The stored result of ``df``, and whether it was there already."""
        key = self.key(df)
        if key is None:
            return df, False
        folder = f"{self.root}/{name}-{key}"
        path = self._written(folder)
        known = path is not None
        if not known:
            path = f"{folder}/attempt-{uuid.uuid4().hex}"
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), known

    def key(self, df: DataFrame) -> str | None:
        """What a result depends on, as text for a folder's name; none if it may differ from run to run."""
        plan = df._jdf.queryExecution().analyzed()
        before = self.spark.conf.get(_LONG_TEXT)
        self.spark.conf.set(_LONG_TEXT, str(2 ** 30))
        try:
            text = plan.canonicalized().toString()
        finally:
            self.spark.conf.set(_LONG_TEXT, before)
        if not plan.deterministic() or _MOMENT.search(text):
            return None
        parts = [text, str(df.semanticHash()), df.schema.json(), self._file_facts(df)]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:40]

    def prune(self, name: str, keep: int = 1) -> int:
        """Remove all but the ``keep`` entries of this name that were written last; how many went."""
        system, path = self._place(f"{self.root}/{name}-*")
        entries = [e for e in system.globStatus(path) or [] if re.fullmatch(re.escape(name) + "-[0-9a-f]{40}", e.getPath().getName())]
        entries.sort(key=lambda e: e.getModificationTime(), reverse=True)
        for entry in entries[keep:]:
            system.delete(entry.getPath(), True)
        return len(entries[keep:])

    def _file_facts(self, df: DataFrame) -> str:
        files = [_PATTERN_CHARACTERS.sub(r"\\\1", unquote(f)) for f in df.inputFiles()]
        if not files:
            return ""
        listed = self.spark.read.format("binaryFile").load(files)
        each = F.xxhash64("path", "modificationTime", "length")
        # Free of order, and of the contents, which are not read.
        row = listed.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(each).alias("mixed"), F.sum(each.cast("decimal(38,0)")).alias("sum")).first()
        return f"{row['n']} {row['bytes']} {row['mixed']} {row['sum']}"

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _written(self, folder: str) -> str | None:
        system, path = self._place(f"{folder}/attempt-*/_SUCCESS")
        found = sorted(f.getPath().getParent().toString() for f in system.globStatus(path) or [])
        return found[0] if found else None
