"""Stored collections: a folder of Parquet versions for each. A version counts once its _SUCCESS file is there, so a swap is one rename.

Rows that are added later lie beside their version in deltas: v3d5-5 is the fifth of version 3. So many deltas of one width are folded into one
that stands for them (v3d1-16), so a read meets few folders, and a row is written again only once for each width. What was folded stays until its
version goes. There is one writer at a time; readers keep the files that they began with.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from docweave.sources.tables import read_parquet


class Store:
    def __init__(self, spark: SparkSession, folder: str, codec: str = "zstd", fold: int = 16):
        self.spark, self.folder, self.codec, self.fold = spark, folder.rstrip("/"), codec, fold

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def versions(self, name: str) -> list[int]:
        found = [int(m[1]) for n in self._names(f"{self.folder}/{name}") if (m := re.fullmatch(r"v(\d+)", n))]
        return sorted(v for v in found if self.exists(f"{self.folder}/{name}/v{v}/_SUCCESS"))

    def collections(self) -> list[str]:
        return [n for n in self._names(self.folder) if not n.startswith("_") and self.versions(n)]

    def deltas(self, name: str, version: int) -> list[tuple[int, int, str]]:
        """Complete deltas of a version that no wider one stands for, in order: the first and last write, and the folder."""
        found = [(int(m[1]), int(m[2]), f"{self.folder}/{name}/{n}") for n in self._names(f"{self.folder}/{name}") if (m := re.fullmatch(rf"v{version}d(\d+)-(\d+)", n))]
        out, last = [], 0
        for first, to, path in sorted(found, key=lambda d: (d[0], -d[1])):
            if first > last and self.exists(f"{path}/_SUCCESS"):
                out.append((first, to, path))
                last = to
        return out

    def read(self, name: str) -> DataFrame | None:
        versions = self.versions(name)
        if not versions:
            return None
        base = read_parquet(self.spark, f"{self.folder}/{name}/v{versions[-1]}")
        return self._joined(base, [path for _, _, path in self.deltas(name, versions[-1])])

    def _joined(self, base: DataFrame, paths: list[str]) -> DataFrame:
        """base and deltas, which have its schema."""
        return reduce(DataFrame.unionAll, [self.spark.read.schema(base.schema).parquet(p) for p in paths], base)

    def add(self, name: str, df: DataFrame) -> None:
        """Rows of the present version's schema as its next delta."""
        version = self.versions(name)[-1]
        known = self.deltas(name, version)
        place = known[-1][1] + 1 if known else 1
        path = lambda a, b: f"{self.folder}/{name}/v{version}d{a}-{b}"
        df.write.mode("overwrite").option("compression", self.codec).parquet(path(place, place))
        known.append((place, place, path(place, place)))
        while len(known) >= self.fold and len({b - a for a, b, _ in known[-self.fold:]}) == 1:
            run = known[-self.fold:]
            first, last = run[0][0], run[-1][1]
            rows = self._joined(self.spark.createDataFrame([], df.schema), [p for _, _, p in run])
            rows.coalesce(self.fold).write.mode("overwrite").option("compression", self.codec).parquet(path(first, last))
            known[-self.fold:] = [(first, last, path(first, last))]

    def write(self, name: str, df: DataFrame, keep: int = 2) -> DataFrame:
        """df as the next version; older ones than the last few go."""
        versions = self.versions(name)
        new = (versions[-1] if versions else 0) + 1
        df.write.mode("overwrite").option("compression", self.codec).parquet(f"{self.folder}/{name}/v{new}")
        for v in versions[: max(0, len(versions) + 1 - keep)]:
            for n in self._names(f"{self.folder}/{name}"):
                if n == f"v{v}" or n.startswith(f"v{v}d"):
                    self.remove(f"{name}/{n}")
        return read_parquet(self.spark, f"{self.folder}/{name}/v{new}")

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").option("compression", self.codec).parquet(f"{self.folder}/{name}")

    def remove(self, name: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.delete(p, True)

    def rename(self, name: str, to: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.rename(p, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{to}"))

    def size(self, name: str) -> int:
        """Bytes of the present version and its deltas."""
        versions = self.versions(name)
        if not versions:
            return 0
        paths = [f"{self.folder}/{name}/v{versions[-1]}", *[path for _, _, path in self.deltas(name, versions[-1])]]
        return sum(fs.getContentSummary(p).getLength() for fs, p in map(self._fs, paths))
