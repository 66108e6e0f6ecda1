"""Dealing packed arrays: many small records travel as a few binary columns for each bucket.

A record array is split by bucket number; each part becomes one row (bucket, kind, n, f0, f1, ...)
with one binary column per field. Spark shuffles these rows by bucket and a function over one
bucket's arrays handles them. Buckets are as many as the input needs for them to stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Layout:
    """Named fields with fixed numpy types, plus optionally one column of variable-length bytes."""

    def __init__(self, **fields: str):
        self.fields = fields

    @property
    def ddl(self) -> str:
        return "bucket int, " + ", ".join(f"{f} binary" for f in self.fields)

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([("bucket", pa.int32()), *[(f, pa.binary()) for f in self.fields]])

    def split(self, data: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
        """One row for each bucket that has records."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        at, ends = runs(b)
        cols = [pa.array(b[at].astype(np.int32), pa.int32())]
        for f, kind in self.fields.items():
            v = np.ascontiguousarray(data[f][order].astype(kind, copy=False))
            cols.append(pa.array([v[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)

    def join(self, rows) -> dict[str, np.ndarray]:
        """All records of some rows."""
        return {
            f: np.concatenate([np.frombuffer(x, kind) for x in rows.column(f).to_pylist() if x is not None] or [np.zeros(0, kind)])
            for f, kind in self.fields.items()
        }

    def empty(self) -> dict[str, np.ndarray]:
        return {f: np.zeros(0, kind) for f, kind in self.fields.items()}


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, int), np.zeros(0, int)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.append(at[1:], len(sorted_keys))


class MixedLayout(Layout):
    """Records of which fields of type "O" hold bytes of any length."""

    def split(self, data, bucket):
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        a, z = runs(b)
        cols = [pa.array(b[a].astype(np.int32), pa.int32())]
        for f, kind in self.fields.items():
            v = data[f][order]
            if kind == "O":
                parts = [b"".join(len(t).to_bytes(4, "little") + t for t in v[x:y]) for x, y in zip(a, z, strict=True)]
            else:
                parts = [np.ascontiguousarray(v[x:y].astype(kind)).tobytes() for x, y in zip(a, z, strict=True)]
            cols.append(pa.array(parts, pa.binary()))
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)

    def join(self, rows):
        out = {}
        for f, kind in self.fields.items():
            parts = [x for x in rows.column(f).to_pylist() if x is not None]
            if kind == "O":
                texts = []
                for p in parts:
                    at = 0
                    while at < len(p):
                        n = int.from_bytes(p[at : at + 4], "little")
                        texts.append(p[at + 4 : at + 4 + n])
                        at += 4 + n
                v = np.empty(len(texts), object)
                v[:] = texts
                out[f] = v
            else:
                out[f] = np.concatenate([np.frombuffer(p, kind) for p in parts] or [np.zeros(0, kind)])
        return out


class Gatherer:
    """Collects record arrays and yields dealt batches of about ``most`` records."""

    def __init__(self, layout: Layout, most: int = 400_000):
        self.layout, self.most, self.parts, self.n = layout, most, [], 0

    def add(self, data: dict[str, np.ndarray], bucket: np.ndarray):
        if len(bucket):
            self.parts.append((data, bucket))
            self.n += len(bucket)
        if self.n >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        data = {f: np.concatenate([p[0][f] for p in self.parts] or [np.zeros(0, k)]) for f, k in self.layout.fields.items()}
        bucket = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
        self.parts, self.n = [], 0
        return self.layout.split(data, bucket)
