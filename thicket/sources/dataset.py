"""Datasets: a DataFrame with roles for its columns, and the ways to make one."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row"


class DatasetError(ValueError):
    """kind: empty_features, shape_mismatch, duplicate_index, unsorted_index or index_out_of_bounds."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def missing_to_null(c: Column) -> Column:
    """NaN and null are both missing; inside, missing is null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


#: categories up to which their codes are part of the plan; more are a joined table
MOST_INLINE = 1000


def coded(df: DataFrame, value: Column, values: Sequence) -> tuple[DataFrame, Column]:
    """(df, the place of the value among `values` as a double, null for others). Many values are a small table that df is joined with."""
    if len(values) <= MOST_INLINE:
        of = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(float(i)))])
        return df, F.try_element_at(of, value)
    key, code, asked = (f"_{name}_{uuid.uuid4().hex[:8]}" for name in ("key", "code", "asked"))
    kind = "string" if isinstance(values[0], str) else "double"
    codes = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(values)], f"{key} {kind}, {code} double")
    # the driver holds these values anyway; adaptive execution broadcasts them if their measured size allows
    joined = df.withColumn(asked, value).join(codes, F.col(asked) == F.col(key), "left").drop(key, asked)
    return joined, F.col(code)


@dataclass(frozen=True)
class Dataset:
    """df with feature columns in order (double, null where missing), an optional label and weight, and a row id.

    Categories are integers 0 .. K-1 stored as doubles; `categories` keeps the values they stand for.
    """

    df: DataFrame
    features: tuple[str, ...]
    categorical: frozenset[str] = frozenset()
    label: str | None = None
    weight: str | None = None
    categories: Mapping[str, tuple] = field(default_factory=dict)
    #: label columns of further outputs; built-in losses read `label`, the first
    more_labels: tuple[str, ...] = ()

    @property
    def n_outputs(self) -> int:
        return len(self.more_labels) + (1 if self.label else 0)

    @property
    def n_features(self) -> int:
        return len(self.features)

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    @classmethod
    def from_dataframe(cls, df: DataFrame, features: Sequence[str], label: str | None = None, weight: str | None = None, categorical: Sequence[str] = (), row: str | Column | None = None, categories: Mapping[str, Sequence] | None = None, more_labels: Sequence[str] = ()) -> Dataset:
        """Columns by their role. String, boolean and listed columns are categorical: their sorted values become 0 .. K-1, a missing value stays missing.

        categories: the encoding to use, as of a training set, instead of the values here; unknown values are missing.
        """
        if not features:
            raise DatasetError("empty_features", "a dataset needs at least one feature")
        lost = [c for c in (*features, *(x for x in (label, weight, *more_labels) if x)) if c not in df.columns]
        if lost:
            raise DatasetError("shape_mismatch", f"no such columns: {', '.join(lost)}")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        cats = {c for c in features if c in set(categorical) or isinstance(kinds[c], (T.StringType, T.BooleanType))}
        codes: dict[str, tuple] = {}
        given = categories or {}
        for c in (c for c in features if c in cats):
            if c in given:
                codes[c] = tuple(given[c])
            else:
                value = F.col(c) if isinstance(kinds[c], (T.StringType, T.BooleanType)) else missing_to_null(F.col(c))
                codes[c] = tuple(r[0] for r in df.select(value.alias("v")).where("v IS NOT NULL").distinct().orderBy("v").collect())
        columns = []
        for c in features:
            if c not in cats:
                columns.append(missing_to_null(F.col(c)).alias(c))
            elif not codes[c]:
                columns.append(F.lit(None).cast("double").alias(c))
            else:
                value = F.col(c) if isinstance(kinds[c], (T.StringType, T.BooleanType)) else missing_to_null(F.col(c))
                if codes[c] == tuple(float(i) for i in range(len(codes[c]))):
                    columns.append(F.when((value >= 0) & (value < len(codes[c])) & (value == F.floor(value)), value).alias(c))
                else:
                    df, code = coded(df, value, codes[c])
                    columns.append(code.alias(c))
        roles = [F.col(x).cast("double").alias(x) for x in (label, weight, *more_labels) if x and x not in features]
        # a row's own values name it, so that samples and splits are the same when the input is read again
        key = F.col(row) if isinstance(row, str) else row if row is not None else F.xxhash64(*[F.col(c) for c in dict.fromkeys([*features, *(x for x in (label, weight, *more_labels) if x)])])
        return cls(df.select(key.cast("long").alias(ROW), *columns, *roles), tuple(features), frozenset(cats), label, weight, codes, tuple(more_labels))

    @classmethod
    def from_numpy(cls, spark: SparkSession, x: np.ndarray, labels: np.ndarray | None = None, weights: np.ndarray | None = None, feature_names: Sequence[str] | None = None, categorical_features: Sequence[int] = ()) -> Dataset:
        """A [rows, features] matrix; labels of one dimension, or of two with the rows along either (of a square the second): the first output is the label, the others more_labels."""
        x = np.asarray(x, dtype=np.float64)
        if x.ndim != 2 or not x.shape[1]:
            raise DatasetError("empty_features", "a matrix with at least one column is needed")
        names = list(feature_names or [f"f{i}" for i in range(x.shape[1])])
        if len(names) != x.shape[1]:
            raise DatasetError("shape_mismatch", "as many names as columns are needed")
        data: dict[str, Any] = {ROW: np.arange(len(x)), **{n: x[:, i] for i, n in enumerate(names)}}
        for name, values in (("y", labels), ("w", weights)):
            if values is not None:
                v = np.atleast_2d(np.asarray(values, dtype=np.float64))
                v = v if v.shape[1] == len(x) else v.T
                if v.shape[1] != len(x) or (name == "w" and len(v) > 1):
                    raise DatasetError("shape_mismatch", f"{v.shape[1]} values of {name} for {len(x)} rows")
                data |= {name if i == 0 else f"{name}{i}": row for i, row in enumerate(v)}
        import pyarrow as pa

        df = spark.createDataFrame(pa.table({k: pa.array(v) for k, v in data.items()}))
        return cls.from_dataframe(df, names, "y" if labels is not None else None, "w" if weights is not None else None, [names[i] for i in categorical_features], row=ROW, more_labels=[n for n in data if n[:1] == "y" and n[1:].isdigit() and n not in names])

    @classmethod
    def from_long(cls, entries: DataFrame, features: Sequence[str], row: str = "row", feature: str = "feature", value: str = "value", rows: DataFrame | None = None, label: str | None = None, weight: str | None = None, default: float = 0.0, categorical: Sequence[str] = ()) -> Dataset:
        """A sparse matrix as a table of (row, feature, value): what has no entry is `default`; a null value is missing.

        One shuffle by row, combined before it; nothing is densified on the driver. rows: a table with the row id, label and
        weight, whose rows without entries count too; other rows of entries are left out. An entry that is there twice is an
        error, as is one of a feature that is not named.
        """
        odd = entries.groupBy(row, feature).count().where((F.col("count") > 1) | ~F.col(feature).isin(*features)).limit(1).collect()
        if odd:
            kind = "duplicate_index" if odd[0]["count"] > 1 else "index_out_of_bounds"
            raise DatasetError(kind, f"row {odd[0][0]} has {odd[0]['count']} entries of {odd[0][1]}")
        own = [F.col(feature) == f for f in features]
        there = [F.when(F.max(c), F.max(F.when(c, F.col(value).cast("double")))).otherwise(F.lit(float(default))).alias(f) for c, f in zip(own, features, strict=True)]
        wide = entries.groupBy(F.col(row).alias(ROW)).agg(*there)
        if rows is not None:
            roles = [c for c in (label, weight) if c]
            seen = wide.withColumn("_seen", F.lit(True))
            joined = rows.select(F.col(row).alias(ROW), *roles).join(seen, ROW, "left")
            wide = joined.select(ROW, *roles, *[F.when(F.col("_seen"), F.col(f)).otherwise(F.lit(float(default))).alias(f) for f in features])
        return cls.from_dataframe(wide, features, label, weight, categorical, row=ROW)

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf: Any, labels: Any = None, weights: Any = None, categorical: Sequence[str] = ()) -> Dataset:
        """Category, string, object and boolean columns are categorical."""
        frame, names = pdf.copy(), [str(c) for c in pdf.columns]
        frame.columns = names
        for c in names:
            if frame[c].dtype.name in ("category", "object", "str", "string"):
                frame[c] = frame[c].astype(object).where(frame[c].notna(), None).map(lambda v: v if v is None else str(v))
        for name, values in (("_y", labels), ("_w", weights)):
            if values is not None:
                if len(values) != len(frame):
                    raise DatasetError("shape_mismatch", f"{len(values)} values for {len(frame)} rows")
                frame[name] = np.asarray(values, dtype=np.float64)
        return cls.from_dataframe(spark.createDataFrame(frame), names, "_y" if labels is not None else None, "_w" if weights is not None else None, categorical)


class DatasetBuilder:
    """Columns added one by one from driver-side arrays, dense or sparse."""

    def __init__(self, spark: SparkSession):
        self.spark, self.columns, self.cats = spark, {}, []
        self.y = self.w = None

    def add_feature(self, values: Sequence[float], name: str | None = None, categorical: bool = False) -> DatasetBuilder:
        return self._add(np.asarray(values, dtype=np.float64), name, categorical)

    def add_categorical(self, values: Sequence[int], name: str | None = None) -> DatasetBuilder:
        return self.add_feature(values, name, True)

    def add_sparse(self, indices: Sequence[int], values: Sequence[float], n_samples: int, name: str | None = None, default: float = 0.0, categorical: bool = False) -> DatasetBuilder:
        """Values at strictly increasing indices, `default` elsewhere."""
        at = np.asarray(indices, dtype=np.int64)
        if len(at) != len(values):
            raise DatasetError("shape_mismatch", "as many values as indices are needed")
        if len(at) and (at.min() < 0 or at.max() >= n_samples):
            raise DatasetError("index_out_of_bounds", f"an index is not below {n_samples}")
        if (np.diff(at) == 0).any():
            raise DatasetError("duplicate_index", "an index is there twice")
        if (np.diff(at) < 0).any():
            raise DatasetError("unsorted_index", "indices must increase")
        dense = np.full(n_samples, float(default))
        dense[at] = values
        return self._add(dense, name, categorical)

    def add_features_from_array(self, x: np.ndarray, names: Sequence[str] | None = None) -> DatasetBuilder:
        for i, column in enumerate(np.asarray(x, dtype=np.float64).T):
            self._add(column, names[i] if names else None, False)
        return self

    def add_features_from_dict(self, columns: Mapping[str, Any], n_samples: int | None = None) -> DatasetBuilder:
        """name -> values, or (indices, values) with n_samples."""
        for name, v in columns.items():
            if isinstance(v, tuple) and len(v) == 2:
                self.add_sparse(v[0], v[1], n_samples or self._rows(), name)
            else:
                self.add_feature(v, name)
        return self

    def add_features_from_sparse(self, matrix: Any, names: Sequence[str] | None = None) -> DatasetBuilder:
        """A column-compressed matrix: anything with shape, indptr, indices and data."""
        for i in range(matrix.shape[1]):
            a, b = matrix.indptr[i], matrix.indptr[i + 1]
            order = np.argsort(matrix.indices[a:b], kind="stable")
            self.add_sparse(matrix.indices[a:b][order], matrix.data[a:b][order], matrix.shape[0], names[i] if names else None)
        return self

    def labels(self, values: Sequence[float]) -> DatasetBuilder:
        self.y = np.asarray(values, dtype=np.float64)
        return self

    def weights(self, values: Sequence[float]) -> DatasetBuilder:
        self.w = np.asarray(values, dtype=np.float64)
        return self

    def build(self) -> Dataset:
        if not self.columns:
            raise DatasetError("empty_features", "a dataset needs at least one feature")
        if len({len(v) for v in self.columns.values()}) > 1:
            raise DatasetError("shape_mismatch", "features differ in length")
        names = list(self.columns)
        return Dataset.from_numpy(self.spark, np.stack([self.columns[n] for n in names], axis=1), self.y, self.w, names, [names.index(c) for c in self.cats])

    def _rows(self) -> int:
        return len(next(iter(self.columns.values()))) if self.columns else 0

    def _add(self, values: np.ndarray, name: str | None, categorical: bool) -> DatasetBuilder:
        key = name or f"f{len(self.columns)}"
        if self.columns and len(values) != self._rows():
            raise DatasetError("shape_mismatch", f"{key} has {len(values)} rows, not {self._rows()}")
        self.columns[key] = values
        if categorical:
            self.cats.append(key)
        return self
