"""What a table's columns mean.  Holds names only, never rows."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of one table.

    ``row_id`` names a unique, non-null column (or columns); every operator that draws, ranks or
    breaks ties uses it, so results never depend on how rows are partitioned.
    """

    features: tuple[str, ...]
    label: str | None = None
    row_id: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    mixed: dict[str, tuple[float, ...]] = field(default_factory=dict)
    general: tuple[str, ...] = ()

    @property
    def continuous(self) -> tuple[str, ...]:
        """Features that are not categorical."""
        return tuple(c for c in self.features if c not in self.categorical)

    def with_features(self, *features: str) -> "TableSpec":
        return replace(self, features=tuple(features))


class UnknownColumns(ValueError):
    """Raised before any job runs when a named column is not in the table."""


def validate_columns(df: DataFrame, cols) -> None:
    """Fail early, listing every column that the table lacks."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise UnknownColumns(f"columns not in the table: {', '.join(map(str, missing))}")


def infer_spec(df: DataFrame, label: str | None = None, row_id=(), categorical=None,
               mixed=None, general=()) -> TableSpec:
    """Continuous = every column that is neither categorical, label nor row id.

    Without an explicit list, string and boolean columns count as categorical.
    """
    row_id = (row_id,) if isinstance(row_id, str) else tuple(row_id)
    features = tuple(c for c in df.columns if c != label and c not in row_id)
    if categorical is None:
        categorical = tuple(f.name for f in df.schema.fields
                            if f.name in features and isinstance(f.dataType, (T.StringType, T.BooleanType)))
    validate_columns(df, [*row_id, *categorical, *([label] if label else [])])
    return TableSpec(features=features, label=label, row_id=row_id, categorical=tuple(categorical),
                     mixed=dict(mixed or {}), general=tuple(general))


def refuse_stream(df: DataFrame, operator: str) -> None:
    """Operators that need global ranks or counts are batch only."""
    if df.isStreaming:
        raise TypeError(f"{operator} needs the whole table and cannot run on a streaming DataFrame")
