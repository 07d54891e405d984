"""Column roles and declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Names of the metadata columns and the types of the prediction table.
META_COLUMNS = ("is_attack", "attack_family", "attack_type", "device_id")

# Decay windows of the feature names, in their customary order.
WINDOWS = ("L5", "L3", "L1", "L0.1", "L0.01")

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("device_id", T.IntegerType()),
        T.StructField("score", T.FloatType()),
        T.StructField("y_true", T.ByteType()),
        T.StructField("y_pred", T.ByteType()),
        T.StructField("attack_family", T.StringType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("is_attack", T.BooleanType()),
    ]
)


def feature_columns(df: DataFrame, extra_meta: tuple[str, ...] = ()) -> list[str]:
    """Every column that is not metadata, in file order; none at all is an error."""
    skipped = {*META_COLUMNS, *extra_meta}
    found = [c for c in df.columns if c not in skipped]
    if not found:
        raise ValueError("the table has no feature columns")
    return found


def _windows_pattern() -> str:
    return "_(" + "|".join(w.replace(".", "\\.") for w in WINDOWS) + ")_"


def feature_window(name: Column) -> Column:
    """Decay window token of a feature name, null when there is none."""
    token = F.regexp_extract(name, _windows_pattern(), 1)
    return F.when(token != "", token)


def base_feature(name: Column) -> Column:
    """Feature name with its window token taken out."""
    return F.regexp_replace(name, _windows_pattern(), "_")
