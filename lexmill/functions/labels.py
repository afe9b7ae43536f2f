"""Label mapping, standardisation and names as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T

from lexmill.functions.text import strip

# Spellings of the two classes in raw string labels.
POSITIVE = ("positive", "pos", "1", "good")
NEGATIVE = ("negative", "neg", "0", "bad")
NEUTRAL = ("neutral",)

# Names a classifier may give its positive class.
POSITIVE_NAMES = ("positive", "pos", "label_1")
# Classifier output names and the names shown for them.
SHOWN_AS_NEGATIVE = ("LABEL_0", "NEGATIVE")
SHOWN_AS_POSITIVE = ("LABEL_1", "POSITIVE")


def map_label(label: Column, mapping: Mapping) -> Column:
    """Mapped label of a numeric column, NULL where the mapping has no entry.

    Keys may be ints or numeric strings. 1.0 is the key 1, but 1.5 is no key.
    """
    if not mapping:
        return F.lit(None).cast("long")
    pairs = [F.lit(int(part)).cast("long") for item in mapping.items() for part in item]
    whole = label.try_cast("long")
    return F.when(whole == label, F.try_element_at(F.create_map(*pairs), whole))


def standardize_string_label(label: Column) -> Column:
    key = strip(F.lower(label))
    number = F.when(key.rlike(r"\A[+-]?[0-9]+\z"), key.try_cast("long"))
    return (
        F.when(key.isin(*POSITIVE), 1)
        .when(key.isin(*NEGATIVE), 0)
        .when(key.isin(*NEUTRAL), F.lit(None).cast("long"))
        .otherwise(number)
    )


def standardize_int_label(label: Column) -> Column:
    """0 and 1 stay, 2 is neutral (NULL), larger values are positive, smaller ones negative."""
    return (
        F.when(label.isNull() | (label == 2), F.lit(None).cast("int"))
        .when(label == 1, 1)
        .when(label > 2, 1)
        .otherwise(0)
    )


def standardize_float_label(label: Column) -> Column:
    """Above one half is positive. NaN compares as greater in Spark, so it is tested first."""
    return (
        F.when(label.isNull(), F.lit(None).cast("int"))
        .when(F.isnan(label), 0)
        .when(label > 0.5, 1)
        .otherwise(0)
    )


def standardize_variant_label(label: Column) -> Column:
    """Every value by its own type: strings, whole numbers and fractions by their rules, truth values as 1 and 0.

    A number written with a fraction is a float, so 2 is neutral and 2.0 positive. Lists, objects,
    dates and missing values are NULL.
    """
    kind = F.schema_of_variant(label)
    read = lambda type_: F.try_variant_get(label, "$", type_)
    return (
        F.when(kind == "STRING", standardize_string_label(read("string")))
        .when(kind == "BIGINT", standardize_int_label(read("bigint")))
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), standardize_float_label(read("double")))
        .when(kind == "BOOLEAN", read("boolean").cast("int"))
    )


def standardize_label(label: Column, dtype: T.DataType) -> Column:
    """Binary label, NULL for neutral and unknown values, by the type of the raw label."""
    if isinstance(dtype, T.StringType):
        return standardize_string_label(label)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return standardize_int_label(label)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return standardize_float_label(label)
    if isinstance(dtype, T.VariantType):
        return standardize_variant_label(label)
    raise TypeError(f"cannot standardise labels of type {dtype.simpleString()}")


def label_id(name: Column) -> Column:
    """1 for a name of the positive class, else 0."""
    return F.when(F.lower(name).isin(*POSITIVE_NAMES), 1).otherwise(0)


def label_name(label: Column) -> Column:
    return F.when(label == 1, "positive").otherwise("negative")


def shown_name(name: Column) -> Column:
    """Classifier output name as shown to a reader; other names pass unchanged."""
    return (
        F.when(name.isin(*SHOWN_AS_NEGATIVE), "negative")
        .when(name.isin(*SHOWN_AS_POSITIVE), "positive")
        .otherwise(name)
    )
