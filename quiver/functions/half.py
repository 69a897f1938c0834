"""Half-precision vectors, two bytes an element in one binary column.

Whole Arrow buffers are converted at once; nothing runs row by row. The element
type and the dimension stand in the column's metadata, which Parquet keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what the metadata of a packed column says.
ELEMENT = "float16"


def _ends(lengths: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)))).astype(np.int32)


def _halved(v: pa.Array) -> np.ndarray:
    """All elements of the lists as float16; a null element is no number."""
    with np.errstate(over="ignore"):                          # beyond the range: infinite, as the format has it
        return v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float16)


def pack_lists(v: pa.Array) -> pa.Array:
    """Lists of numbers -> binary; null lists stay null."""
    valid = None if v.null_count == 0 else pc.is_valid(v).buffers()[1]
    ends = _ends(pc.list_value_length(v)) * 2
    return pa.Array.from_buffers(pa.binary(), len(v), [valid, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(_halved(v))])


def unpack_lists(v: pa.Array) -> pa.Array:
    """Binary of :func:`pack_lists` -> lists of float."""
    kind = np.int64 if pa.types.is_large_binary(v.type) else np.int32
    buffers = v.buffers()
    at = np.frombuffer(buffers[1], kind)[v.offset: v.offset + len(v) + 1] if len(v) else np.zeros(1, kind)
    data = np.frombuffer(buffers[2], np.uint8)[at[0]: at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    values = np.frombuffer(data.tobytes(), np.float16).astype(np.float32)
    ends = ((at - at[0]) // 2).astype(np.int32)
    mask = pc.is_null(v) if v.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=mask)


@F.arrow_udf(T.BinaryType())
def _packed(v: pa.Array) -> pa.Array:
    return pack_lists(v)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unpacked(v: pa.Array) -> pa.Array:
    return unpack_lists(v)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _rounded(v: pa.Array) -> pa.Array:
    values = pa.array(_halved(v).astype(np.float32))
    return pa.ListArray.from_arrays(pa.array(_ends(pc.list_value_length(v))), values, mask=pc.is_null(v) if v.null_count else None)


def rounded(vec: Column) -> Column:
    """The vector as half precision has it, back as floats (round to nearest, ties to even)."""
    return _rounded(vec)


def with_packed(df: DataFrame, column: str) -> DataFrame:
    """``column`` (lists of numbers of one length) packed; the length is in its metadata. Ragged vectors are an error."""
    sizes = df.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"ragged vectors: sizes {sizes['least']}..{sizes['most']}")
    about = {"element": ELEMENT, "dim": sizes["most"] or 0}
    return df.select(*[_packed(F.col(c)).alias(c, metadata=about) if c == column else F.col(c) for c in df.columns])


def is_packed(df: DataFrame, column: str) -> bool:
    field = df.schema[column]
    return isinstance(field.dataType, T.BinaryType) and field.metadata.get("element") == ELEMENT


def unpacked(df: DataFrame, column: str) -> Column:
    """The vectors of a packed column; a value of another length than the column's dimension is an error."""
    wide = 2 * df.schema[column].metadata["dim"]
    whole = F.when(F.octet_length(column) == wide, F.col(column)).when(F.col(column).isNotNull(), F.raise_error(
        F.concat(F.lit(f"a vector of {wide} bytes expected, found "), F.octet_length(column).cast("string"))).cast("binary"))
    return _unpacked(whole)
