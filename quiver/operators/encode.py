"""Batched encoding (user-supplied encoders), MLP fusion, half-precision storage.

Encoders run through ``predict_batch_udf``: Arrow batches go to a Python worker,
the model is built once per worker by ``make_encoder`` and sees fixed-size
batches. Each base modality is encoded once; the three modality views are then
derived with column expressions (gate, fuse), never by re-running the encoder.

No trained model ships with the engine, so a deterministic stand-in is provided:
signed feature hashing of the whole text (every whitespace token, no cut-off).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions import half
from quiver.operators import views
from quiver.session import spread

# Fixed values.
ENCODE_BATCH = 16
HASH_DIM = 64
CACHED_TOKENS = 1 << 16      # hashes that an encoder keeps, about 10 MB
TEXT_SALT = ""
IMAGE_SALT = "img:"


class HashingEncoder:
    """Signed feature hashing: token -> md5 -> bucket (h mod dim) and sign (bit above it).

    A batch is tokenised with Arrow compute; md5 runs once per distinct token
    (the latest ones are kept across batches), and rows are accumulated with one ``bincount``.
    """

    def __init__(self, dim: int = HASH_DIM, salt: str = ""):
        self.dim = dim
        self.salt = salt
        self._cache: dict[str, int] = {}   # token -> bucket * 2 + (1 if sign > 0 else 0)

    def _pack(self, tok: str) -> int:
        h = int(hashlib.md5((self.salt + tok).encode("utf-8")).hexdigest()[:8], 16)
        return (h % self.dim) * 2 + (1 if (h // self.dim) % 2 == 0 else 0)

    def _packed(self, uniq: list[str]) -> np.ndarray:
        vals = list(map(self._cache.get, uniq))
        for i, v in enumerate(vals):
            if v is None:
                vals[i] = v = self._pack(uniq[i])
                if len(self._cache) >= CACHED_TOKENS:
                    self._cache.clear()
                self._cache[uniq[i]] = v
        return np.fromiter(vals, np.int64, len(vals))

    def encode_text(self, text: str | None) -> np.ndarray:
        return self(np.array([text], dtype=object))[0]

    def __call__(self, items: np.ndarray) -> np.ndarray:
        import pyarrow as pa
        import pyarrow.compute as pc
        n = len(items)
        out = np.zeros((n, self.dim), np.float32)
        if n == 0:
            return out
        if any(isinstance(x, (bytes, bytearray, memoryview)) for x in items):
            items = [bytes(x).decode("utf-8", errors="replace") if isinstance(x, (bytes, bytearray, memoryview))
                     else x for x in items]
        texts = pc.fill_null(pa.array(items, pa.string()), "")
        # splits on runs of ASCII whitespace (space, \t, \n, \v, \f, \r); an empty or
        # blank text yields empty tokens, which are dropped
        toks = pc.ascii_split_whitespace(texts)
        lengths = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(toks)
        keep = pc.not_equal(flat, "")
        row = np.repeat(np.arange(n), lengths)[keep.to_numpy(zero_copy_only=False)]
        enc = pc.dictionary_encode(flat.filter(keep))
        idx = enc.indices.to_numpy(zero_copy_only=False)
        if len(idx):
            packed = self._packed(enc.dictionary.to_pylist())[idx]
            sign = np.where(packed & 1, 1.0, -1.0)
            out += np.bincount(row * self.dim + (packed >> 1), weights=sign,
                               minlength=n * self.dim).reshape(n, self.dim)
        return out


def hashing_encoder(dim: int = HASH_DIM, salt: str = "") -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """``make_encoder`` for the stand-in: called once per Python worker."""
    return lambda: HashingEncoder(dim, salt)


def encode_udf(make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = ENCODE_BATCH):
    """A batched-inference UDF returning ARRAY<FLOAT> (one vector per input row)."""
    def make_predict_fn():
        model = make_encoder()

        def predict(inputs: np.ndarray) -> np.ndarray:
            out = np.asarray(model(inputs), dtype=np.float32)
            if out.shape[0] != len(inputs):
                raise ValueError("encoder returned a different number of rows than it was given")
            return out
        return predict
    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def check_encoder(make_encoder, sample) -> int:
    """Build the encoder once on the driver and run it on two padding inputs before
    the job starts: it must be callable and return one vector per input. Returns
    the vector size."""
    model = make_encoder()
    if not callable(model):
        raise TypeError("make_encoder() must return a callable encoder")
    out = np.asarray(model(np.array([sample, sample], dtype=object)))
    if out.ndim != 2 or out.shape[0] != 2:
        raise ValueError(f"encoder must return one vector per input, got shape {out.shape}")
    return int(out.shape[1])


def encode_batch(df: DataFrame, input_col: str, output_col: str = "vec",
                 make_encoder=None, batch_size: int = ENCODE_BATCH, check: bool = True) -> DataFrame:
    """Encode one column of a table; a null input is encoded as padding ('' / empty bytes).

    The encoder hook is checked on the driver first (``check_encoder``)."""
    make_encoder = make_encoder or hashing_encoder()
    dtype = dict(df.dtypes)[input_col]
    if check:
        check_encoder(make_encoder, b"" if dtype == "binary" else "")
    pad = F.lit(b"").cast("binary") if dtype == "binary" else F.lit("")
    return spread(df).withColumn(output_col,
                                 encode_udf(make_encoder, batch_size)(F.coalesce(F.col(input_col), pad)))


def base_vectors_from_corpus(corpus: DataFrame, side: str = "cand", text_encoder=None, image_encoder=None,
                             batch_size: int = ENCODE_BATCH) -> DataFrame:
    """(id, txt_vec, img_vec, txt_mask, img_mask): each base modality encoded once.

    side 'cand' encodes the caption, 'query' the first valid question.
    """
    from quiver.functions import text as TX
    txt = F.col("caption") if side == "cand" else TX.question_of(corpus)
    d = corpus.select("id", txt.alias("txt"), F.col("image").alias("img"))
    d = d.withColumn("txt_mask", TX.text_mask("txt")).withColumn("img_mask", TX.binary_mask("img"))
    d = encode_batch(d, "txt", "txt_vec", text_encoder or hashing_encoder(salt=TEXT_SALT), batch_size)
    d = encode_batch(d, "img", "img_vec", image_encoder or hashing_encoder(salt=IMAGE_SALT), batch_size)
    return d.select("id", "txt_vec", "img_vec", "txt_mask", "img_mask")


def encode_fused(corpus: DataFrame, side: str = "cand", fusion: str = "sum", text_weight: float = 0.5,
                 text_encoder=None, image_encoder=None, mlp_weights=None) -> DataFrame:
    """Three fused modality vectors per record (id, modality, vec) from two encoder passes."""
    base = base_vectors_from_corpus(corpus, side, text_encoder, image_encoder)
    return views.modality_vectors(base, fusion, text_weight, mlp_weights=mlp_weights)


# ---- MLP fusion --------------------------------------------------------------------------

def rule_mlp_weights(dim: int) -> dict[str, np.ndarray]:
    """Deterministic MLP weights from a closed-form rule (stand-in for trained weights).

    W1[i, j] = 0.1 sin(131 i + 17 j), b1[j] = 0.01 cos(j),
    W2[j, k] = 0.1 sin(29 j + 53 k + 7), b2[k] = 0.01 cos(3 k).
    """
    i = np.arange(2 * dim, dtype=np.float64)[:, None]
    j = np.arange(dim, dtype=np.float64)
    return {
        "w1": np.sin(i * 131 + j[None, :] * 17) * 0.1,
        "b1": np.cos(j) * 0.01,
        "w2": np.sin(j[:, None] * 29 + j[None, :] * 53 + 7) * 0.1,
        "b2": np.cos(j * 3) * 0.01,
    }


def fuse_mlp(txt: Column, img: Column, weights: dict[str, np.ndarray]) -> Column:
    """Linear(2d, d) -> ReLU -> Linear(d, d) on concat([txt, img]) (text first, as called).

    The weights are shipped with the UDF closure (size d^2, independent of the data).
    """
    w1, b1, w2, b2 = (np.asarray(weights[k], np.float64) for k in ("w1", "b1", "w2", "b2"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _mlp(t: pd.Series, i: pd.Series) -> pd.Series:
        if len(t) == 0:
            return pd.Series([], dtype=object)
        x = np.hstack([np.stack(t.to_numpy()).astype(np.float64), np.stack(i.to_numpy()).astype(np.float64)])
        h = np.maximum(x @ w1 + b1, 0.0)
        return pd.Series(list(h @ w2 + b2))

    return _mlp(txt, img)


# ---- half precision -----------------------------------------------------------------------

def quantize_fp16(vec: Column) -> Column:
    """Store-as-half round trip (round to nearest even in float16, back to float)."""
    return half.rounded(vec)
