"""String, mask and draw expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Modality codes in fan-out order, and their long names.
MODALITIES = ["i", "t", "it"]
MODALITY_NAMES = {"i": "img_only", "t": "txt_only", "it": "img_txt"}
# The only named task, and the prefix for all others.
TASK_NAMES = {0: "Image-to-Text Retrieval"}
UNKNOWN_TASK_PREFIX = "Unknown Task "
# Result card label format, and the placeholder for a missing id.
CARD_LABEL_FORMAT = "ID: %s, Score: %s"    # score shown with 4 decimals
MISSING_CONTENT_PREFIX = "Content not found for ID: "


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def modality_name(code: ColumnOrName) -> Column:
    expr = None
    for k, v in MODALITY_NAMES.items():
        expr = (F.when(_c(code) == k, F.lit(v)) if expr is None else expr.when(_c(code) == k, F.lit(v)))
    return expr.otherwise(F.lit(None).cast("string"))


def task_name(task_id: ColumnOrName) -> Column:
    t = _c(task_id).cast("int")
    expr = None
    for k, v in TASK_NAMES.items():
        expr = F.when(t == k, F.lit(v)) if expr is None else expr.when(t == k, F.lit(v))
    return expr.otherwise(F.concat(F.lit(UNKNOWN_TASK_PREFIX), t.cast("string")))


def id_string(c: ColumnOrName) -> Column:
    """Ids are compared as strings (a judgment token '007' does not match id 7)."""
    return _c(c).cast("string")


def text_mask(txt: ColumnOrName) -> Column:
    """1 when text is present: null and '' are missing; whitespace-only is present."""
    t = _c(txt)
    return F.when(t.isNull() | (t == F.lit("")), F.lit(0)).otherwise(F.lit(1))


def padded_text(txt: ColumnOrName) -> Column:
    return F.coalesce(_c(txt), F.lit(""))


def binary_mask(img: ColumnOrName) -> Column:
    return F.when(_c(img).isNull(), F.lit(0)).otherwise(F.lit(1))


def strip_ws(c: ColumnOrName) -> Column:
    """Strip leading and trailing white space: Unicode's, and the separators U+001C to U+001F."""
    return F.regexp_replace(_c(c), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def valid_questions(questions: ColumnOrName) -> Column:
    """Stripped, non-null, non-blank questions, in order."""
    return F.filter(F.transform(_c(questions), lambda q: strip_ws(q)),
                    lambda q: q.isNotNull() & (q != F.lit("")))


def first_question(questions: ColumnOrName) -> Column:
    """First valid question, or '' (an empty or null list gives '')."""
    return F.coalesce(F.get(valid_questions(questions), 0), F.lit(""))


def question_of(corpus) -> Column:
    """The query text of a corpus record: a precomputed ``question`` column when the
    corpus has one (long-form source), else the first valid entry of a ``questions``
    array. A plain-string ``questions`` is not a list, so it gives '' here."""
    if "question" in corpus.columns:
        return F.col("question")
    if dict(corpus.dtypes).get("questions") == "string":
        return F.lit("")
    return first_question("questions")


def sampled_question_any(corpus, id_col: ColumnOrName, seed: ColumnOrName) -> Column:
    """Seeded draw among the valid questions; a plain-string ``questions`` is accepted
    as the only question (stripped, '' when blank)."""
    if dict(corpus.dtypes).get("questions") == "string":
        return F.coalesce(strip_ws(F.col("questions")), F.lit(""))
    return sampled_question("questions", id_col, seed)


def hash_draw(*parts: ColumnOrName) -> Column:
    """Deterministic 32-bit draw from md5 of the '-'-joined parts; reproducible in SQL engines."""
    key = F.concat_ws("-", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def sampled_question(questions: ColumnOrName, id_col: ColumnOrName, seed: ColumnOrName) -> Column:
    """A seeded draw among the valid questions, or ''."""
    v = valid_questions(questions)
    n = F.size(v)
    return F.when(n > 0, F.get(v, (hash_draw(id_col, seed) % n).cast("int"))).otherwise(F.lit(""))


def card_label(doc_id: ColumnOrName, score: ColumnOrName) -> Column:
    """``ID: <id>, Score: <score to 4 places>``; the score is rounded half-up as a decimal
    (a float format would round the binary value and disagree across engines)."""
    s4 = F.round(_c(score).cast("decimal(18,6)"), 4).cast("string")
    return F.format_string(CARD_LABEL_FORMAT, _c(doc_id).cast("string"), s4)
