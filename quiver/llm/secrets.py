"""Secrets in whole texts: patterns, and sliding-window entropy of candidate strings.

DataFrame functions only; every text is scanned in its own row, so nothing is
shuffled and no document waits for another.

Base kinds are found by their patterns. The method adds ``entropy`` spans:
candidate strings are unbroken runs of key characters, at least WINDOW long. A
window of WINDOW characters slides over each; the counts of its characters are
updated by the character that enters and the one that leaves, and with them the
sum of n log2 n, which gives the window's Shannon entropy without a second look
at the window. Each character class has its own thresholds, higher ones for
strings with fewer digits or changes of case. The allow-list suppresses what is
random-looking but known to be harmless: whole strings of some forms, and the
windows that touch a harmless stretch; the other windows are judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm import spans
from quiver.llm.common import fresh_names, text_or_empty

# Fixed values of the contract: kinds in their order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = "^" + ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)$"
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"                     # 20 characters or more
HEX = r"[0-9a-f]{24,}+"                              # a whole run of 24 or more

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
#: class of a candidate -> (what all of it matches, [(what it must hold so many times, least entropy in bits of some window)])
CLASSES = [
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", [({r"[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]": 1}, 2.8)]),
    ("lower", r"^[0-9a-z_=-]+$", [({r"[0-9].*[a-z].*[0-9].*[a-z].*[0-9]": 1}, 3.5), ({r"[0-9](?=[a-z])": 1, r"[a-z](?=[0-9])": 1, r"[_-]": 0}, 3.8)]),
    ("upper", r"^[0-9A-Z_=-]+$", [({r"[0-9].*[A-Z].*[0-9].*[A-Z].*[0-9]": 1}, 3.5), ({r"[0-9](?=[A-Z])": 1, r"[A-Z](?=[0-9])": 1, r"[_-]": 0}, 3.8)]),
    ("mixed", r"^.+$", [({r"(?=.*[0-9].*[0-9])(?=.*[A-Z].*[A-Z])(?=.*[a-z].*[a-z])": 1}, 3.6),
                        ({r"[0-9]": 1, r"[A-Z]": 1, r"[a-z]": 1, r"[a-z](?=[A-Z0-9])|[0-9](?=[a-z])": 3}, 3.7),
                        ({r"[a-z](?=[A-Z])": 3, r"[A-Z](?=[A-Z])": 1}, 3.7)]),
]


def _run(characters: str, least: int) -> str:
    """A pattern of the first ``least`` characters and as many of the others as follow."""
    return characters[:least] + "".join(f"(?:{c}" for c in characters[least:]) + ")?" * (len(characters) - least)


#: harmless as a whole: identifiers of a public form; paths, unless their letters change case like those of a key
ALLOWED = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ALLOWED_PATH = r"^/?(?:[A-Za-z_-]{2,}[0-9]{0,4}/)*[A-Za-z_-]+[0-9]{0,4}/?$"
KEY_LIKE = (r"[a-z](?=[A-Z])", 3), (r"[A-Z](?=[A-Z])", 1)
#: harmless stretches, whose windows are not judged: placeholders, repeated or counted-up characters
ALLOWED_STRETCH = (r"(.)\1{5,}|(?i:(?:example|sample|dummy|placeholder|changeme|redacted|lorem)[_-]?(?:key|token|secret|password|value|id)?)"
                   rf"|{_run('0123456789', 7)}|{_run('1234567890', 7)}|(?i:{_run('abcdefghijklmnopqrstuvwxyz', 7)})")
#: words just before a string that say it is a checksum or a revision
ALLOWED_BEFORE = r"(?i:sha-?1|sha-?256|sha-?384|sha-?512|md5|checksum|digest|commit|revision|integrity)\W{0,3}$"


def window_entropy(text: Column, spared: Column | None = None) -> Column:
    """The largest Shannon entropy (bits a character) of any WINDOW characters of ``text``; shorter: 0.

    Windows that share a character with one of the spans ``spared`` do not count.
    """
    def counts_at(i: Column) -> Column:
        full = i >= WINDOW - 1
        return full if spared is None else full & ~F.exists(spared, lambda s: (s["start"] <= i) & (s["end"] > i - (WINDOW - 1)))

    gain = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(WINDOW + 2)])
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    codes = F.transform(characters, lambda c: F.position(c, F.lit(ALPHABET)))
    pairs = spans.let(codes, lambda all_: F.transform(all_, lambda c, i: F.struct(
        c.alias("enters"), F.when(i >= WINDOW, F.get(all_, i - WINDOW)).otherwise(-1).alias("leaves"),
        counts_at(i).alias("full"))))

    def step(state: Column, pair: Column) -> Column:
        enters, leaves = pair["enters"], pair["leaves"]
        same = enters == leaves
        n_in, n_out = F.get(state["n"], enters), F.get(state["n"], F.greatest(leaves, F.lit(0)))
        counts = F.when(same, state["n"]).otherwise(F.transform(
            state["n"], lambda n, i: n + (i == enters).cast("int") - (i == leaves).cast("int")))
        change = F.when(same, 0.0).otherwise(
            F.get(gain, n_in + 1) - F.get(gain, n_in)
            + F.when(leaves < 0, 0.0).otherwise(F.get(gain, n_out - 1) - F.get(gain, n_out)))
        total = state["sum"] + change
        entropy = F.when(pair["full"], F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(0.0)
        return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(state["best"], entropy).alias("best"))

    first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("sum"),
                     F.lit(0.0).alias("best"))
    return F.aggregate(pairs, first, step, lambda s: s["best"])


def _holds(match: Column, what: dict[str, int]) -> Column:
    """Every pattern occurs at least so many times; not at all for 0."""
    found = F.lit(True)
    for pattern, least in what.items():
        if least == 1:
            found = found & F.regexp_like(match, F.lit(pattern))
        elif least == 0:
            found = found & ~F.regexp_like(match, F.lit(pattern))
        else:
            found = found & (F.regexp_count(match, F.lit(pattern)) >= least)
    return found


def _is_random(match: Column) -> Column:
    least = F.lit(None).cast("double")              # the lowest threshold whose conditions hold; null: none
    for _, whole, tiers in reversed(CLASSES):
        of_class = F.lit(None).cast("double")
        for what, entropy in reversed(tiers):
            of_class = F.when(_holds(match, what), entropy).otherwise(of_class)
        least = F.when(F.regexp_like(match, F.lit(whole)), of_class).otherwise(least)
    judged = spans.let(spans.find_all(match, ALLOWED_STRETCH, 0), lambda spared: window_entropy(match, spared))
    return spans.let(least, lambda t: F.when(t.isNotNull(), judged >= t).otherwise(False))


def _allowed(match: Column) -> Column:
    key_like = _holds(match, dict(KEY_LIKE)) & ~F.contains(match, F.lit("/"))
    return F.regexp_like(match, F.lit(ALLOWED)) | F.regexp_like(match, F.lit(ALLOWED_PATH)) & ~key_like


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two further columns, base spans and all spans, and their names, which no column of ``docs`` has."""
    base, every, long = fresh_names(docs, "base", "spans", "long")
    text = text_or_empty()
    assign = F.filter(spans.find_all(text, ASSIGN, 0, (":", "=")), lambda s: F.length(
        F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= ASSIGN_LEAST)
    access, hexes = spans.find_all(text, ACCESS, 1, ("AKIA",)), spans.find_all(text, HEX, 2)
    found = docs.withColumn(base, F.concat(assign, access, hexes))
    found = found.withColumn(long, spans.find_all(text, CANDIDATE, 3))
    added = F.filter(long, lambda s: ~spans.overlaps(s, F.col(base)) & ~_allowed(s["match"])
                     & ~F.regexp_like(F.substring(text, F.greatest(s["start"] - 15, F.lit(1)),
                                                  F.least(s["start"], F.lit(16))), F.lit(ALLOWED_BEFORE))
                     & _is_random(s["match"]))
    return found.withColumn(every, F.concat(base, added)).drop(long), base, every


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of ``docs``.

    Null text is empty; a text without findings has counts 0, the digest of the
    empty string and an empty ``spans``. Repeated rows and null ids give rows of
    their own; an empty table gives none; other columns are ignored.
    """
    found, base, every = with_spans(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *[spans.count_kind(F.col(base), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(spans.joined(F.col(base), KINDS, by_kind=False), 256).alias("base_sha256"),
        spans.joined(F.col(every), KINDS, by_kind=False).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark`` and n_chars counted anew where text changed.

    All rows and columns stay, whatever the columns are named; null texts stay null.
    """
    found, _, every = with_spans(docs)
    hit = F.size(every) > 0
    changed = found.withColumn("text", F.when(hit, spans.redacted(text_or_empty(), F.col(every), mark))
                               .otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType))
                                     .otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
