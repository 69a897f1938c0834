"""Personal data in whole texts: candidate spans scored by gradient-boosted trees.

DataFrame functions only. Base kinds are found by their patterns and checks.
Generators of high recall propose further, overlapping spans in the same row;
each candidate is described by its format and by the words around it. Boosted
trees learn from one half of all documents which candidates are personal data
(positive: a base finding covers the same stretch), the other half calibrates a
threshold per generator, and the trees become one SQL expression that scores
every candidate of every document in its own row. No text is shuffled: what is
kept of a candidate is its numbers.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm import spans
from quiver.llm.common import drop, store, text_or_empty

# Fixed values of the contract: kinds in their order, patterns, numbers of digits.
KINDS = ["email", "ip", "card", "phone"]
# A run of local characters fails or succeeds as a whole, so only its start is tried: the search stays linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS, OCTET_MOST = (13, 19), (9, 15), 255

#: generators of candidates: pattern, the kind an accepted span gets, what every match holds
GENERATORS = [
    (r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[(](?:at|AT)[\])])\x20?[A-Za-z0-9-]{1,63}+"
     r"(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+){1,8}+", 0, ("@", "at)", "at]", "AT)", "AT]")),
    (r"[0-9]{1,3}+(?:[.:-][0-9]{1,3}+){3}+", 1, ()),
    (r"[0-9](?:[\x20.-]{0,2}+[0-9]){11,}+", 2, ()),
    (r"\+?\(?[0-9](?:[\x20()./-]{0,3}+[0-9]){6,}+", 3, ()),
]
CONTEXT = 24                 # code points looked at before a candidate
CONTEXT_WORDS = [            # one feature each: is any of these just before the candidate
    r"(?i:e-?mail|mail|contact|schreib|correo|courriel)", r"(?i:\bip\b|host|server|addr)",
    r"(?i:card|visa|credit|konto|carte|tarjeta|iban)", r"(?i:phone|tel|call|mobile|fax|anruf|appel)",
    r"(?i:order|invoice|\bno\b|nr\.?|version|isbn|page|section|§)",
]

TREES, DEPTH = 12, 4
PRECISION = 0.98             # least precision of a generator's accepted candidates on the calibration half
LEAST_POSITIVES = 20         # with fewer in either half a generator adds nothing


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def octets_ok(match: Column) -> Column:
    parts = F.transform(F.split(match, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.rpad(p, 1, "0").isNotNull())
                    & (F.when(F.length(p).between(1, 3), p.cast("int")).otherwise(OCTET_MOST + 1) <= OCTET_MOST))


def base_spans(text: Column) -> Column:
    ip = F.filter(spans.find_all(text, IP, 1), lambda s: octets_ok(s["match"]))
    card = F.filter(spans.find_all(text, CARD, 2), lambda s: spans.let(
        _digits(s["match"]), lambda d: F.length(d).between(*CARD_DIGITS) & luhn(d)))
    phone = F.filter(spans.find_all(text, PHONE, 3, ("+",)),
                     lambda s: F.length(_digits(s["match"])).between(*PHONE_DIGITS))
    return F.concat(spans.find_all(text, EMAIL, 0, ("@",)), ip, card, phone)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def features(text: Column, span: Column) -> Column:
    """Format and context of one candidate as an array of doubles."""
    match, digits = span["match"], _digits(span["match"])
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    longest = F.array_max(F.transform(F.split(match, "[^0-9]+"), lambda p: F.length(p)))
    number = [F.length(match), F.length(digits), F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
              F.length(F.regexp_replace(match, "[^ ().-]", "")), F.length(F.regexp_replace(match, "[^.]", "")),
              longest, F.size(F.split(match, "[^0-9]+"))]
    flags = [F.contains(match, F.lit(c)) for c in "+@( -"]
    flags += [luhn(digits), octets_ok(match), F.regexp_like(before, F.lit(r"[A-Za-z0-9]$")),
              F.regexp_like(before, F.lit(r"[+.@/_-]$")), F.regexp_like(after, F.lit(r"^[A-Za-z0-9]")),
              F.regexp_like(after, F.lit(r"^[@/_-]"))]
    flags += [F.regexp_like(before, F.lit(words)) for words in CONTEXT_WORDS]
    return F.array(*[n.cast("double") for n in number], *[_flag(f) for f in flags])


N_FEATURES = 7 + 5 + 6 + len(CONTEXT_WORDS)


def candidates(text: Column) -> Column:
    """Spans of all generators; the kind of each is the generator's number."""
    return F.concat(*[spans.find_all(text, pattern, i, needs) for i, (pattern, _, needs) in enumerate(GENERATORS)])


def _same_stretch(span: Column, base: Column) -> Column:
    """A base finding shares at least four fifths of the two stretches' union."""
    return F.exists(base, lambda b: 5 * (F.least(b["end"], span["end"]) - F.greatest(b["start"], span["start"]))
                    >= 4 * (F.greatest(b["end"], span["end"]) - F.least(b["start"], span["start"])))


def _tree(node, x: Column) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= float(split.threshold()),
                  _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Model:
    """Boosted trees as a SQL expression, with an acceptance threshold per generator (None: accept nothing)."""

    def __init__(self, trees, weights, thresholds):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, x: Column) -> Column:
        margin = sum((_tree(t, x) * w for t, w in zip(self.trees, self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, span: Column, x: Column) -> Column:
        least = F.array(*[F.lit(2.0 if t is None else t) for t in self.thresholds])
        return self.score(x) >= F.get(least, span["kind"])


def train(docs: DataFrame) -> Model:
    """Fit on the candidates of all documents.

    Half of them (by a hash of the id) grows the trees, the other calibrates.
    Documents without both labels give a model that accepts nothing.
    """
    spark = docs.sparkSession
    halved = docs.select(F.pmod(F.hash("doc_id"), F.lit(2)).alias("half"), text_or_empty().alias("text"))
    labelled = (halved.withColumn("base", base_spans(F.col("text")))
                .withColumn("found", candidates(F.col("text")))
                .select("half", "text", "base", F.explode("found").alias("s"))
                .select("half", F.col("s.kind").alias("generator"), features(F.col("text"), F.col("s")).alias("x"),
                        _flag(_same_stretch(F.col("s"), F.col("base"))).alias("label")))
    rows, path = store(labelled, "pii-candidates")
    present = {r["label"] for r in rows.filter("half = 0").select("label").distinct().collect()}
    if len(present) < 2:
        drop(spark, path)
        return Model([], [], [None] * len(GENERATORS))
    fitted = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(
        rows.filter("half = 0").withColumn("v", array_to_vector("x")))
    trees = [t.rootNode() for t in fitted._java_obj.trees()]
    model = Model(trees, list(fitted.treeWeights), [None] * len(GENERATORS))
    model.thresholds = _calibrate(rows.filter("half = 1").select(
        "generator", "label", F.round(model.score(F.col("x")), 3).alias("score")))
    drop(spark, path)
    return model


def _calibrate(scored: DataFrame) -> list[float | None]:
    """Per generator the least score from which on at least PRECISION of the candidates are positive."""
    by_score = scored.groupBy("generator", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("generator").orderBy(F.desc("score"))     # at most 1001 scores per generator
    passed = (by_score.withColumn("good", F.sum("good").over(above)).withColumn("n", F.sum("n").over(above))
              .filter((F.col("good") >= PRECISION * F.col("n")) & (F.col("good") >= LEAST_POSITIVES) & (F.col("score") > 0.5)))
    least = {r["generator"]: r["least"] for r in passed.groupBy("generator").agg(F.min("score").alias("least")).collect()}
    return [least.get(i) for i in range(len(GENERATORS))]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``.

    Null text is empty; a text without findings has counts 0, the digest of the
    empty string and an empty ``spans``. Accepted candidates that overlap a base
    finding are dropped in its favour; overlapping accepted candidates all stay.
    Repeated rows and null ids give rows of their own; an empty table gives none
    (and a model that accepts nothing); other columns are ignored.
    """
    model = model or train(docs)
    text = F.col("text")
    found = docs.select("doc_id", text_or_empty().alias("text")).withColumn("base", base_spans(text))
    if any(t is not None for t in model.thresholds):
        kinds = F.array(*[F.lit(kind) for _, kind, _ in GENERATORS])
        added = F.filter(candidates(text), lambda s: ~spans.overlaps(s, F.col("base"))
                         & spans.let(features(text, s), lambda x: model.accepts(s, x)))
        added = F.transform(added, lambda s: F.struct(
            s["start"].alias("start"), F.get(kinds, s["kind"]).alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
        found = found.withColumn("spans", F.concat("base", F.array_distinct(added)))
    else:
        found = found.withColumn("spans", F.col("base"))
    return found.select(
        "doc_id", *[spans.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(spans.joined(F.col("base"), KINDS, by_kind=True), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), KINDS, by_kind=True).alias("spans"))
