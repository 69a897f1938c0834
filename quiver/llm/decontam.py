"""Benchmark decontamination by canonical templates, with DataFrame functions only.

Words become a template: numbers, units after a number and names (capitalised
words inside a sentence) are replaced by typed placeholders, everything else is
lower-cased. Windows of five words are hashed and joined with the windows of the
benchmark items: as they are (lower-cased), and as templates, so a question whose
numbers, names or units were changed still meets its original. A template says
something only with enough literal words; a window with too few is widened to
either side until it has them, and always meets its exact copy. A document is
reported for an item if at least 0.8 of the item's distinct windows occur in it
in one of these forms and the slots agree: along the item's best alignment, one
slot value of the item must stand for one value of the document. Slots need not
agree where 0.8 of the windows occur word for word.

Documents are not shuffled: their windows meet a broadcast table of benchmark
windows as long as that has at most BROADCAST_WINDOWS rows; a larger benchmark is
joined by a shuffle on the hash, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import store
from quiver.llm.spans import let

WINDOW_WORDS = 5
LEAST_SHARE = 0.8            # of the item's distinct windows, and of slots that agree
LEAST_LITERALS = 3           # templates with fewer literal words say nothing; such windows are widened
WIDEST = 20                  # words that a template is widened over; further on, whole stretches between literal words are taken
BROADCAST_WINDOWS = 500_000  # benchmark windows that are broadcast, at most; each takes about 100 bytes

#: a word, with the mark or line break after it that ends a sentence
WORD = r"[\p{L}\p{N}]+(?:[.,][\p{N}]+)*[.!?:\n]?"
# Units that count as such after a number.
UNITS = ("mg g kg t ml cl l mm cm m km inch inches foot feet yard yards mile miles ounce ounces pound pounds "
         "second seconds minute minutes hour hours day days week weeks month months year years "
         "cent cents dollar dollars euro euros percent degrees celsius watt watts volt volts").split()


#: what a text without any placeholder lacks: a digit, a capital that begins a word after another word without a
#: closing mark, whatever stands between them; and the capitals whose lower case is two characters or goes by what
#: stands around them
PERHAPS_FILLED = r"\p{N}|[\p{L}\p{N}][^\p{L}\p{N}.!?:\n][^\p{L}\p{N}]*+[\p{Lu}\p{Lt}]|[İΣ]"
PLAIN_WORD = r"[\p{L}\p{N}]+"


def _canonical(words: Column) -> Column:
    """Words with their closing marks -> structs low (lower-cased), t (template word) and v (slot value, null for literal words)."""
    units = F.array(*map(F.lit, UNITS))

    def one(word: Column, i: Column) -> Column:
        low = F.lower(F.rtrim(word, F.lit(".!?:\n")))
        before = F.get(words, i - 1)
        number = low.between("0", "9~")
        unit = before.between("0", "9~") & F.array_contains(units, low)
        inside = (i > 0) & ~F.substring(before, -1, 1).isin(".", "!", "?", ":", "\n")
        # a capital differs from its lower case; words in capitals throughout are no names
        name = (inside & (F.substring(word, 1, 1) != F.substring(low, 1, 1)) & (word != F.upper(word)))
        kind = F.when(number, "<num>").when(unit, "<unit>").when(name, "<name>")
        return F.struct(low.alias("low"), F.coalesce(kind, low).alias("t"), F.when(kind.isNotNull(), low).alias("v"))

    return F.transform(words, one)


def windows(docs: DataFrame, id_column: str, short: tuple[int, ...] = (), every: bool = True) -> DataFrame:
    """(id, at, hash, slots, window): the windows of each text, word for word and as templates.

    ``window`` is the hash of the words that a row stands for; where it equals
    ``hash`` the row is the window word for word, else a template whose
    placeholders have the values ``slots``. ``at`` is where the hashed words
    begin. A text of one to four words is one window; ``short`` has the lengths
    below five of which windows are wanted from longer texts too. A text that
    can't hold a placeholder takes a shorter way to the same windows.

    Where WIDEST words hold too few literal ones, the windows between two literal
    words share one template: the stretch from behind the earlier one to the
    next that makes it WIDEST words or LEAST_LITERALS literal ones long, and the
    same to the other side. All of those windows give a row, the first with the
    slots; without ``every`` only the first does.
    """
    k = WINDOW_WORDS
    row = "struct<at:int,hash:bigint,slots:array<string>,window:bigint>"
    none = F.expr(f"cast(array() as array<{row}>)")

    def part(words: Column, start: Column, width) -> Column:
        return F.slice(words, start + 1, F.lit(width) if isinstance(width, int) else width)

    def spots(words: Column, width: int) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
        # a text shorter than five words is the one window of its own length
        return every if width == k else F.when(F.size(words) > width, every).otherwise(F.expr("cast(array() as array<int>)"))

    def literal(words: Column, width: int) -> Column:
        def one(i: Column) -> Column:
            return let(F.xxhash64(part(words, i, width)), lambda h: F.struct(
                i.alias("at"), h.alias("hash"), F.expr("cast(array() as array<string>)").alias("slots"), h.alias("window")))
        return F.transform(spots(words, width), one)

    def values(v: Column) -> Column:
        return F.filter(v, lambda x: x.isNotNull())

    def template(c: Column, at: Column, width: Column, window: Column, end: Column | None = None) -> Column:
        t = part(c["t"], at, width)
        return F.struct(at.alias("at"), F.xxhash64(t if end is None else F.concat(t, end)).alias("hash"),
                        values(part(c["v"], at, width)).alias("slots"), window.alias("window"))

    def enough(v: Column) -> Column:
        """How many of the first words hold LEAST_LITERALS literal ones; null if all of them do not."""
        state = F.aggregate(v, F.struct(F.lit(0).alias("n"), F.lit(0).alias("seen")), lambda s, x: F.struct(
            (s["n"] + (s["seen"] < LEAST_LITERALS).cast("int")).alias("n"), (s["seen"] + x.isNull().cast("int")).alias("seen")))
        return F.when(state["seen"] >= LEAST_LITERALS, state["n"])

    def templates(c: Column, width: int) -> Column:
        """Of windows with placeholders: the template, or if that says nothing those of the widened windows."""
        def one(i: Column) -> Column:
            v = part(c["v"], i, width)
            window = F.xxhash64(part(c["low"], i, width))
            n_literal = F.size(F.filter(v, lambda x: x.isNull()))
            size = F.size(c["v"])
            if width < k:
                return F.when(n_literal >= LEAST_LITERALS, F.array(template(c, i, F.lit(width), window))).otherwise(none)

            def widened(_: Column) -> Column:
                end = F.least(i + k, size)
                first = F.greatest(end - WIDEST, F.lit(0))
                right, left = enough(part(c["v"], i, WIDEST)), enough(F.reverse(part(c["v"], first, end - first)))
                return F.concat(let(right, lambda n: F.when(n.isNotNull(), F.array(template(c, i, n, window))).otherwise(none)),
                                let(left, lambda n: F.when(n.isNotNull(), F.array(template(c, end - n, n, window))).otherwise(none)))
            rich = F.when(size >= k, let(i, widened)).otherwise(none)
            # short texts as a whole meet each other's templates as long as these have at most two placeholders
            whole = F.when((size < k) & (F.size(v) - n_literal <= k - LEAST_LITERALS), F.array(
                template(c, i, F.lit(k), window, F.array(F.lit("<whole>"))))).otherwise(none)
            return F.concat(F.when(n_literal >= LEAST_LITERALS, F.array(template(c, i, F.lit(k), window))).otherwise(rich), whole)

        filled = F.filter(spots(c["v"], width), lambda i: F.exists(part(c["v"], i, width), lambda x: x.isNotNull()))
        near = F.flatten(F.transform(filled, one))
        return F.concat(near, far(c)) if width == k else near

    def far(c: Column) -> Column:
        """Rows of windows from which LEAST_LITERALS literal words are further than WIDEST words off."""
        size = F.size(c["v"])

        def stretch(first: Column, last: Column, begin: Column, end: Column) -> Column:
            """Rows of the windows that begin at ``first`` to ``last``; their template goes from ``begin`` to ``end``."""
            def rows(x: Column) -> Column:
                return F.transform(F.sequence(first, last if every else first), lambda i: F.struct(
                    x["at"].alias("at"), x["hash"].alias("hash"),
                    F.when(i == first, x["slots"]).otherwise(F.expr("cast(array() as array<string>)")).alias("slots"),
                    F.xxhash64(part(c["low"], i, k)).alias("window")))
            wanted = (first <= last) & begin.isNotNull() & end.isNotNull()
            return F.when(wanted, let(template(c, begin, end - begin + 1, F.lit(0).cast("long")), rows)).otherwise(none)

        def around(literals: Column) -> Column:
            def at(j: Column) -> Column:
                return F.get(literals, j)

            def both(here: Column, j: Column) -> Column:
                begin, end = F.coalesce(at(j - 1) + 1, F.lit(0)), F.coalesce(at(j + 1) - 1, size - 1)
                right = F.when(here - begin + 1 >= WIDEST, here).when(at(j + 1) - begin + 1 >= WIDEST, at(j + 1)).otherwise(at(j + 2))
                left = F.when(end - here + 1 >= WIDEST, here).when(end - at(j - 1) + 1 >= WIDEST, at(j - 1)).otherwise(at(j - 2))
                ahead = stretch(begin, F.least(here, at(j + 2) - WIDEST, size - k), begin, right)
                behind = stretch(F.greatest(here, at(j - 2) + WIDEST, F.lit(k - 1)) - (k - 1), end - (k - 1), left, end)
                return F.concat(ahead, behind)
            n = F.size(literals)
            # nothing is far unless so many words lie between a literal one and the third after it, or before the third or after the third last
            apart = F.exists(F.arrays_zip(literals.alias("x"), F.slice(literals, LEAST_LITERALS + 1, F.greatest(n, F.lit(1))).alias("y")),
                             lambda p: p["y"] - p["x"] > WIDEST)
            edge = (F.coalesce(at(F.lit(LEAST_LITERALS - 1)), size) >= WIDEST) | (size - F.coalesce(at(n - LEAST_LITERALS), F.lit(0)) > WIDEST)
            return F.when((n > 0) & (apart | edge), F.flatten(F.transform(literals, both))).otherwise(none)

        placeholders = F.size(F.filter(c["v"], lambda x: x.isNotNull()))
        numbered = F.transform(c["v"], lambda x, i: F.when(x.isNull(), i).otherwise(-1))
        return F.when(placeholders > WIDEST - LEAST_LITERALS, let(F.filter(numbered, lambda i: i >= 0), around)).otherwise(none)

    def plain_rows(words: Column) -> Column:
        return F.concat(*[literal(words, w) for w in (k, *short)])

    def filled_rows(words: Column) -> Column:
        def both(c: Column) -> Column:
            return F.concat(plain_rows(c["low"]), *[templates(c, w) for w in (k, *short)])
        return let(_canonical(words), lambda w: let(F.struct(
            F.transform(w, lambda x: x["low"]).alias("low"), F.transform(w, lambda x: x["t"]).alias("t"),
            F.transform(w, lambda x: x["v"]).alias("v")), both))

    def if_any(words: Column, build) -> Column:
        return let(words, lambda w: F.when(F.size(w) > 0, build(w)).otherwise(none))

    text = F.coalesce(F.col("text"), F.lit(""))
    filled = if_any(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), filled_rows)
    plain = if_any(F.regexp_extract_all(F.lower(text), F.lit(PLAIN_WORD), F.lit(0)), plain_rows)
    found = F.when(F.regexp_like(text, F.lit(PERHAPS_FILLED)), filled).otherwise(plain)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.explode(found).alias("w")).select("id", "w.*")


def _short_lengths(benchmark: DataFrame) -> tuple[int, ...]:
    """The numbers of words below WINDOW_WORDS that items have (at most four)."""
    n = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0)))
    found = benchmark.filter("item_id is not null").select(n.alias("n")).filter(
        F.col("n").between(1, WINDOW_WORDS - 1)).distinct().collect()
    return tuple(sorted(r["n"] for r in found))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, share, n_slots, slot_share), one row per reported pair.

    Tables need doc_id and text, item_id and text; other columns are ignored.
    Null ids are left out, null texts are empty and match nothing; repeated rows
    count once (a doc_id's rows are one document). An empty table on either side
    gives no rows.
    """
    items, _ = store(windows(benchmark.filter("item_id is not null"), "item_id").select(
        F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"), "window").distinct(),
        "benchmark-windows")
    small = items.count() <= BROADCAST_WINDOWS
    asked = windows(docs.filter("doc_id is not null"), "doc_id", _short_lengths(benchmark), every=False).drop("window").withColumnRenamed("id", "doc_id")
    hits, _ = store(asked.join(F.broadcast(items) if small else items, "hash"), "window-hits")
    sizes = items.groupBy("item_id").agg(F.countDistinct("window").alias("item_windows"))
    shares = (hits.groupBy("doc_id", "item_id", "window").agg(F.max((F.col("hash") == F.col("window")).cast("int")).alias("literal"))
              .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("literal").alias("n_literal"))
              .join(sizes, "item_id").withColumn("share", F.col("n_windows") / F.col("item_windows"))
              .filter(F.col("share") >= LEAST_SHARE))
    return (shares.join(_slot_shares(hits, shares), ["doc_id", "item_id"], "left")
            .filter((F.coalesce("slot_share", F.lit(1.0)) >= LEAST_SHARE) | (F.col("n_literal") >= LEAST_SHARE * F.col("item_windows")))
            .select("doc_id", "item_id", "n_windows", "item_windows", "share", F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
                    F.coalesce("slot_share", F.lit(1.0)).alias("slot_share")))


def _slot_shares(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_slots, slot_share) over the alignment with the most windows, for pairs with slots."""
    pair = ["doc_id", "item_id"]
    lined = hits.filter(F.size("item_slots") > 0).withColumn("shift", F.col("at") - F.col("item_at")).join(
        pairs.select(pair), pair, "left_semi")
    best = (lined.groupBy(*pair, "shift").agg(F.count(F.lit(1)).alias("n")).groupBy(pair)
            .agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift")))
    slots = lined.join(best, [*pair, "shift"]).select(*pair, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    votes = slots.groupBy(*pair, F.col("s.item_slots").alias("asked"), F.col("s.slots").alias("told")).agg(
        F.count(F.lit(1)).alias("n"))
    return (votes.groupBy(*pair, "asked").agg(F.max("n").alias("agreed"), F.sum("n").alias("n")).groupBy(pair)
            .agg(F.sum("n").alias("n_slots"), (F.sum("agreed") / F.sum("n")).alias("slot_share")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item is reported for, all columns kept (null ids stay)."""
    dirty = contaminated(docs, benchmark).select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, docs["doc_id"] == dirty["_dirty"], "left_anti")
