"""Personal data by fixed patterns and by bootstrapped contextual extraction.

What the fixed patterns find are the seed entities. The words around them are
lexical patterns; the graph of patterns and the strings they surround is scored
in rounds: a pattern by the share of its strings that are known, an unknown
string by the patterns around it. Strings that trusted patterns agree on are
identifiers that the fixed patterns miss. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.columns import columns_of, fresh, named, row_key
from wiretally.llm.storage import durable

KINDS = ("email", "ip", "card", "phone")

# Each finds what the plain pattern in the comment finds. Possessive repeats and
# the look-behind stop long runs from being tried again at every character.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word that may be an identifier: it has a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_CORE = r"[0-9A-Za-z+@](?:\S*[0-9A-Za-z@])?"
_CONTEXT = 64
#: Texts are cut into pieces of so many code points, of which a context takes two at most.
_PIECE = 256

ROUNDS = 3
#: Known strings that a pattern needs, and the confidence that it and a string need.
SUPPORT = 3.0
CONFIDENCE = 0.7

#: Matches of one text whose lengths are summed afresh for each position.
_BLOCK = 256

Span = "struct<start:int,kind_no:int,end:int>"


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        small = lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(parts, small)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "card":
        def luhn(total: Column, i: Column) -> Column:
            digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
            twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return total + F.when(i % 2 == 0, twice).otherwise(digit)

        fits = n.between(14, 19)
        return F.when(fits, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), luhn) % 10 == 0).otherwise(False)
    return F.lit(True)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[0-9]", "0")), r"\s+"), lambda w: w != "")


def _contexts(pieces: Column, start: Column, end: Column) -> Column:
    """Up to two lexical patterns: the two words before, and one on either side.

    They come from the 64 code points before and after the span, whatever else
    was found there; at a text's bounds there may be fewer. A word that goes on
    beyond them is none: patterns hold whole words only.
    """
    piece = lambda k: F.coalesce(F.get(pieces, k.cast("int")), F.lit(""))
    first, last = F.floor(start / _PIECE), F.floor(end / _PIECE)
    before = F.concat(piece(first - 1), F.left(piece(first), (start % _PIECE).cast("int")))
    after = F.concat(F.substring(piece(last), (end % _PIECE + 1).cast("int"), F.lit(_PIECE)), piece(last + 1))
    near = F.lit(_CONTEXT + 1)
    cut_left = F.regexp_replace(F.right(before, near), r"^\S++", "")
    cut_right = F.regexp_replace(F.left(after, near), r"(?<!\S)\S++$", "")
    left = _words(F.when(F.length(before) > _CONTEXT, cut_left).otherwise(before))
    right = _words(F.when(F.length(after) > _CONTEXT, cut_right).otherwise(after))
    one, two = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    patterns = F.array(
        F.concat(two, F.lit(" "), one, F.lit(" _")),
        F.concat(one, F.lit(" _ "), F.try_element_at(right, F.lit(1))),
    )
    return F.filter(patterns, lambda p: p.isNotNull())


def _with_matches(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: start, end and value of each match, in code points.

    Spark gives the matches and the gaps between them; positions are running
    sums of their lengths, in blocks, so that the work stays in proportion to
    the number of matches.
    """
    m, gap, length, base = (f"_{name}_{x}" for x in ("m", "gap", "length", "base"))
    rows = rows.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    any_found = F.size(m) > 0
    rows = rows.withColumn(gap, F.when(any_found, F.split("text", pattern, -1)))
    lengths = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(F.col(gap), i)))
    rows = rows.withColumn(length, F.when(any_found, lengths))
    add = lambda total, x: total + x
    blocks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _BLOCK).cast("int"))

    def next_block(done: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(length, k * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), add)
        return F.array_append(done, F.element_at(done, -1) + own)

    rows = rows.withColumn(base, F.when(any_found, F.aggregate(blocks, F.array(F.lit(0)), next_block)))

    def located(x: Column, i: Column) -> Column:
        k = F.floor(i / _BLOCK).cast("int")
        inner = F.aggregate(F.slice(length, k * _BLOCK + 1, i % _BLOCK), F.lit(0), add)
        start = F.get(F.col(base), k) + inner + F.length(F.get(F.col(gap), i))
        return F.struct(
            start.alias("start"),
            (start + F.length(x)).alias("end"),
            x.alias("value"),
        )

    rows = rows.withColumn(name, F.when(any_found, F.transform(m, located)))
    return rows.drop(m, gap, length, base)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, base, candidates)`` of every row, found row by row in whole texts.

    ``base`` has the spans of the fixed patterns that pass their checks, sorted
    by start and kind; ``candidates`` has words with a digit or an at sign that
    touch none of them. Patterns are the words around a span in the text itself,
    also where those are spans or candidates. A null text counts as empty and
    has neither.
    """
    text = F.coalesce(named(docs, text_col), F.lit(""))
    key = row_key(docs, id_col, text_col)
    rows = docs.select(key["id"].alias("id"), key["text_hash"].alias("text_hash"), text.alias("text"))
    for kind in KINDS:
        rows = _with_matches(rows, kind, PATTERNS[kind])
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}+"), F.lit(0))
    rows = _with_matches(rows, "candidate", CANDIDATE).withColumn("pieces", pieces).drop("text")
    none = F.array().cast(
        "array<struct<start:int,kind_no:int,end:int,value:string,patterns:array<string>>>"
    )

    def spans(no: int, kind: str) -> Column:
        passing = F.filter(kind, lambda s: _passes(kind, s["value"]))
        whole = lambda s: F.struct(
            s["start"], F.lit(no).alias("kind_no"), s["end"], s["value"],
            _contexts(F.col("pieces"), s["start"], s["end"]).alias("patterns"),
        )
        return F.coalesce(F.transform(passing, whole), none)

    base = F.array_sort(F.concat(*[spans(no, kind) for no, kind in enumerate(KINDS)]))
    rows = rows.select("id", "text_hash", base.alias("base"), "candidate", "pieces")

    def core(s: Column) -> Column:
        value = F.regexp_extract(s["value"], _CORE, 0)
        start = s["start"] + F.position(value, s["value"]) - 1
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    free = lambda s: (s["value"] != "") & ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    )
    whole = lambda s: F.struct(
        s["start"], s["end"], s["value"], _contexts(F.col("pieces"), s["start"], s["end"]).alias("patterns")
    )
    candidates = F.transform(F.filter(F.transform("candidate", core), free), whole)
    return rows.select("id", "text_hash", "base", candidates.alias("candidates"))


def _scored_patterns(edges: DataFrame, totals: DataFrame, known: DataFrame) -> DataFrame:
    """``(pattern, kind_no, confidence)``: known weight over all strings plus one."""
    weight = edges.join(known, "value").groupBy("pattern", "kind_no").agg(
        F.sum("score").alias("weight")
    )
    scored = weight.join(totals, "pattern").where(F.col("weight") >= SUPPORT)
    return scored.select(
        "pattern", "kind_no", (F.col("weight") / (F.col("n") + 1)).alias("confidence")
    )


def bootstrapped(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(key, start, end, kind_no)`` of the spans that the fixed patterns miss.

    Strings are counted once per pattern however often they repeat, so copies
    of a document lend a pattern no support. A string's score is the noisy-or
    of its patterns' confidences; ties between kinds go to the first kind.
    """
    key = F.struct("id", "text_hash").alias("key")
    seeds = found.select(F.explode("base").alias("s")).select(
        "s.value", "s.kind_no", F.explode("s.patterns").alias("pattern")
    )
    unknown = found.select(key, F.explode("candidates").alias("s")).select(
        "key", "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern")
    )
    known = durable(seeds.groupBy("value").agg(F.min("kind_no").alias("kind_no")), "seeds")
    edges = seeds.select("pattern", "value").unionAll(unknown.select("pattern", "value")).distinct()
    edges = durable(edges, "pattern-edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    fresh = edges.join(known.select("value"), "value", "left_anti")
    seed_scores = known.withColumn("score", F.lit(1.0))
    scores = seed_scores
    for _ in range(rounds):
        trusted = durable(_scored_patterns(edges, totals, scores), "patterns")
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999999))))
        drawn = fresh.join(trusted, "pattern").groupBy("value", "kind_no").agg(
            (1 - F.exp(doubt)).alias("score")
        )
        best = drawn.groupBy("value").agg(
            F.max(F.struct("score", (-F.col("kind_no")).alias("kind"))).alias("best")
        )
        best = best.select("value", (-F.col("best.kind")).alias("kind_no"), F.col("best.score").alias("score"))
        drawn = durable(best, "strings")
        scores = seed_scores.unionByName(drawn)
    sure = trusted.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind_no")
    named = drawn.where(F.col("score") >= CONFIDENCE).select("value", "kind_no")
    hits = unknown.join(named, "value").join(sure, ["pattern", "kind_no"])
    return hits.select("key", "start", "end", "kind_no").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, base, spans)``, one row per row of ``docs``, from whole texts of any length.

    Both are sorted arrays of ``(start, kind_no, end)`` in code points, end
    exclusive; ``base`` has what the fixed patterns find, ``spans`` that and
    what the contexts add. ``kind_no`` counts ``KINDS``. Null and empty texts
    have empty arrays; rows that repeat id and text have equal results.
    """
    found = durable(mentions(docs, id_col, text_col), "mentions")
    spans = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind_no"], s["end"]))
    added = bootstrapped(found).groupBy("key").agg(
        F.collect_set(F.struct("start", "kind_no", "end")).alias("added")
    )
    none = F.array().cast(f"array<{Span}>")
    rows = found.select("id", "text_hash", spans("base").alias("base"), F.struct("id", "text_hash").alias("key"))
    rows = rows.join(added, "key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return rows.select("id", "text_hash", "base", every.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    part = lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, part), ",")


def masked_text(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlaps merge forward."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def before(i: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"])), F.lit(0))

    def piece(s: Column, i: Column) -> Column:
        done = before(i)
        gap = F.substring(text, done + 1, F.greatest(s["start"] - done, F.lit(0)))
        return F.when(s["end"] <= done, F.lit("")).otherwise(F.concat(gap, F.get(tags, s["kind_no"])))

    rest = F.substring(text, before(F.size(spans)) + 1, F.length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), rest)


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text, all rows and columns kept.

    A column ``n_chars`` that counts the text's code points is counted again;
    others may have any name. Null and empty texts stay as they are.
    """
    key, own = fresh(docs, "_row_key"), fresh(docs, "_spans")
    spans = personal_data(docs, id_col, text_col).where(F.size("spans") > 0)
    spans = spans.select(F.struct("id", "text_hash").alias(key), F.col("spans").alias(own))
    spans = spans.dropDuplicates([key])
    joined = docs.select("*", row_key(docs, id_col, text_col).alias(key)).join(spans, key, "left")
    text, found = named(docs, text_col), F.col(own).isNotNull()
    masked = F.when(found, masked_text(text, F.col(own))).otherwise(text)
    changed = {text_col: masked}
    if "n_chars" in docs.columns:
        counted = F.length(masked).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(found, counted).otherwise(F.col("n_chars"))
    return joined.select(*[changed.get(c, named(docs, c)).alias(c) for c in docs.columns])
