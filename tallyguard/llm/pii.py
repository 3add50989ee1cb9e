"""Personal data: pattern spans, then terms that give a protected value away.

Base spans (e-mail, ip, card, phone) are protected values. Corpus co-occurrence says how
strongly a word of a text, near the value or not, reveals it: how little information is
left in the value once the word is known, -log2 P(value | word). With df texts that hold
the word and n' of them the value too, the probability is estimated as n' / (df + 1); the
one more text, without the value, is what keeps a single joint sighting from being proof:
one joint text gives a share of 0.5 (one bit left), three 0.75, nine 0.9, in a corpus of any
size. From ``GENERALISE`` on a word is generalised, from ``REMOVE`` on removed, in the
documents that hold the value. The pointwise mutual information log2(n' N / (n df)), with n
texts that hold the value and N texts, is reported beside it; it grows with the corpus
for any word that is rare, so it decides nothing. A word is a run of letters outside e-mail
addresses, in lower case. Copies of a text count once in all of n, n', df and N.

A null text is read as empty and has no spans. Spans are in code points, end
exclusive. Identical texts get identical spans; rows are never merged or dropped, an empty
table gives an empty result, long texts are read whole, and columns of any name pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.staging import once
from tallyguard.llm.decontaminate import if_small
from tallyguard.llm.text import or_empty, packed
from tallyguard.operators.ordering import join_per_key
from tallyguard.session import materialize

#: Kind to expression. A match starts where a run of its first class starts, or where
#: the last match ended; possessive repeats then match the same in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}+"
GENERALISE, REMOVE = 0.75, 0.9
#: A word in the value's texts only reaches the lower threshold from this many texts on.
LEAST = math.ceil(GENERALISE / (1 - GENERALISE))
BLOCK = 256
#: Candidate words, about 40 bytes each, up to which their list goes to every task.
BROADCAST_TERMS = 1_000_000
#: Copies of a text from which its rows are spread over tasks.
HOT_COPIES = 100_000


def starts(lengths: Column, before: Column) -> Column:
    """Running offset of each match: the units before it and the piece just before it.

    ``lengths`` are unit lengths (piece and match). Sums go over blocks, so one
    element costs at most a block and the number of blocks, not the whole array.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def start(piece: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        return (_sum(F.slice(blocks, F.lit(1), b))
                + _sum(F.slice(lengths, b * BLOCK + 1, i - b * BLOCK)) + piece)

    return F.transform(before, start)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def located(df: DataFrame, text: str, pattern: str | Column, name: str, wanted: Column) -> DataFrame:
    """Adds ``name``: array of (s, e, v) of every match, and ``name_p``: the pieces between.

    Both are null where ``wanted`` is false or nothing matches. The pieces that the
    expression splits off and its matches alternate, which gives the offsets.
    """
    t, pattern = F.col(text), F.lit(pattern)
    df = once(df, _m=F.when(wanted, F.regexp_extract_all(t, pattern, 0)))
    df = once(df, **{f"{name}_p": F.when(F.size("_m") > 0, F.split(t, pattern))})
    pieces, found = F.col(f"{name}_p"), F.col("_m")
    df = once(df, _l=F.transform(found, lambda m, i: F.length(m) + F.length(pieces[i])),
              _b=F.when(F.size("_m") > 0, F.transform(
                  F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.length(p))))
    df = once(df, _s=F.when(F.col("_b").isNotNull(), starts(F.col("_l"), F.col("_b"))))
    both = F.zip_with("_s", "_m", lambda s, m: F.struct(
        s.alias("s"), (s + F.length(m)).alias("e"), m.alias("v")))
    return once(df, **{name: both}).drop("_m", "_l", "_b", "_s")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return _sum(doubled) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        def byte(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return F.when(F.length(bare) > 3, False).otherwise(
                F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), byte)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input row, or its columns ``carry``), ``t``, per kind an array of valid
    (s, e, v), and ``held``: the distinct values. One pass without a shuffle.
    """
    df = packed(docs).select(
        F.struct(*[F.col("row")[c].alias(c) for c in carry or docs.columns]).alias("row"),
        or_empty(F.col("row")[text]).alias("t"))
    held = []
    for kind, pattern in PATTERNS.items():
        df = located(df, "t", pattern, kind, F.contains("t", F.lit(NEEDS[kind])))
        df = once(df, **{f"{kind}_k": F.coalesce(F.filter(
            kind, lambda m: valid(kind, m["v"])), F.array())})  # noqa: B023
        held.append(F.transform(f"{kind}_k", lambda m: F.concat(
            F.lit(f"{kind}:"), F.lower(m["v"]))))  # noqa: B023
    return df.select("row", "t", *[F.col(f"{k}_k").alias(k) for k in PATTERNS],
                     F.array_distinct(F.concat(*held)).alias("held"))


def terms_of(text: Column) -> Column:
    """The distinct words of a text; e-mail addresses are the only values with letters."""
    bare = F.regexp_replace(text, PATTERNS["email"], " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), 0))


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(value, term, disclosure, pmi) of the words at or over the lower threshold.

    ``found`` has (held, words) of each distinct text with values, ``texts`` (digest, t) all
    texts. Values and pairs in too few texts to reach the threshold go first, and so do words
    that are too frequent for it among the texts with values alone; neither loses anything.
    How often a word occurs in all texts is then only counted for words that are left, and
    what is shuffled for it are digests of texts that hold one.
    """
    values = materialize(found.select(F.explode("held").alias("value")).groupBy("value").agg(
        F.count("*").alias("n")).where(F.col("n") >= LEAST), "pii-values")
    held = found.select(F.explode("held").alias("value"), "words").join(
        if_small(values.select("value"), BROADCAST_TERMS), "value")
    among = found.select(F.explode("words").alias("term")).groupBy("term").agg(
        F.count("*").alias("among"))
    pairs = materialize(
        held.select("value", F.explode("words").alias("term")).groupBy("value", "term")
        .agg(F.count("*").alias("both")).where(F.col("both") >= LEAST).join(among, "term")
        .where(F.col("both") / (F.col("among") + 1) >= GENERALISE).drop("among"), "pii-pairs")
    terms = if_small(pairs.select("term").distinct(), BROADCAST_TERMS)
    spoken = texts.select("digest", F.explode(terms_of(F.col("t"))).alias("term"))
    df = (spoken.join(terms, "term", "left_semi").distinct()
          .groupBy("term").agg(F.count("*").alias("df")))
    total = texts.select("digest").distinct().agg(F.count("*").alias("total"))
    share = F.col("both") / (F.col("df") + 1)
    strong = (pairs.join(df, "term").withColumn("disclosure", share)
              .where(F.col("disclosure") >= GENERALISE))
    pmi = F.log2(F.col("both") * F.col("total") / (F.col("n") * F.col("df")))
    return strong.join(values, "value").crossJoin(F.broadcast(total)).select(
        "value", "term", "disclosure", pmi.alias("pmi"))


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, base span arrays, and ``terms``: array of (s, e, v, action).

    Only documents that hold a disclosed value are read again, for the places of the words
    that disclose it. These are joined back on the text's digest, of which hot ones are
    spread over tasks by their number.
    """
    base = base_spans(docs, text, carry)
    key = F.md5("t")
    holds = F.size("held") > 0
    light = materialize(base.select(
        "row", *PATTERNS, "held", F.when(holds, terms_of(F.col("t"))).alias("words"),
        F.when(holds, key).alias("digest")), "pii-base")
    found = light.where(holds).groupBy("digest").agg(
        F.first("held").alias("held"), F.first("words").alias("words"), F.count("*").alias("copies"))
    texts = (packed(docs).select(or_empty(F.col("row")[text]).alias("t"))
             .withColumn("digest", key))
    flagged = materialize(disclosing(found, texts), "pii-flagged")
    # Which words to look for in which text.
    wanted = materialize(
        found.select("digest", "copies", F.explode("held").alias("value"))
        .join(if_small(flagged, BROADCAST_TERMS), "value").groupBy("digest", "term")
        .agg(F.max("disclosure").alias("disclosure"), F.first("copies").alias("copies"))
        .groupBy("digest").agg(F.first("copies").alias("copies"), F.map_from_entries(
            F.collect_list(F.struct("term", "disclosure"))).alias("wanted")), "pii-wanted")
    again = (texts.join(if_small(wanted.select("digest"), BROADCAST_TERMS), "digest", "left_semi")
             .dropDuplicates(["digest"]).join(wanted, "digest"))
    # Words are letters only, so they are patterns as they stand; whole runs of letters count.
    any_of = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("wanted"), "|"),
                      F.lit(r")(?!\p{L})"))
    again = located(again, "t", any_of, "hits", F.lit(True))
    action = lambda m: F.when(
        F.try_element_at("wanted", F.lower(m["v"])) >= REMOVE, "remove").otherwise("generalise")
    hits = F.transform(
        F.filter("hits", lambda m: F.map_contains_key("wanted", F.lower(m["v"]))),
        lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v"),
                           action(m).alias("action")))
    spans = again.select("digest", "copies", hits.alias("terms"))
    # A document without personal data has a key of its own that matches nothing.
    left = light.drop("held", "words").withColumn(
        "digest", F.coalesce("digest", F.xxhash64("row").cast("string")))
    return (join_per_key(left, spans, "digest", "row", count="copies", hot_rows=HOT_COPIES)
            .select("row", *PATTERNS, F.coalesce("terms", F.array()).alias("terms")))


def _said(kind: str, column: str | None = None) -> Column:
    return F.transform(column or kind, lambda m: F.concat(
        F.lit(f"{kind}:"), m["s"].cast("string"), F.lit(":"), m["e"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans per document."""
    rows = scan(docs.select("doc_id", "text"), carry=["doc_id"])
    base = F.concat(*[_said(k) for k in PATTERNS])
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _said("term", "terms")), ",").alias("spans"))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind; generalised terms keep their initial.

    Spans that overlap (digits of a card inside a phone number, say) are merged first.
    """
    rows = scan(docs, text)

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"), F.lit(f"[{kind}]").alias("to")))

    every = F.concat(
        *map(marked, PATTERNS),
        F.transform("terms", lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"), F.when(m["action"] == "remove", "[term]")
            .otherwise(F.concat(F.left(m["v"], F.lit(1)), F.lit("***"))).alias("to"))))
    rows = once(rows, spans=F.sort_array(every))
    old = F.col("row")[text]
    # A span is cut to what lies after all earlier ones; contained spans become empty.
    pieces = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, m: F.when(m["e"] <= acc["at"], acc).otherwise(F.struct(
            m["e"].alias("at"), F.concat(acc["out"], F.array(
                F.substring(old, acc["at"] + 1, F.greatest(m["s"] - acc["at"], F.lit(0))),
                m["to"])).alias("out"))))
    new = F.concat(F.array_join(pieces["out"], ""),
                   F.substring(old, pieces["at"] + 1, F.length(old)))
    names = docs.columns
    return rows.select("row", F.when(F.size("spans") == 0, old).otherwise(new).alias("new")).select(
        *[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])
