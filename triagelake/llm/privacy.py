"""Operator 3. Personal data, and terms that give it away. Built-in functions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers found by pattern in whole texts.
On top of them comes information-theoretic sanitisation: each base value is a protected entity c, and a term t of a
document that holds it reveals it as strongly as their co-occurrence in the corpus says, PMI(c; t) = log2(p(c|t) / p(c)),
measured against what there is to reveal, IC(c) = log2(1 / p(c)). Where the ratio reaches a threshold, every occurrence
of the term in the documents with c is generalised to its kind, above a higher one it is removed. All counts n are of
whole documents of the whole corpus.

With p(c) = n(c) / N, p(c|t) is (n(c,t) + PRIOR p(c)) / (n(t) + PRIOR): PRIOR documents' worth of independence are added
to what was seen, so few documents say less than many of the same ratio, and a value seen only once is judged too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.once import computed
from triagelake.llm.shared import quoted, stored, table, text_key

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns. Possessive repeats and the look-behind change no match: they keep long runs of word
# characters or digits from being tried again from each of their positions, and from deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"

#: Documents with a term that are assumed besides those seen, in which the value stands as often as anywhere.
PRIOR = 1.0
GENERALISE_AT, REMOVE_AT = 0.8, 0.95

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def located(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches with their places in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.char_length(g).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        more = F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(x["hit"].isNull(), acc).otherwise(more)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string of 12 to 19 places holds; every second digit from the right doubles."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.char_length(digits) - i) % 2 == 1
        return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid_ip(value: Column) -> Column:
    # No number above 255, leading zeros aside; tested as text, so that a part may have any length.
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """All valid base spans of a text by start, then kind; none for null. Each pattern runs only where it can match."""
    none = F.array().cast(_SPAN)
    text = F.coalesce(text, F.lit(""))
    email = F.when(text.contains("@"), located(text, EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP, 1), lambda s: _valid_ip(s["value"]))).otherwise(none)

    def is_card(s: Column) -> Column:
        d = _digits(s["value"])
        return F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False)

    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(located(text, CARD, 2), is_card)).otherwise(none)
    phone = F.when(text.contains("+"), F.filter(located(text, PHONE, 3), lambda s: F.char_length(_digits(s["value"])).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def with_base(docs: DataFrame) -> DataFrame:
    """The rows with `_key` (of the text) and `_base` spans, each computed once."""
    return computed(docs, _key=text_key(), _base=base_spans(F.col("text")))


def _terms_of(text: Column) -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _holding(rows: DataFrame) -> DataFrame:
    """The rows that hold base values: doc_id, _key, text, _base, their distinct entities and terms. Each row once."""
    entity = lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(F.regexp_replace(s["value"], r"[\x20()-]", "")))
    some = rows.filter((F.size("_base") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "_key", "text", "_base").dropDuplicates(["doc_id", "_key"])
    return computed(some, entities=F.array_distinct(F.transform("_base", entity)), terms=_terms_of(F.col("text")))


def _pairs(held: DataFrame) -> DataFrame:
    return held.select("doc_id", "_key", "terms", F.explode("entities").alias("entity")).select("doc_id", "_key", "entity", F.explode("terms").alias("term"))


def disclosures(docs: DataFrame, held: DataFrame, prior: float = PRIOR) -> DataFrame:
    """entity, term and the share of the entity's information that the term reveals, for all that stand in one document."""
    # Each document counts a term once; counts are summed in every task before they are exchanged.
    pair = _pairs(held).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"))
    known = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    seen = docs.select(F.explode(_terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    base = F.col("n_c") / F.col("n")
    given = (F.col("n_ct") + prior * base) / (F.col("n_t") + prior)
    counted = pair.join(known, "entity").join(seen, "term").join(F.broadcast(total))  # one row
    return counted.filter(F.col("n_c") < F.col("n")).select("entity", "term", (1 - F.log2(given) / F.log2(base)).alias("share"))


def _strong_spans(text: Column, base: Column, shares: Column, remove_at: float) -> Column:
    """Spans of the terms in the map `shares`, by start; a term that meets a base span has none."""
    hits, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    steps = F.zip_with(hits, gaps, lambda h, g: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("size"), shares[F.lower(h)].alias("share")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        becomes = F.when(x["share"] >= remove_at, "").otherwise("<term>")
        span = F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end"), becomes.alias("value"))
        out = F.when(x["share"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.when(x["size"].isNull(), acc).otherwise(F.struct(end.alias("at"), out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.filter(found, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def term_spans(docs: DataFrame, rows: DataFrame, prior: float = PRIOR, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """doc_id, _key and `_terms`, the spans of terms that reveal a value of their document; value says what becomes of
    them. The strongest disclosure of a term in a document decides."""
    # Read four times below, so it is written once instead.
    held = stored(_holding(rows), "holding")
    strong = disclosures(docs, held, prior).filter(F.col("share") >= generalise_at)
    worst = _pairs(held).join(strong, ["entity", "term"]).groupBy("doc_id", "_key", "term").agg(F.max("share").alias("share"))
    by_row = worst.groupBy("doc_id", "_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    found = held.select("doc_id", "_key", "text", "_base").join(by_row, ["doc_id", "_key"])
    return computed(found, _terms=_strong_spans(F.col("text"), F.col("_base"), F.col("shares"), remove_at)).select("doc_id", "_key", "_terms")


def find_personal_data(docs: DataFrame, **settings) -> DataFrame:
    """Every row's doc_id, text, `base` spans and `terms` spans: (start, kind, end, value), kind an index of KINDS.

    A null or empty text has no spans. Rows that repeat with the same id and text share their spans and count once in
    the corpus. Rows without a doc_id have base spans but no terms. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    rows = with_base(docs)
    terms = term_spans(docs, rows, **settings)
    joined = rows.join(terms, ["doc_id", "_key"], "left")
    return joined.select("doc_id", "text", F.col("_base").alias("base"), F.coalesce("_terms", F.array().cast(_SPAN)).alias("terms"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced: a base span by its kind in angle brackets, a term by its value.

    Of overlapping spans the first gives the replacement and all of their characters go.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["at"], s["end"])
        put = F.when(s["kind"] == 4, s["value"]).otherwise(names[s["kind"]])
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put)
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """All rows and columns with personal data and revealing terms taken out of `text`; n_chars follows if present."""
    names = docs.columns
    rest = quoted(docs, "doc_id", "text")
    # The other columns travel as one, so that none of them can clash with the working ones.
    rows = with_base(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_row")))
    terms = term_spans(docs.select("doc_id", "text"), with_base(docs.select("doc_id", "text")), **settings)
    joined = rows.join(terms, ["doc_id", "_key"], "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_terms", F.array().cast(_SPAN))))
    out = joined.withColumn("_spans", spans).withColumn("text", redacted(F.col("text"), F.col("_spans")))
    length = F.when(F.size("_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in names else None
    return out.select(*[F.col(c) if c in ("doc_id", "text") else length.alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in names])


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))
