"""Personal data: spans by pattern, and terms that give protected entities away.

Patterns find entities (emails, addresses, cards, phones). Over all lines of the corpus, the share of a term's lines in which it
stands near an entity tells how much the term discloses: pointwise mutual information of term and entity, as a share of what the
entity itself says. Terms above a threshold are generalised to what they hint at; those that all but name the entity are removed.

Everything here is built-in expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import put_columns, staged

# The patterns. Possessive forms of the plain ones, with starts inside a run ruled out, so that long runs take linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"  # a whole run of 12 to 19 digits
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}{4,}"

MARK, STAND_IN = "\u0001", "\u0002"  # MARK surrounds matches; a MARK of the text itself is read as STAND_IN, which no pattern matches
NEAR = 120  # code points on either side of an entity that count as near
SUPPORT = 3  # different lines in which a term must stand near an entity
DISCLOSES = 0.8
NAMES = 0.95
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,label:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    def worth(d: Column, i: Column) -> Column:
        n = d.try_cast("int")
        twice = F.when(n * 2 > 9, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, twice).otherwise(n)

    worths = F.transform(F.split(F.reverse(_digits(c)), "(?<=[0-9])(?=[0-9])"), worth)
    return F.aggregate(worths, F.lit(0), lambda a, n: a + n) % 10 == 0


def _low_parts(c: Column) -> Column:
    short = F.transform(F.split(c, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))  # of zeros, nothing is left


def _phone_length(c: Column) -> Column:
    return F.length(_digits(c)).between(9, 15)


# pattern, whether a match counts, and what a text needs for the pattern to be tried at all
RULES = {
    "email": (EMAIL, lambda c: F.lit(True), lambda t: t.contains("@")),
    "ip": (IP, _low_parts, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (CARD, _luhn, lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}")),
    "phone": (PHONE, _phone_length, lambda t: t.rlike(r"\+[0-9]")),
}


def _pieces(text: Column, pattern) -> Column:
    """The text cut before and after each match: every second piece is a match."""
    replacement = F.lit(f"{MARK}$0{MARK}")
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, replacement), MARK, -1)


def _collect(pieces: Column, rank: int, kind: str, valid, label) -> Column:
    """Spans of the matches that count; positions are code points."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(SPANS).alias("found"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), label(p).alias("label"))
        more = F.when(a["odd"] & valid(p), F.concat(a["found"], F.array(span))).otherwise(a["found"])
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), more.alias("found"))

    return F.aggregate(pieces, start, step, lambda a: a["found"])


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start, then kind as listed."""
    none = F.array().cast(SPANS)
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern, valid, needs = RULES[kind]
        found = _collect(_pieces(text, F.lit(pattern)), rank, kind, valid, lambda p, k=kind: F.lit(f"[{k.upper()}]"))
        parts.append(F.when(needs(text), found).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, EMAIL, " ")), F.lit(TERM), F.lit(0))
    return F.array_distinct(words)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where("line <> ''")


def _entity(line: Column, span: Column) -> Column:
    """The protected value of a span, spelled one way."""
    value = F.substring(line, span["start"] + 1, span["end"] - span["start"])
    spelled = F.when(span["kind"] == "email", F.lower(value)).when(span["kind"] == "ip", value).otherwise(_digits(value))
    return F.concat_ws(":", span["kind"], spelled)


def _window(line: Column, span: Column) -> Column:
    """What stands within NEAR code points of a span; words that the window cuts are left out."""
    before = F.substring(line, F.greatest(span["start"] - NEAR + 1, F.lit(1)), F.least(span["start"], F.lit(NEAR)))
    after = F.substring(line, span["end"] + 1, F.lit(NEAR))
    before = F.when(span["start"] > NEAR, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
    after = F.when(F.length(line) > span["end"] + NEAR, F.regexp_replace(after, r"(?<!\S)\S+$", "")).otherwise(after)
    return F.concat_ws(" ", before, after)


def disclosing_terms(docs: DataFrame, text: str = "text", discloses: float = DISCLOSES, names: float = NAMES) -> DataFrame:
    """(term, label): terms whose disclosure of some entity reaches the threshold, over all lines of all texts.

    Disclosure = PMI(term; entity) / information of the entity: 1 where the term occurs in no line without the entity near it. The
    label stands for the term: a hint at the kind of entity, or nothing from ``names`` on. Counts are of lines, copies included, but a
    term must stand near the entity in SUPPORT different lines. The table's size follows the entities that recur.
    """
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where("line <> ''")
    found = lines.where(F.col("line").rlike("[0-9@]")).withColumn("spans", base_spans(F.col("line"))).where(F.size("spans") > 0)
    found = staged(found.groupBy("line", "spans").agg(F.count("*").alias("times")))  # copies of a line meet here

    each = found.select(F.xxhash64("line").alias("key"), "times", "line", F.explode("spans").alias("span"))
    line, span = F.col("line"), F.col("span")
    pairs = each.select("key", "times", span["kind"].alias("kind"), _entity(line, span).alias("entity"), F.explode(_terms(_window(line, span))).alias("term"))
    once = pairs.groupBy("key", "term", "entity", "kind").agg(F.first("times").alias("times"))
    near = once.groupBy("term", "entity", "kind").agg(F.sum("times").alias("both"), F.count("*").alias("different"))
    near = staged(near.where(F.col("different") >= SUPPORT).select("term", "entity", "kind", "both"))

    # counted before they meet the wanted terms: a row per word leaves a task, not one per occurrence
    words = lines.select(F.explode(_terms(line)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    held = words.join(near.select("term").distinct(), "term")
    entities = found.select("times", F.explode(F.array_distinct(F.transform("spans", lambda s: _entity(line, s)))).alias("entity"))
    entities = entities.groupBy("entity").agg(F.sum("times").alias("n_entity"))

    log_all = F.log(F.lit(float(max(lines.count(), 1))))
    joined = near.join(held, "term").join(entities, "entity").withColumn("own", log_all - F.log("n_entity")).where("own > 0")
    weight = (F.log("both") + log_all - F.log("n_term") - F.log("n_entity")) / F.col("own")
    weighed = joined.select("term", weight.alias("weight"), "kind").where(F.col("weight") >= discloses)
    best = weighed.groupBy("term").agg(F.max(F.struct("weight", "kind")).alias("best"))
    label = F.when(F.col("best.weight") >= names, F.lit("")).otherwise(F.concat(F.lit("["), F.col("best.kind"), F.lit(" context]")))
    return best.select("term", label.alias("label"))


def _merged(spans: Column) -> Column:
    """Spans that overlap become one, under the first label."""
    start = F.array().cast(SPANS)

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        overlaps = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(spans, start, step)


def _rewritten(text: Column, spans: Column) -> Column:
    def part(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, i)["end"])
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), s["label"])

    end = F.try_element_at(spans, F.lit(-1))["end"]
    tail = F.substring(text, end + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(spans, part), ""), tail))


def sanitise(docs: DataFrame, terms: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with pii_base and pii_spans (spans by start, then kind: emails, ips, cards, phones, terms; code points, end exclusive)
    and pii_text (the text with every span's label in its place; overlapping spans share the first one's label).

    terms: a table from ``disclosing_terms``, made from ``docs`` where none is given. A null text counts as empty. Repeated rows stay;
    input columns named like the new ones give way.
    """
    terms = staged(disclosing_terms(docs, text) if terms is None else terms)
    content = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(content)  # texts that share a key by accident share terms that only one of them holds: no match, no harm
    held = docs.select(key.alias("__key"), F.explode(_terms(content)).alias("term")).join(terms, "term")
    # bounded by the words of one text; written first, so that Spark knows its size and need not shuffle the texts to meet a few rows
    held = staged(held.groupBy("__key").agg(F.collect_set(F.struct("term", "label")).alias("__terms")))
    found = docs.withColumn("__key", key).join(held, "__key", "left").withColumn("__base", base_spans(content))
    labels = F.map_from_entries("__terms")
    words = F.array_join(F.array_sort(F.transform("__terms", lambda t: t["term"])), "|")
    pattern = F.concat(F.lit(EMAIL + r"|(?iu:(?<!\p{L})(?:"), words, F.lit(r")(?!\p{L}))"))
    marked = _collect(_pieces(content, pattern), len(KINDS), "term", lambda p: labels[F.lower(p)].isNotNull(), lambda p: labels[F.lower(p)])
    extra = F.when(F.col("__terms").isNotNull(), marked).otherwise(F.array().cast(SPANS))
    found = found.withColumn("__all", F.when(F.size(extra) > 0, F.array_sort(F.concat("__base", extra))).otherwise(F.col("__base")))
    found = found.withColumn("__merged", _merged(F.col("__all")))
    out = put_columns(found, pii_base=F.col("__base"), pii_spans=F.col("__all"), pii_text=_rewritten(content, F.col("__merged")))
    return out.drop("__key", "__terms", "__base", "__all", "__merged")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
