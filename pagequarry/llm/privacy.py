"""Personal data by patterns, and information-theoretic sanitisation of what gives it away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each different one is an entity to protect. A
term (a word anywhere in a text) discloses an entity if knowing the term tells most of what there is to know: with
document counts over the whole corpus, PMI(term; entity) = log2(n_both * n / (n_term * n_entity)) reaches DISCLOSURE of the entity's
information log2(n / n_entity), and at least SUPPORT different texts show both. Such terms get spans of kind `term` at all their
places, in texts with and without the entity; sanitise() generalises entities to their kind and removes disclosing terms. Words that
overlap a base span are no terms: neither counted nor spanned.

Places come from two built-in functions that walk a text alike: the matches of a pattern and what lies between them; a
running sum of their lengths, near linear in the matches, gives each match its place in code points. Separators that a pattern allows inside a match are
first replaced by a control character, one for one, so that every pattern is a chain of plain character classes: linear in the
text, and without recursion for very long matches. All of it is built-in column expressions and joins.

Defined results: null texts are empty and have no spans; repeated rows get the same spans; an entity in all documents has no
information and discloses nothing; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import sketch, with_sketch
from pagequarry.llm.common import written as kept
from pagequarry.llm.shingles import sent_if_small

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of an entity's information, different texts, and letters of a term.
DISCLOSURE, SUPPORT, LETTERS = 0.9, 2, 3

JOIN, WAS_JOIN = "\u0001", "\u0002"
LOCAL = rf"A-Za-z0-9._%+{JOIN}-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{JOIN}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TERM = rf"\p{{L}}{{{LETTERS},}}+"
#: Stand for an end of a span that is a letter, and for another.
LETTER, OTHER = "\u0001", "\u0002"

SPANS = "array<struct<start:int,kind:int,end:int>>"


def none() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def bound(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often and within whatever function the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join, zero: Column) -> Column:
    """For each of the values what `join` makes of those before it.

    Stretches of about the cube root of their number n come first, so that no value looks at more than one stretch and the
    stretches before it: n to the power 4/3 steps in all.
    """
    fold = lambda x: F.aggregate(x, zero, join)

    def of(v: Column, size: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.ceil(F.size(v) / size).cast("int")), lambda c: fold(F.slice(v, (c - 1) * size + 1, size)))
        before = lambda parts: F.transform(parts, lambda x, c: fold(F.slice(parts, F.lit(1), c)))
        place = lambda i: F.floor(i / size).cast("int")
        within = lambda base: F.transform(v, lambda x, i: join(F.get(base, place(i)), fold(F.slice(v, place(i) * size + 1, i % size))))
        return F.when(F.size(v) > 0, bound(each, lambda parts: bound(before(parts), within))).otherwise(F.slice(v, F.lit(1), F.lit(0)))

    return bound(values, lambda v: bound(F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(v))).cast("int")), lambda size: of(v, size)))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping, with the matched text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))), lambda p: p["m"].isNotNull())

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["g"] + F.length(x["m"])), lambda a, b: a + b, F.lit(0))

        def span(x: Column, start: Column) -> Column:
            return F.struct((start + x["g"]).alias("start"), F.lit(kind).alias("kind"), (start + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("value"))

        return F.zip_with(p, before, span)

    return bound(pairs, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, value) of e-mail addresses, IP addresses, card and phone numbers, by start and then kind."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), JOIN, WAS_JOIN)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    email = F.when(F.contains(plain, F.lit("@")), matches(dotted, EMAIL, 0)).otherwise(nothing)
    numbers = plain.rlike("[0-9]")
    ip = F.when(numbers, F.filter(matches(plain, IP, 1), lambda s: s["value"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))).otherwise(nothing)
    cards = F.filter(matches(joined, CARD, 2), lambda s: F.length(digits(s["value"])).between(14, 19))
    card = F.when(numbers, F.filter(cards, lambda s: F.call_function("luhn_check", digits(s["value"])))).otherwise(nothing)
    phone = F.when(F.contains(plain, F.lit("+")), F.filter(matches(plain, PHONE, 3), lambda s: F.length(digits(s["value"])).between(10, 15))).otherwise(nothing)
    return F.sort_array(F.concat(email, ip, card, phone))


def entity(span: Column) -> Column:
    """What a span stands for: its kind, and its letters or digits."""
    value = F.when(span["kind"] == 0, F.lower(F.replace(span["value"], F.lit(JOIN), F.lit(".")))).when(span["kind"] == 1, span["value"]).otherwise(digits(span["value"]))
    return F.xxhash64(span["kind"], value)


def outside(text: Column, spans: Column) -> Column:
    """The text with each span, or spans that overlap, replaced by two characters that say whether its ends are letters."""

    def end(at: Column) -> Column:
        return F.when(F.substr(text, at, F.lit(1)).rlike(r"\p{L}"), LETTER).otherwise(OTHER)

    def parts(ends: Column) -> Column:
        between = lambda s, at: F.substr(text, at + 1, F.greatest(F.lit(0), s["start"] - at))
        pieces = F.zip_with(spans, ends, lambda s, at: F.concat(between(s, at), end(s["start"] + 1), end(s["end"])))
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1))

    return bound(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)), parts)


def terms_of(text: Column, spans: Column) -> Column:
    """Hashes of the different terms of a text that overlap no span."""
    plain = bound(F.translate(text, LETTER, OTHER), lambda t: F.when(F.size(spans) > 0, outside(t, spans)).otherwise(t))
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![\p{{L}}{LETTER}]){TERM}(?!{LETTER})"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lower(w))))


def terms_at(text: Column, spans: Column) -> Column:
    """Spans (start, kind, end, value) of all terms of a text that overlap none of `spans`."""
    clear = lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return F.filter(matches(text, TERM, 4), clear)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(id, text_hash, base, terms) for every row: base spans, and the spans of terms that disclose an entity; (start, kind, end) each."""
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(plain).alias("text_hash"), plain.alias("text"))
    rows = texts.withColumn("spans", base_spans(F.col("text")))
    bare = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    own_terms = F.when(F.size("spans") > 0, bound(F.col("spans"), lambda spans: terms_of(F.col("text"), spans)))
    found = kept(rows.select("id", "text_hash", bare.alias("base"), F.array_distinct(F.transform("spans", entity)).alias("entities"), own_terms.alias("terms")))
    held = found.where(F.size("entities") > 0).dropDuplicates(["id", "text_hash"])

    # n_term * n_entity / n_both is n_term at least, which leaves few terms before the terms and entities of a text are paired
    one = F.lit(1).alias("one")
    total = found.agg(F.count("*").alias("n")).select("n", one)
    listed = held.select("id", "text_hash", F.explode("entities").alias("entity"))
    of_entity = listed.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("text_hash").alias("texts")).where(F.col("texts") >= support).select("entity", "n_entity", one)
    of_entity = of_entity.join(F.broadcast(total), "one").where("n > n_entity").withColumn("least", disclosure * F.log2(F.col("n") / F.col("n_entity"))).drop("one")
    of_term = rows.select(F.explode_outer(bound(F.col("spans"), lambda spans: terms_of(F.col("text"), spans))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n_term"))
    seen = held.select("id", "text_hash", F.explode("terms").alias("term")).join(of_term, "term").withColumnsRenamed({"id": "of_id", "text_hash": "of_hash"})
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    both = listed.join(of_entity, "entity").join(seen, same & (F.log2(F.col("n") / F.col("n_term")) >= F.col("least") - 1e-9))
    both = both.groupBy("entity", "term", "n_entity", "n_term", "n", "least").agg(F.count("*").alias("n_both"), F.count_distinct("text_hash").alias("texts"))
    pmi = F.log2(F.col("n_both") * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    telling = kept(both.where((F.col("texts") >= support) & (pmi >= F.col("least") - 1e-9)).select("term").distinct())

    # every term with its place, of which only those that a sketch can't rule out are shuffled; no text is
    said = rows.select("id", "text_hash", F.explode_outer(bound(F.col("spans"), lambda spans: terms_at(F.col("text"), spans))).alias("t")).select("id", "text_hash", "t", F.xxhash64(F.lower("t.value")).alias("term"))
    said = with_sketch(said, F.col("term"), sketch(telling, F.col("term")), "may").where("may AND t IS NOT NULL").select("id", "text_hash", "term", F.struct("t.start", "t.kind", "t.end").alias("t"))
    spotted = said.join(sent_if_small(telling), "term").groupBy("id", "text_hash").agg(F.collect_set("t").alias("terms")).select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"), F.sort_array("terms").alias("terms"))
    every = found.select("id", "text_hash", "base")
    return every.join(spotted, same, "left").select("id", "text_hash", "base", F.coalesce("terms", none()).alias("terms"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with entities generalised to [KIND] and disclosing terms removed; where spans overlap the first to start wins."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:-1]), F.lit(""))

    def step(state: Column, s: Column) -> Column:
        more = F.array(F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["parts"], more).alias("parts")))

    return F.aggregate(F.sort_array(spans), start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, s["at"] + 1)))
