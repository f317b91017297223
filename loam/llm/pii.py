"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence. DataFrame functions only.

Pattern spans are e-mail addresses, IP addresses, card and phone numbers. The protected entities are their values, the
groups of these (mail domain, network, issuer, area), their kinds, and personal data at all. A term is a run of letters or
digits outside those spans; one with digits stands for all of its length, so that keys and other secrets, each of
which occurs once, are judged together. A term t reveals an entity e as far as it tells that e is there:
PMI(t; e) / IC(e) = 1 - log p(e | t) / log p(e), where p(e | t) is the lower bound of a one-sided interval, since counts may be
small. Frequencies are those of documents over the whole corpus, copies and near copies counted as one: a text counts for nothing if
it shares four fifths of all words with one of lesser key, which candidates by MinHash bands are checked for, word by word. At 1 the
term gives the entity away; terms above a threshold are generalised to a tag and those above a higher one removed, wherever they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Patterns as the base spans are stated, with possessive repeats, which give the same matches here and
# need no stack, and with look-behinds that skip starts which fail as the run's first character failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
RUN = r"[\p{L}\p{N}]+"
#: Candidates for near copies agree in all MinHash values of a band of their words; bands, and values of each.
BANDS, SIGNS = 4, 6
#: Percent of the words of two texts together that near copies share.
SHARED = 80
#: Steps whose arrays grow together; longer folds go in runs of so many.
FOLD = 512
#: Quantile of the one-sided interval of p(e | t).
Z = 1.64
#: Bytes of a table that a broadcast may hold; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
SPANS = "array<struct<start:int,stop:int,value:string>>"
TERMS = "array<struct<start:int,stop:int,value:string,removed:boolean>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """13 to 19 digits with a Luhn sum that ten divides."""
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


#: Kind, pattern, test of a match, and what every text with a match must show.
KINDS = (
    ("email", EMAIL, lambda v: F.lit(True), lambda t: F.instr(t, "@") > 0),
    ("ip", IP, lambda v: v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"), lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", CARD, _luhn, lambda t: t.rlike("[0-9][\\x20-]?[0-9]")),
    ("phone", PHONE, lambda v: F.length(_digits(v)).between(9, 15), lambda t: t.rlike(r"\+[0-9]")),
)
NAMES = [k for k, *_ in KINDS]


def _fold(items: Column, state: Column, add) -> Column:
    """What ``add(state, item)`` appends to the arrays of ``state`` (at, out), in all: the array ``out``.

    An array that grows by one is copied each time, so runs of FOLD items are folded apart and then joined.
    """

    def run(whole: Column, outer: Column, i: Column) -> Column:
        begin = F.struct(outer["at"].alias("at"), F.slice(outer["none"], 1, 0).alias("out"))
        inner = F.aggregate(F.slice(whole, i * FOLD + 1, F.lit(FOLD)), begin, add)
        # The inner fold is bound to a name: it would be run again for each use.
        joined = F.transform(F.array(inner), lambda s: F.struct(s["at"].alias("at"), outer["none"].alias("none"), F.concat(outer["out"], F.array(s["out"])).alias("out")))
        return joined[0]

    begin = F.struct(state["at"].alias("at"), state["out"].alias("none"), F.slice(F.array(state["out"]), 1, 0).alias("out"))

    def folded(whole: Column) -> Column:
        runs = F.when(F.size(whole) > 0, F.sequence(F.lit(0), ((F.size(whole) - 1) / FOLD).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(runs, begin, lambda outer, i: run(whole, outer, i), lambda s: F.flatten(s["out"]))

    return F.transform(F.array(items), folded)[0]


def matches(text: Column, pattern: str, test=lambda v: F.lit(True)) -> Column:
    """start, stop (code points, stop exclusive) and value of the leftmost matches that don't overlap and pass ``test``."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        longer = F.concat(state["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"))))
        return F.struct(stop.alias("at"), F.when(test(x["value"]), longer).otherwise(state["out"]).alias("out"))

    return _fold(F.filter(pairs, lambda x: x["value"].isNotNull()), begin, step)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of spans (start, stop, value) for each kind; null texts have none."""
    text = F.col("text")
    for kind, pattern, test, shows in KINDS:
        docs = docs.withColumn(kind, F.when(shows(text), matches(text, pattern, test)).otherwise(F.array().cast(SPANS)))
    return docs


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with the spans (start, order = -stop, put) replaced; of overlapping ones the first and longest counts."""
    text_type = "array<string>"
    begin = F.struct(F.struct(F.lit(0).alias("done"), text.alias("rest")).alias("at"), F.array().cast(text_type).alias("out"))

    def step(state: Column, m: Column) -> Column:
        at = state["at"]
        skip = m["start"] - at["done"]
        rest = F.substring(at["rest"], 1 - m["order"] - at["done"], F.length(at["rest"]))
        new = F.struct(F.struct((-m["order"]).alias("done"), rest.alias("rest")).alias("at"), F.concat(state["out"], F.array(F.substring(at["rest"], F.lit(1), skip), m["put"])).alias("out"))
        return F.when(skip >= 0, new).otherwise(state)

    # What is left behind the last span that counts.
    stop = F.aggregate(F.array_sort(spans), F.lit(0), lambda at, m: F.when(m["start"] >= at, -m["order"]).otherwise(at))
    return F.concat(F.array_join(_fold(F.array_sort(spans), begin, step), ""), F.substring(text, stop + 1, F.length(text)))


def _marks(column: str, put: Column) -> Column:
    return F.transform(column, lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("order"), put.alias("put")))


def words_of(text: Column) -> Column:
    """The distinct runs of letters and digits, lower-cased, of three characters or more and a letter."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}"))


def term_of(word: Column) -> Column:
    """The term that a word counts as: itself, or with digits its length."""
    return F.when(word.rlike(r"\p{N}"), F.concat(F.lit("#"), F.length(word))).otherwise(word)


def entities(kind: str) -> Column:
    """The entities that the spans of a kind stand for, but for the kind itself."""
    group = {
        "email": lambda v: F.substring_index(v, "@", -1),
        "ip": lambda v: F.substring_index(v, ".", 2),
        "card": lambda v: F.substring(_digits(v), 1, 6),
        "phone": lambda v: F.substring(_digits(v), 1, 4),
    }[kind]
    values = F.transform(kind, lambda m: F.concat(F.lit(f"{kind}:"), F.lower(m["value"])))
    groups = F.transform(kind, lambda m: F.concat(F.lit(f"{kind} of "), F.lower(group(m["value"]))))
    return F.concat(values, groups)


def _any() -> Column:
    return reduce(Column.__or__, [F.size(k) > 0 for k in NAMES])


def _bands(words: Column) -> Column:
    """A key for each band of MinHash values of the words; none where there are no words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        value = lambda k: F.array_min(F.transform(h, lambda x: F.xxhash64(F.lit(k), x)))
        return F.array(*[F.xxhash64(*[value(b * SIGNS + k) for k in range(SIGNS)]) for b in range(BANDS)])

    # Bound to a name, so that words are hashed once.
    return F.when(F.size(words) > 0, F.transform(F.array(hashes), of)[0]).otherwise(F.array().cast("array<bigint>"))


def analysed(docs: DataFrame) -> DataFrame:
    """number, doc_key, the base spans, words, and the bands of every text that is not null, in the shared folder."""
    rows = docs.where(F.col("text").isNotNull()).select(F.md5("text").alias("doc_key"), F.col("text").cast("string").alias("text"))
    rows = base_spans(rows)
    masked = replaced(F.col("text"), F.concat(*[_marks(k, F.lit(" ")) for k in NAMES]))
    rows = rows.withColumn("words", words_of(F.when(_any(), masked).otherwise(F.col("text")))).drop("text")
    return materialize(rows.withColumn("bands", _bands(F.col("words"))).withColumn("number", F.monotonically_increasing_id()), "analysed")


def near_copies(found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_key, head: texts that share SHARED percent of their words with the text ``head``, of lesser key; see ``analysed``.

    A text is held against the least key of each of its bands, so a text with none below it stays, and no two are put together unseen.
    """
    keyed = found.select("doc_key", F.posexplode("bands").alias("band", "key"))
    heads = keyed.groupBy("band", "key").agg(F.min("doc_key").alias("head"), F.max("doc_key").alias("last")).where("head < last").drop("last")
    pairs = materialize(keyed.join(heads, ["band", "key"]).where("doc_key > head").select("doc_key", "head").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("doc_key", "head")).alias("doc_key")).distinct()
    words = found.select("doc_key", "words").join(_fit(ends, broadcast_bytes, F.octet_length("doc_key")), "doc_key").dropDuplicates(["doc_key"])
    words = materialize(words.select("doc_key", F.transform("words", lambda w: F.xxhash64(w)).alias("held")), "copy-words")
    both = pairs.join(words, "doc_key").join(words.select(F.col("doc_key").alias("head"), F.col("held").alias("other")), "head")
    shared = F.size(F.array_intersect("held", "other"))
    return both.where(shared * 100 >= SHARED * (F.size("held") + F.size("other") - shared)).select("doc_key", "head")


def counted_once(found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """number: the rows of ``found`` whose texts count, one of each text that is no near copy of one with a lesser key."""
    first = found.groupBy("doc_key").agg(F.min("number").alias("number"))
    return first.join(near_copies(found, broadcast_bytes).select("doc_key").distinct(), "doc_key", "left_anti").select("number")


def revealing_terms(found: DataFrame, support: int, generalise: float, remove: float, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """term, disclosure, removed: terms whose disclosure of some entity is at least ``generalise``. See ``analysed``.

    Copies and near copies count as one document, the one of least key. Pairs and entities in fewer than ``support`` such documents are left alone.
    """
    kinds = F.filter(F.array(*[F.when(F.size(k) > 0, F.lit(k)) for k in NAMES], F.when(_any(), F.lit("any"))), lambda x: x.isNotNull())
    known = F.array_distinct(F.concat(*map(entities, NAMES)))
    slim = found.select("number", "doc_key", F.array_distinct(F.transform("words", term_of)).alias("words"), kinds.alias("kinds"), known.alias("known"))
    # Rows that don't count are few as a rule: they are told to every task while they are, so that words stay where they lie.
    kept = materialize(counted_once(found, broadcast_bytes), "counted")
    gone = found.select("number").join(kept, "number", "left_anti")
    one = slim.join(_fit(materialize(gone, "not-counted"), broadcast_bytes), "number", "left_anti").drop("number")
    total = F.lit(float(max(kept.count(), 2)))
    counts = one.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("term_count"))
    private = one.where(F.size("kinds") > 0)
    each = private.select("doc_key", F.explode("known").alias("entity"))
    often = each.groupBy("entity").agg(F.count("*").alias("entity_count")).where(F.col("entity_count") >= support)
    more = each.join(often.select("entity"), "entity").groupBy("doc_key").agg(F.collect_list("entity").alias("more"))
    both = private.join(more, "doc_key", "left").withColumn("entity", F.explode(F.concat("kinds", F.coalesce("more", F.array().cast("array<string>")))))
    pairs = both.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    kind_count = private.select(F.explode("kinds").alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_count"))
    judged = pairs.join(counts, "term").join(often.union(kind_count), "entity")
    share, n = F.col("both") / F.col("term_count"), F.col("term_count")
    low = (share + Z**2 / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z**2 / (4 * n * n))) / (1 + Z**2 / n)
    judged = judged.withColumn("disclosure", 1 - F.log(low) / F.least(F.log(F.col("entity_count") / total), F.lit(-1e-9)))
    return judged.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise).withColumn("removed", F.col("disclosure") >= remove)


def _fit(df: DataFrame, broadcast_bytes: int, *texts: Column) -> DataFrame:
    """``df`` to be broadcast if its rows, measured by their texts, are small enough."""
    held = df.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if held <= broadcast_bytes else df


def spans_of(docs: DataFrame, support: int, generalise: float, remove: float, broadcast_bytes: int) -> DataFrame:
    """doc_key, the base spans and ``term`` of every different text of ``docs`` that has any."""
    found = analysed(docs)
    terms = materialize(revealing_terms(found, support, generalise, remove, broadcast_bytes), "terms").select("term", "removed")
    own = found.select("doc_key", F.explode("words").alias("word")).withColumn("term", term_of(F.col("word")))
    own = own.join(_fit(terms, broadcast_bytes, F.octet_length("term")), "term")
    held = materialize(own.select("doc_key", "word", "removed").distinct(), "held")
    with_terms = held.select("doc_key").distinct()
    texts = docs.where(F.col("text").isNotNull()).select(F.md5("text").alias("doc_key"), F.col("text").cast("string").alias("text"))
    texts = texts.join(_fit(with_terms, broadcast_bytes, F.octet_length("doc_key")), "doc_key").dropDuplicates(["doc_key"])
    # Words meet terms by a join, and base spans by one pass in order, so that a text with many of both takes no longer for each.
    runs = texts.select("doc_key", F.explode(matches(F.col("text"), RUN)).alias("m")).select("doc_key", "m.*", F.lower("m.value").alias("word"))
    hits = runs.join(held, ["doc_key", "word"]).select("doc_key", "start", "stop", "value", "removed")
    base = materialize(found.where(_any()).groupBy("doc_key").agg(*[F.first(k).alias(k) for k in NAMES]), "base")
    every = base.join(_fit(with_terms, broadcast_bytes, F.octet_length("doc_key")), "doc_key").select("doc_key", F.explode(F.concat(*NAMES)).alias("b"))
    edges = hits.select("doc_key", F.col("stop").alias("at"), F.lit(0).alias("kind"), F.struct("start", "stop", "value", "removed").alias("m"), F.lit(None).cast("int").alias("reach"))
    none = F.lit(None).cast(edges.schema["m"].dataType)
    edges = edges.unionByName(every.select("doc_key", F.col("b.start").alias("at"), F.lit(1).alias("kind"), none.alias("m"), F.col("b.stop").alias("reach")))
    # The furthest end of the base spans that begin before a term ends; the term is apart if it begins no earlier.
    before = F.max("reach").over(Window.partitionBy("doc_key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    apart = edges.withColumn("before", before).where("kind = 0 AND coalesce(before <= m.start, true)")
    terms_of = apart.groupBy("doc_key").agg(F.sort_array(F.collect_list("m")).alias("term"))
    both = base.join(terms_of, "doc_key", "full")
    return materialize(both.select("doc_key", *[F.coalesce(k, F.array().cast(SPANS)).alias(k) for k in NAMES], F.coalesce("term", F.array().cast(TERMS)).alias("term")), "spans")


def find(docs: DataFrame, support: int = 3, generalise: float = 0.75, remove: float = 0.9, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with email, ip, card, phone (arrays of start, stop, value) and term (start, stop, value, removed).

    Term spans that touch a base span are left out. Every row and column stays; null texts have no spans,
    repeated rows are each searched, an empty table gives an empty result. Columns of ``docs`` that bear
    the names of the results are replaced by them. Of near copies, the terms of the one of least key are counted.
    """
    docs = docs.drop(*NAMES, "term", "_loam_key").withColumn("_loam_key", F.md5("text"))
    found = spans_of(docs.select("text"), support, generalise, remove, broadcast_bytes).withColumnRenamed("doc_key", "_loam_found")
    joined = docs.join(found, F.col("_loam_key") == F.col("_loam_found"), "left").drop("_loam_key", "_loam_found")
    return joined.withColumns({k: F.coalesce(k, F.array().cast(SPANS)) for k in NAMES} | {"term": F.coalesce("term", F.array().cast(TERMS))})


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with spans replaced in text: base spans and terms by their kind in brackets, removed terms by nothing.

    Of spans that overlap, the one that begins first stays, the longest of these. n_chars, where there is such a
    column, becomes the new length. Other columns and all rows stay as they are; an empty table gives an empty result.
    """
    columns = docs.columns
    clash = [c for c in columns if c in {*NAMES, "term"}]
    out = find(docs.withColumnsRenamed({c: f"_loam_{c}" for c in clash}), **how)
    terms = F.transform("term", lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("order"), F.when(m["removed"], "").otherwise("[TERM]").alias("put")))
    out = out.withColumn("_loam_spans", F.concat(*[_marks(k, F.lit(f"[{k.upper()}]")) for k in NAMES], terms))
    out = out.withColumn("text", F.when(F.size("_loam_spans") > 0, replaced(F.col("text"), F.col("_loam_spans"))).otherwise(F.col("text")))
    out = out.drop(*NAMES, "term", "_loam_spans").withColumnsRenamed({f"_loam_{c}": c for c in clash})
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def _written(kind: str) -> Column:
    edges = F.array_sort(F.transform(kind, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"))))
    return F.transform(edges, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["stop"]))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    return F.array_join(F.concat(*map(_written, kinds)), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term and n_spans of every row of ``docs``."""
    rows = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), **how)
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in NAMES],
        F.sha2(listed(NAMES).cast("binary"), 256).alias("base_sha256"),
        listed([*NAMES, "term"]).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        sum((F.size(k) for k in NAMES), F.size("term")).cast("long").alias("n_spans"),
    )
