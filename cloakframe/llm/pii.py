"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Base spans (e-mail, IP, card, phone) are found with SQL regular expressions. Then the corpus tells which ordinary terms
give a protected entity away: with n(e, t) the number of documents that hold entity e and term t, df(t) those with t,
df(e) those with e and N all, the term discloses PMI(e; t) = log2(n(e, t) / df(t)) - log2(df(e) / N) bits out of the
entity's IC(e) = -log2(df(e) / N). Terms that disclose DISCLOSURE of it or more, with a posterior n(e, t) / df(t) of at
least POSTERIOR, are told. Whole documents count, copies alike on both sides; a pair needs SUPPORT different texts.

A told term is generalised to the least general of its classes that is not told itself - all terms with its first three
letters, then all with its first letter, whose documents are counted in the same way - and removed if both are told.

Entities that stand in exactly the same documents are one class of entities, so that a list of thousands of addresses
that several documents share makes one pair a term, not thousands. All of it is DataFrame code; terms are sought by
bitmaps of bounded size, and joined exactly; hot keys are split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bitmap, discard, fresh, let, load, materialize

# The patterns of the base spans. Possessive and anchored at the start of a run, they match what the plain
# forms match, leftmost first, in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{14}", "phone": r"\+[0-9]"}
#: A term: letters only, at least three.
TERM = r"\p{L}{3,}"
#: A pair counts from so many different texts on.
SUPPORT = 3
DISCLOSURE, POSTERIOR = 0.8, 0.5
SPAN = "struct<kind:string,start:int,end:int,match:string>"
_BLOCK = 256


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def matches(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All leftmost non-overlapping matches, or those that `keep` tells: array of SPAN, in code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths add up to the positions; sums run over blocks
    of _BLOCK matches to stay near linear for texts with very many. Only kept matches are placed.
    """

    def placed(m: Column, p: Column) -> Column:
        def spans(t: Column, before: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                start = F.get(before, block) + _sum(F.slice(t, block * _BLOCK + 1, i - block * _BLOCK)) + F.length(F.get(p, i))
                return let(start, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(x)).alias("end"), x.alias("match")))

            if keep is None:
                return F.transform(m, at)
            kept = F.filter(F.transform(m, lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())
            return F.transform(kept, lambda i: at(F.get(m, i), i))

        lengths = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        totals = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / _BLOCK).cast("int")), lambda k: _sum(F.slice(t, k * _BLOCK + 1, F.lit(_BLOCK))))
        sums = lambda b: F.transform(b, lambda x, k: _sum(F.slice(b, F.lit(1), k)))
        return let(lengths, lambda t: let(totals(t), lambda b: let(sums(b), lambda before: spans(t, before))))

    none = F.array().cast(f"array<{SPAN}>")
    found = lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: placed(m, p))).otherwise(none)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _byte(part: Column) -> Column:
    return F.coalesce(F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("decimal(38,0)") <= 255, F.lit(False))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _byte),
    "card": lambda x: let(_digits(x), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d)),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """The valid base spans of a non-null text, by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(kind: str) -> Column:
        return F.when(text.rlike(HINTS[kind]), F.filter(matches(text, PATTERNS[kind], kind), lambda s: VALID[kind](s["match"]))).otherwise(none)

    return F.concat(*map(of, PATTERNS))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _key(text: Column) -> Column:
    """A text's key: two hashes of 64 bits and its length, so that different texts do not share one."""
    return F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit("second"), text), F.length(text))


def _tokens(text: Column) -> Column:
    """The distinct terms of a text outside e-mails, in lower case, and their classes: first three letters or one, and '*'."""
    plain = F.when(text.rlike(HINTS["email"]), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    words = F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0)))
    classes = lambda w, n: F.array_distinct(F.transform(w, lambda x: F.concat(F.substring(x, 1, n), F.lit("*"))))
    return let(words, lambda w: F.concat(w, classes(w, 3), classes(w, 1)))


def found_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (of the text), spans and the distinct entities (hashes of kind and value), written once."""
    got = docs.select(F.col(doc_id).alias("doc_id"), _text(F.col(text)).alias("text")).withColumn("spans", base_spans(F.col("text")))
    entities = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["match"]))))
    return materialize(got.select("doc_id", _key(F.col("text")).alias("key"), "spans", entities.alias("entities")), "spans")


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str) -> DataFrame | None:
    """term, posterior, general (its least general class that is not told; null: none) of the terms that reveal an entity.

    None when no pair has the support for it.
    """
    holding = found.filter(F.size("entities") > 0).groupBy("key", "entities").agg(F.count(F.lit(1)).alias("copies"))
    holding = materialize(holding, "holding")  # a row for each different text
    place = F.xxhash64("key")
    halves = [F.sum(place.bitwiseAND(F.lit(0x7FFFFFFF))), F.sum(F.shiftrightunsigned(place, 33))]  # tell sets of texts apart
    each = holding.select("key", "copies", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("df_e"), F.xxhash64(F.count(F.lit(1)), F.sum("copies"), *halves).alias("class"))
    known = materialize(entities.filter(F.col("texts") >= SUPPORT), "entities")
    if not known.limit(1).count():
        return None
    rows = found.count()
    held = each.join(known.select("entity", "class", "df_e"), "entity")  # a hot entity's rows: adaptive execution splits skewed joins
    held = materialize(held.select("key", "copies", "class", "df_e").distinct().groupBy("key", "copies").agg(F.collect_list(F.struct("class", "df_e")).alias("classes")), "classes")
    n_held = held.count()
    source = docs.select(_text(F.col(text)).alias("text")).withColumn("key", _key(F.col("text")))
    those = bitmap(held, place, max(20, n_held.bit_length() + 4)).flag(source, place, "may").filter("may")
    words = those.select("key", F.explode(_tokens(F.col("text"))).alias("term"))
    near = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT)
    near = materialize(near, "near-terms")
    n_near = near.count()
    if not n_near:
        return None
    may = bitmap(near, F.xxhash64("term"), max(20, n_near.bit_length() + 4))
    counted = may.flag(source.select(F.explode(_tokens(F.col("text"))).alias("term")), F.xxhash64("term"), "may").filter("may").groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    most = held.agg(F.max(F.array_max(F.transform("classes", lambda c: c["df_e"])))).first()[0]
    df_t = materialize(counted.filter((F.col("df_t") >= SUPPORT) & (F.col("df_t") * POSTERIOR <= most)), "term-counts")
    n_terms, total_t = df_t.agg(F.count(F.lit(1)), F.coalesce(F.sum("df_t"), F.lit(0))).first()
    if not n_terms:
        return None
    rare = bitmap(df_t, F.xxhash64("term"), max(20, n_terms.bit_length() + 4)).flag(words.distinct(), F.xxhash64("term"), "may").filter("may").select("key", "term")
    rare = attach(rare, df_t, "term", "df_t", max(total_t, 1)).filter("df_t is not null")
    met = rare.join(held, "key").select("term", "df_t", "copies", F.explode(F.filter("classes", lambda c: c["df_e"] >= POSTERIOR * F.col("df_t"))).alias("c"))
    pairs = met.groupBy("c.class", "c.df_e", "term", "df_t").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT)
    posterior = F.least(F.lit(1.0), F.col("n") / F.col("df_t"))
    content = -F.log2(F.col("df_e") / F.lit(float(rows)))
    told = pairs.withColumn("posterior", posterior).filter((F.col("posterior") >= POSTERIOR) & (content > 0) & (F.log2("posterior") + content >= DISCLOSURE * content))
    told = materialize(told.groupBy("term").agg(F.max("posterior").alias("posterior")), "told")
    classes = told.filter(F.col("term").endswith("*")).select(F.col("term").alias("class"), F.lit(True).alias("is_told"))
    terms = told.filter(~F.col("term").endswith("*"))
    label = lambda n: F.concat(F.substring("term", 1, n), F.lit("*"))
    each = terms.select("term", "posterior", F.explode(F.array(F.struct(F.lit(0).alias("at"), label(3).alias("class")), F.struct(F.lit(1).alias("at"), label(1).alias("class")))).alias("c"))
    free = each.select("term", "posterior", "c.*").join(classes, "class", "left").groupBy("term", "posterior")
    terms = free.agg(F.min(F.when(F.col("is_told").isNull(), F.struct("at", "class"))).alias("free"))  # the least general one that is free
    general = F.col("free.class")
    out = materialize(terms.select("term", "posterior", general.alias("general")), "terms")
    for t in (holding, known, held, near, df_t, told):
        discard(t)
    return out if out.limit(1).count() else None


def told_terms(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """key, told: the disclosing terms that each different text holds, with their classes; only texts that hold any."""
    may = bitmap(terms, F.xxhash64("term"), max(20, terms.count().bit_length() + 4))
    source = docs.select(_text(F.col(text)).alias("text")).withColumn("key", _key(F.col("text")))
    words = source.select("key", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    held = materialize(may.flag(words, F.xxhash64("term"), "may").filter("may").select("key", "term").distinct(), "held-terms")
    sizes = held.groupBy("term").agg(F.count(F.lit(1)).alias("size"))
    met = attach(held, terms.join(sizes, "term"), "term", "size", held.count()).filter("posterior is not null")
    out = materialize(met.groupBy("key").agg(F.collect_list(F.struct("term", "general")).alias("told")), "told-terms")
    discard(held)
    return out


def term_spans(text: Column, told: Column) -> Column:
    """The spans of a text's disclosing terms; `match` is the term's class. `told`: as told_terms() gives it, or null.

    The terms lie in about as many slots as each slot holds terms, so that a word is compared with few of them.
    """

    def spans(slots: Column) -> Column:
        same = lambda word: F.filter(F.get(slots, F.pmod(F.hash(word), F.size(slots))), lambda t: t["term"] == word)
        found = matches(text, TERM, "term", lambda x: let(F.lower(x), lambda word: F.size(same(word)) > 0))
        general = lambda s: let(F.lower(s["match"]), lambda word: F.get(same(word), F.lit(0))["general"])
        kind = lambda g: F.when(g.isNull(), "removed").otherwise("generalised").alias("kind")
        return F.transform(found, lambda s: let(general(s), lambda g: F.struct(kind(g), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(g, F.lit("")).alias("match"))))

    many = F.ceil(F.sqrt(F.size(told))).cast("int")
    slots = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.filter(told, lambda t: F.pmod(F.hash(t["term"]), many) == k))
    return F.when(told.isNotNull(), let(slots, spans))


def _before(values: Column, least: int = -1) -> Callable[[Callable], Column]:
    """body(f) where f(i) is the largest of the array's values before place i; blocks keep it near linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / _BLOCK).cast("int")), lambda k: F.coalesce(F.array_max(F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK))), F.lit(least)))

    def run(body: Callable[[Callable], Column]) -> Column:
        def with_blocks(b: Column) -> Column:
            upto = F.transform(b, lambda x, k: F.coalesce(F.array_max(F.slice(b, F.lit(1), k)), F.lit(least)))

            def with_upto(u: Column) -> Column:
                def at(i: Column) -> Column:
                    k = F.floor(i / _BLOCK).cast("int")
                    return F.greatest(F.get(u, k), F.coalesce(F.array_max(F.slice(values, k * _BLOCK + 1, i - k * _BLOCK)), F.lit(least)))

                return body(at)

            return let(upto, with_upto)

        return let(blocks, with_blocks)

    return run


def _with_terms(spans: Column, terms: Column) -> Column:
    """Base spans and then the term spans that touch none of them; both sorted and each kind without overlaps."""
    none = F.array().cast(f"array<{SPAN}>")
    mark = lambda a, base: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(base).alias("term"), s["end"].alias("end"), s.alias("span")))

    def free(all_: Column) -> Column:
        size = F.size(all_)
        ends = F.transform(all_, lambda x: F.when(x["term"] == 0, x["end"]).otherwise(F.lit(-1)))
        begins = F.transform(F.reverse(all_), lambda x: F.when(x["term"] == 0, -x["start"]).otherwise(F.lit(-(1 << 30))))  # the least start after

        def body(e: Column, b: Column) -> Column:
            return _before(e)(lambda last: _before(b, -(1 << 30))(lambda next_: F.transform(all_, lambda x, i: F.when((x["term"] == 1) & (last(i) <= x["start"]) & (-next_(size - 1 - i) >= x["end"]), x["span"]))))

        return let(ends, lambda e: let(begins, lambda b: body(e, b)))

    kept = let(F.array_sort(F.concat(mark(spans, 0), mark(terms, 1))), lambda a: F.filter(free(a), lambda s: s.isNotNull()))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, F.concat(spans, kept)).otherwise(F.coalesce(spans, none))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty and have no span. Repeated rows repeat in the result, null ids stay, an empty table gives
    no rows, further columns of docs are ignored. Base spans of different kinds may overlap; terms never do. Texts may be
    of any length that a row holds: work grows little faster than their spans.
    """
    found = found_spans(docs, doc_id, text)
    terms = disclosing_terms(docs, found, text)
    if terms is None:
        full = found.withColumn("all", F.col("spans"))
    else:
        told = told_terms(docs, terms, text)
        may = bitmap(told, F.xxhash64("key"), max(20, told.count().bit_length() + 4))
        marked = may.flag(found, F.xxhash64("key"), "may")
        sizes = marked.filter("may").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        source = docs.select(F.col(doc_id).alias("doc_id"), _text(F.col(text)).alias("text")).withColumn("key", _key(F.col("text")))
        hit = may.flag(source, F.xxhash64("key"), "may").filter("may").drop("may")
        met = attach(hit, told.join(sizes, "key"), "key", "size", found.count()).withColumn("spans", base_spans(F.col("text")))
        met = materialize(met.select("doc_id", "spans", _with_terms(F.col("spans"), term_spans(F.col("text"), F.col("told"))).alias("all")), "with-terms")
        full = marked.filter("not may").select("doc_id", "spans", F.col("spans").alias("all")).unionByName(met)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return full.select("doc_id", *map(n, PATTERNS), F.sha2(_digest(F.col("spans")), 256).alias("base_sha256"), _digest(F.col("all")).alias("spans"))


def _pieces(text: Column) -> Callable[[Callable], Column]:
    """body(f) where f(a, b) is the text from code point a to b; cut from blocks, as substring() counts from the start."""
    wide = F.greatest(F.lit(4096), F.floor(F.length(text) / 256).cast("int"))

    def run(body: Callable[[Callable], Column]) -> Column:
        def with_width(w: Column) -> Column:
            def with_blocks(blocks: Column) -> Column:
                def piece(a: Column, b: Column) -> Column:
                    i, j = F.floor(a / w).cast("int"), F.floor(b / w).cast("int")
                    first = F.substring(F.get(blocks, i), a - i * w + 1, b - a)  # ends with the block
                    rest = F.concat(F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), b - j * w))
                    return F.when(b <= a, "").when(i == j, first).otherwise(F.concat(first, rest))

                return body(piece)

            return let(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / w).cast("int")), lambda k: F.substring(text, k * w + 1, w)), with_blocks)

        return let(wide, with_width)

    return run


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kind, or a term's class, in brackets; removed terms leave nothing.

    Of overlapping spans the one that begins first, the longer of equals, gives the label for all that they cover.
    """
    label = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", F.concat(F.lit("["), s["match"], F.lit("]"))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def put(ordered: Column, ends: Column) -> Column:
        def with_pieces(piece: Callable) -> Column:
            def with_last(last: Callable) -> Column:
                part = lambda x, i: let(F.greatest(last(i), F.lit(0)), lambda at: F.when(x["start"] >= at, F.concat(piece(at, x["start"]), label(x["span"]))).otherwise(""))
                tail = let(F.array_max(ends), lambda at: piece(at, F.length(text)))
                return F.concat(F.array_join(F.transform(ordered, part), ""), tail)

            return _before(ends)(with_last)

        return _pieces(text)(with_pieces)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s.alias("span"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, lambda o: let(F.transform(o, lambda x: x["span"]["end"]), lambda e: put(o, e))))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with personal data masked and disclosing terms generalised or removed in `text`.

    Null texts stay null, empty ones empty; repeated rows and null ids stay; other columns stay whatever their names; an
    empty table gives no rows. Texts without spans are not touched.
    """
    found = found_spans(docs, doc_id, text)
    terms = disclosing_terms(docs, found, text)
    total = found.count()
    discard(found)
    key, spans, may, known, size = fresh(docs, "key", "spans", "may", "terms", "size")
    body = F.col(text).cast("string")
    base = F.when(body.isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(base_spans(_text(F.col(text))))

    def put(df: DataFrame) -> DataFrame:
        return df.withColumn(text, F.when(body.isNull(), body).otherwise(_masked(body, F.col(spans)))).select(*docs.columns)

    if terms is None:
        return put(docs.withColumn(spans, base))
    told = told_terms(docs, terms, text).select(F.col("key").alias(key), F.col("told").alias(known))
    marked = bitmap(told, F.xxhash64(key), max(20, told.count().bit_length() + 4)).flag(docs.withColumn(key, _key(_text(F.col(text)))), F.xxhash64(key), may)
    sizes = marked.filter(F.col(may)).groupBy(key).agg(F.count(F.lit(1)).alias(size))
    hit = attach(marked.filter(F.col(may)), told.join(sizes, key), key, size, max(total, 1))
    hit = hit.withColumn(spans, base).withColumn(spans, _with_terms(F.col(spans), term_spans(_text(F.col(text)), F.col(known))))
    return put(marked.filter(~F.col(may)).withColumn(spans, base)).unionByName(put(hit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(load(spark, sf_dir, "documents"))
