"""PII: information-theoretic sanitisation.

Base detectors find e-mail addresses, IP addresses, card and telephone
numbers; one more finds secrets, which are strings of high information content
that a name such as `token` is set to. The words of documents that hold such an
entity may give it away too: the corpus says how strongly. With n(t, e)
documents that hold both term t and entity e, and n(t) documents with t at all,
the term leaves -log2(p) bits of the entity open, which is the entity's
information content less its pointwise mutual information with the term; p is
n(t, e) / n(t), smoothed towards one half. Entities are judged as single values,
as classes (a mail domain, the first half of an IP address, a card's issuer, a
telephone area) and as whole kinds. Terms that leave little open are
generalised wherever they stand in documents that hold the entity, and removed
where they leave next to nothing. Words that name secrets, such as `token`, say
that a secret follows but nothing of it, and are no terms.

All of it is DataFrame work. Positions count code points; matches are found by
putting marks around them and cutting the text at the marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE, cut, table

#: Fixed patterns, in the order in which spans are listed. Possessive
#: quantifiers and the looks behind change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a secret's name holds, in small or capital letters.
SECRET_NAMES = "token|secret|passw|api[_-]?key|access[_-]?key|private[_-]?key|credential"
#: A name, a sign between, and in group 2 a value that may be a secret.
SECRET = rf"""(?i)((?:{SECRET_NAMES})[a-z0-9_]{{0,30}}+["']?[ \t]{{0,8}}+[:=]+[ \t]{{0,8}}+["'`]?)([a-z0-9+/_=.~-]{{16,}}+)"""
#: A secret has so many bits: its length times the entropy of its characters.
SECRET_BITS = 48.0
KINDS = (*PATTERNS, "secret")
#: A text can hold a match only if it holds this.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]"}
#: The mark, and what stands for it where a text has it itself; no pattern matches either.
MARK, INSTEAD = "\ue000", "\ufffd"
#: A term is a word of at least three letters but for punctuation around it.
TERM = rf"(?<![^{SPACE}])(\p{{Punct}}*+)(\p{{L}}{{3,}}+)(\p{{Punct}}*+)(?![^{SPACE}])"
#: A term counts from so many documents that hold it and one entity; terms that
#: leave at most so many bits open are generalised, or removed.
LEAST_DOCUMENTS, GENERALISE_BITS, REMOVE_BITS = 2, 1.0, 0.15
#: Classes and kinds are held by many documents, where two or three meet by chance.
CLASS, LEAST_CLASS_DOCUMENTS = "~", 6
#: Half a document counts for and half against each term and entity.
SMOOTHING = 0.5
#: Rows of one entity or term are dealt over so many parts where they are joined.
SALTS = 16

#: Parts of a text that are looked at with one running array.
CHUNK = 256

_MATCHES = "array<struct<i:int,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backwards = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = backwards.substr(i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, twice % 10 + F.floor(twice / 10).cast("int")).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    number = F.regexp_replace(part, "^0+", "")
    return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))


def _bits(value: Column) -> Column:
    """Length of a string times the entropy of its characters."""
    chars = F.split(value, "")
    n = F.length(value)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)))
    return F.aggregate(counts, F.lit(0.0), lambda total, k: total + k * F.log2(n / k))


PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _byte),
    "card": lambda v: F.when(F.length(_digits(v)).between(16, 19), _luhn(v)).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "secret": lambda v: v.rlike("[0-9]") & (_bits(v) >= SECRET_BITS),
}


def _cut_at(text: Column, pattern: str, replacement: str) -> Column:
    """The text in parts: what lies between matches at even places, matches at odd ones."""
    return F.split(F.regexp_replace(text, pattern, replacement), MARK, -1)


def _matches(parts: Column, passes: Callable[[Column], Column]) -> Column:
    """Place, start, end and value of the matches that pass, in order.

    A running array is copied at each step, so parts are taken in chunks, each
    with an array of its own: a text of many matches takes little more than
    one of few.
    """
    none = F.array().cast(_MATCHES)

    def step(done: Column, part: Column) -> Column:
        end = done["pos"] + F.length(part)
        one = F.array(F.struct(done["i"].alias("i"), done["pos"].alias("start"), end.alias("end"), part.alias("value"))).cast(_MATCHES)
        out = F.when((done["i"] % 2 == 1) & passes(part), F.concat(done["out"], one)).otherwise(done["out"])
        return F.struct((done["i"] + 1).alias("i"), end.alias("pos"), out.alias("out"))

    def chunk(done: Column, j: Column) -> Column:
        fresh = F.struct(done["now"]["i"].alias("i"), done["now"]["pos"].alias("pos"), none.alias("out"))
        now = F.aggregate(F.slice(parts, j * CHUNK + 1, CHUNK), fresh, step)
        return F.struct(now.alias("now"), F.concat(done["before"], F.array(done["now"]["out"])).alias("before"))

    start = F.struct(F.struct(F.lit(0).alias("i"), F.lit(0).alias("pos"), none.alias("out")).alias("now"), F.array().cast(f"array<{_MATCHES}>").alias("before"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
    found = F.aggregate(chunks, start, chunk, lambda done: F.flatten(F.concat(done["before"], F.array(done["now"]["out"]))))
    return F.when(F.size(parts) > 1, found).otherwise(none)


def _terms(text: Column) -> Column:
    """Terms of a text with their positions."""
    found = _matches(_cut_at(text, TERM, f"$1{MARK}$2{MARK}$3"), lambda _: F.lit(True))
    return F.transform(found, lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 2), F.lower))


def _own_words(text: Column) -> Column:
    """The distinct terms of a text but for those that name a secret: they stand before it in every document."""
    return F.filter(_words(text), lambda t: ~t.rlike(SECRET_NAMES))


def _entities(kind: str, found: Column) -> Column:
    """Names of what the matches of a kind stand for: values, classes and, if there are any, the kind."""

    def value(m: Column) -> Column:
        return F.lower(m["value"]) if kind == "email" else m["value"] if kind in ("ip", "secret") else _digits(m["value"])

    def part(m: Column) -> Column:
        if kind == "email":
            return F.substring_index(value(m), "@", -1)
        return F.substring_index(value(m), ".", 2) if kind == "ip" else F.substring(value(m), 1, 6 if kind == "card" else 4)

    values = F.transform(found, lambda m: F.concat(F.lit(f"{kind}:"), value(m)))
    classes = [] if kind == "secret" else [F.transform(found, lambda m: F.concat(F.lit(f"{CLASS}{kind}:"), part(m)))]
    return F.concat(values, *classes, F.when(F.size(found) > 0, F.array(F.lit(CLASS + kind))).otherwise(F.array().cast("array<string>")))


def _listed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))


def _tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(TAGS[kind]).alias("tag")))


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """Base spans of every row: `rid, id, n_<kind>..., base, spans, entities, held_text`.

    `base` lists kind:start:end of the base kinds, `added` those of secrets;
    `spans` holds both as structs. Rows without an entity have a null
    `held_text`. With `with_rows` the input's own columns come along in the
    struct `row`.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col(id_col).cast("long").alias("id"), F.translate(text, MARK, INSTEAD).alias("text")]
    if with_rows:
        own.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cut_up = docs.select(*own)
    for kind, pattern in PATTERNS.items():
        whole = F.array(F.col("text"))
        parts = _cut_at(F.col("text"), pattern, f"{MARK}$0{MARK}")
        has = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike("[0-9]")
        cut_up = cut_up.withColumn(f"parts_{kind}", F.when(has, parts).otherwise(whole))
    cut_up = cut_up.withColumn("parts_secret", F.when(F.col("text").rlike(SECRET), _cut_at(F.col("text"), SECRET, f"$1{MARK}$2{MARK}")).otherwise(F.array("text")))
    for kind in KINDS:
        cut_up = cut_up.withColumn(f"found_{kind}", _matches(F.col(f"parts_{kind}"), PASSES[kind]))
    listed = F.concat(*[_listed(k, F.col(f"found_{k}")) for k in PATTERNS])
    spans = F.concat(*[_tagged(k, F.col(f"found_{k}")) for k in KINDS])
    entities = F.array_distinct(F.concat(*[_entities(k, F.col(f"found_{k}")) for k in KINDS]))
    any_found = sum((F.size(f"found_{k}") for k in KINDS), F.lit(0)) > 0
    return cut_up.select(
        F.monotonically_increasing_id().alias("rid"),
        "id",
        *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.array_join(listed, ",").alias("base"),
        F.array_join(_listed("secret", F.col("found_secret")), ",").alias("added"),
        spans.alias("spans"),
        entities.alias("entities"),
        F.when(any_found, F.col("text")).alias("held_text"),
        *(["row"] if with_rows else []),
    )


def _salted(frame: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))


def _least(entity: str) -> Column:
    """How many documents must hold an entity."""
    return F.when(F.startswith(entity, F.lit(CLASS)), LEAST_CLASS_DOCUMENTS).otherwise(LEAST_DOCUMENTS)


def repeated_entities(found: DataFrame) -> DataFrame:
    """`rid, entities, terms` of rows that hold an entity that enough rows hold: those, and all terms that don't name secrets."""
    held = found.filter("held_text is not null")
    one = held.select("rid", F.explode("entities").alias("entity")).withColumn("salt", F.pmod("rid", F.lit(SALTS)))
    repeated = one.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= _least("entity")).select("entity")
    by_row = one.join(_salted(repeated), ["entity", "salt"]).groupBy("rid").agg(F.collect_list("entity").alias("entities"))
    return held.select("rid", _own_words(F.col("held_text")).alias("terms")).join(by_row, "rid").select("rid", "entities", "terms")


def revealing_terms(docs: DataFrame, held: DataFrame, text_col: str = "text") -> DataFrame:
    """`term, entity, bits`: terms that leave at most GENERALISE_BITS of an entity open.

    Counts are of whole rows, over the whole corpus. Pairs are summed before
    they meet the terms' own counts. Terms are judged first by their strongest
    entity, one row a term, so that words that stand with thousands of entities
    are gone before entities are joined. As the estimate is smoothed towards one
    half, n(t, e) / n(t) is at least one half wherever it is.
    """
    near = held.select("terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term")).groupBy("term", "entity").agg(F.count("*").alias("n_both"))
    pairs = cut(near.filter(F.col("n_both") >= _least("entity")), "pii-pairs")
    everywhere = docs.select(F.explode(_words(F.col(text_col).cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    share = lambda n: (F.col(n) + SMOOTHING) / (F.col("n_term") + 2 * SMOOTHING)
    least = 2.0**-GENERALISE_BITS
    strongest = pairs.groupBy("term").agg(F.max("n_both").alias("most"))
    telling = strongest.join(everywhere, "term").filter(share("most") >= least).select("term", "n_term")
    return pairs.join(telling, "term").filter(share("n_both") >= least).select("term", "entity", (-F.log2(share("n_both"))).alias("bits"))


def sanitise_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """`find_base` plus `terms`: sorted structs (start, end, tag) of revealing terms.

    Null and empty texts have no spans. Repeated rows are counted and treated
    each by itself. Extra columns only ride along. A mark character in a text
    is treated as any other character that no pattern matches.
    """
    found = cut(find_base(docs, id_col, text_col, with_rows), "pii-found")
    held = cut(repeated_entities(found), "pii-held")
    telling = cut(revealing_terms(docs, held, text_col), "pii-terms")
    # first the few terms that tell anything, then of whom
    own = held.select("rid", F.explode("terms").alias("term")).withColumn("salt", F.pmod("rid", F.lit(SALTS)))
    hits = own.join(_salted(telling.select("term").distinct()), ["term", "salt"]).select("rid", "term")
    both = hits.join(held.select("rid", F.explode("entities").alias("entity")), "rid").withColumn("salt", F.pmod("rid", F.lit(SALTS)))
    tag = F.when(F.col("bits") <= REMOVE_BITS, F.lit("")).otherwise(F.lit(TAGS["term"]))
    marked = cut(both.join(_salted(telling), ["term", "entity", "salt"]).groupBy("rid", "term").agg(F.min(tag).alias("tag")), "pii-marked")
    places = found.select("rid", "held_text").join(marked.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode(_terms(F.col("held_text"))).alias("t")).select("rid", "t.term", "t.start", "t.end")
    by_row = places.join(marked, ["rid", "term"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("terms"))
    return found.drop("entities", "held_text").join(by_row, "rid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,tag:string>>")))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by its tag; overlaps go once."""

    def step(done: Column, s: Column) -> Column:
        begin = F.greatest(done["pos"], s["start"])
        out = F.concat(done["out"], F.substring(text, done["pos"] + 1, begin - done["pos"]), F.when(s["start"] >= done["pos"], s["tag"]).otherwise(""))
        return F.struct(F.greatest(done["pos"], s["end"]).alias("pos"), F.when(s["end"] > done["pos"], out).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(text, done["pos"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, rest)).otherwise(text)


def sanitise_documents(docs: DataFrame) -> DataFrame:
    """`documents` with personal data, secrets and revealing terms taken out of the text.

    The input's columns travel in one struct, so extra ones may have any name.
    """
    done = sanitise_spans(docs, with_rows=True).select("row", rewritten(F.col("row.text"), F.concat("spans", "terms")).alias("cleaned"))
    row = F.col("row").withField("text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cleaned").cast("long"))
    return done.select(row.alias("row")).select("row.*")


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`."""
    done = sanitise_spans(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])), ",")
    listed = [F.when(c != "", c) for c in (F.col("base"), F.col("added"), terms)]
    n_terms = F.size("terms").cast("long")
    return done.select(
        F.col("id").alias("doc_id"),
        *[f"n_{k}" for k in PATTERNS],
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", *listed).alias("spans"),
        "n_secret",
        n_terms.alias("n_term"),
        sum((F.col(f"n_{k}") for k in KINDS), n_terms).alias("n_spans"),
    )
