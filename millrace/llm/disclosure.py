"""Personal data, and terms that disclose it. Built-in column functions only.

Base spans are found by pattern, kind by kind, leftmost and not overlapping, and then
checked (octets, Luhn digits, lengths). Their positions come from the lengths of what
lies between the matches.

Protected entities are the values found (kind and text in lower case). A term is a
word of a document, in lower case and without punctuation around it. With document
counts df over whole texts, a term t discloses an entity e as far as

    PMI(t, e) / IC(e) = log(N df(t,e) / (df(t) df(e))) / log(N / df(e))

which is 1 where the term never occurs without the entity. No number of documents is
asked for: an entity of one document has the terms that stand in at most N^(1 -
threshold) documents; `min_support` is for callers that want more documents behind a term.
A term that reaches `threshold` for any entity is treated as follows wherever it stands,
in documents with the entity or without: it becomes a span of kind "term" and is
generalised to its class ([TERM]), or removed. Words that touch a base span are no terms
there.

Counts are partial sums per task before anything is shuffled, so neither an entity nor a
term that occurs in a third of all rows is gathered in one place. A pair of a document's
term and entity is only counted where df(t) and df(e) leave it open whether the term
discloses the entity; with one document in common it often does already, and a term of
too many documents never does. Places in a text are running sums in parts, so that a text
with many spans takes little more than the time that its length does.

Definitions for odd input: a null text counts as empty; rows are told apart by id and
text, a null id is an id like any other; rows sharing an id count as one document for df
and keep their own spans, and equal rows get equal results; spans of different kinds may
overlap; texts of any length are taken whole; an empty table gives an empty result;
further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, likely, session_of

#: Kind, pattern, a string that a text with a match contains, and what a text must contain to hold a
#: valid match. Possessive quantifiers change no match and keep Java's matcher from recursing on long runs.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "", r"[0-9](?:[\x20-]?+[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", r"\+[0-9]"),
}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
MARKS = r"[\p{P}\p{S}]"
BETWEEN = r"(?:(?<![\p{P}\p{S}])[\p{P}\p{S}]++)?+[\x20\x09-\x0D][\p{P}\p{S}\x20\x09-\x0D]*+"
PARTS = "array<struct<at:int,part:string>>"
PLACES = "array<struct<start:int,end:int,value:string>>"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _running(values: Column, step) -> Column:
    """array<long>: step over the first one, two, ... of the values (long, at least one), starting from 0.

    Appending copies an array, so the values are taken in parts of about the square root of their number.
    """
    wide = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    parts = _let(wide, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / w).cast("int")), lambda k: F.slice(values, k * w + 1, w)))

    def within(part: Column, last: Column) -> Column:
        start = F.struct(last.alias("last"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, start, lambda acc, v: F.struct(step(acc["last"], v).alias("last"), F.concat(acc["out"], F.array(step(acc["last"], v))).alias("out")))["out"]

    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<array<long>>").alias("out"))
    done = F.aggregate(parts, start, lambda acc, part: _let(within(part, acc["last"]), lambda run: F.struct(F.element_at(run, -1).alias("last"), F.concat(acc["out"], F.array(run)).alias("out"))))
    return F.flatten(done["out"])


def _positions(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: the matches of pattern with their code point positions."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(both: Column) -> Column:
        lengths = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["found"])), both["found"], lambda g, f: (F.length(g) + F.length(f)).cast("long"))
        ends = _let(lengths, lambda each: _running(each, lambda at, n: at + n))
        placed = F.zip_with(ends, both["found"], lambda end, f: F.struct((end.cast("int") - F.length(f)).alias("start"), end.cast("int").alias("end"), f.alias("value")))
        return F.when(F.size(both["found"]) > 0, placed).otherwise(F.array().cast(PLACES))

    return _let(F.struct(gaps.alias("gaps"), found.alias("found")), spans)


def base_spans(text: Column) -> Column:
    """All valid base spans, by kind as listed, then start."""
    return F.concat(*(_of_kind(text, kind) for kind in KINDS)).cast(SPAN)


def _of_kind(text: Column, kind: str) -> Column:
    pattern, has, needs = KINDS[kind]
    found = F.when(F.contains(text, F.lit(has)) & text.rlike(needs), _positions(text, pattern)).otherwise(F.array().cast(PLACES))
    valid = F.filter(found, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _clear(text: Column, spans: Column) -> Column:
    """array<struct<at, part>>: what lies between the spans and where it starts, without words that touch a span."""

    def free(ordered: Column) -> Column:
        last = F.size(ordered)
        ends = F.transform(ordered, lambda s: s["end"].cast("long"))
        far = F.when(last > 0, _let(ends, lambda e: _running(e, lambda at, end: F.greatest(at, end)))).otherwise(F.array().cast("array<long>"))
        gap = lambda reach: F.transform(
            F.sequence(F.lit(0), last), lambda i: F.struct(F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0)).cast("int").alias("start"), F.when(i < last, F.get(ordered, i)["start"]).otherwise(F.length(text)).alias("end"), (i > 0).alias("after"), (i < last).alias("before"))
        )
        return F.filter(_let(far, gap), lambda g: g["end"] > g["start"])

    def cut(part: Column, gap: Column) -> Column:
        front = F.when(gap["after"], F.regexp_replace(part, f"^{WORD}", "")).otherwise(part)
        return _let(front, lambda x: F.struct((gap["start"] + F.length(part) - F.length(x)).alias("at"), F.when(gap["before"], F.regexp_replace(x, f"{WORD}$", "")).otherwise(x).alias("part")))

    def parts(gaps: Column) -> Column:
        # Finding a place in a text costs its distance from the start, so the text is cut in two steps.
        wide = F.greatest(F.ceil(F.sqrt(F.size(gaps))), F.lit(1)).cast("int")
        groups = _let(wide, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / w).cast("int")), lambda k: F.slice(gaps, k * w + 1, w)))
        inside = lambda group: _let(
            F.struct(group[0]["start"].alias("at"), F.substring(text, group[0]["start"] + 1, F.element_at(group, -1)["end"] - group[0]["start"]).alias("text")),
            lambda held: F.transform(group, lambda g: _let(F.substring(held["text"], g["start"] - held["at"] + 1, g["end"] - g["start"]), lambda x: cut(x, g))),
        )
        return F.when(F.size(gaps) > 0, F.flatten(F.transform(groups, inside))).otherwise(F.array().cast(PARTS))

    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("part"))).cast(PARTS)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(spans) == 0, whole).otherwise(_let(_let(ordered, free), parts).cast(PARTS))


def _buckets(terms: Column) -> Column:
    """The terms in lists by hash, about the square root of their number, so that a look-up reads a short list."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(terms))), F.lit(1)).cast("int")
    return _let(wide, lambda w: F.transform(F.sequence(F.lit(0), w - 1), lambda b: F.filter(terms, lambda t: F.pmod(F.hash(t), w) == b)))


def _places(part: Column, buckets: Column) -> Column:
    """array<struct<start, end, value>>: the words of part whose term is in the buckets."""

    def find(both: Column) -> Column:
        gaps, words = both["gaps"], both["words"]
        known = lambda term: F.array_contains(buckets[F.pmod(F.hash(term), F.size(buckets))], term)
        chosen = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _let(_term(words[i]), known))

        def place(chosen: Column) -> Column:
            before = lambda k: F.when(k > 0, F.get(chosen, k - 1)).otherwise(F.lit(-1))
            length = lambda prev, i: F.length(F.concat_ws("", F.slice(gaps, prev + 2, i - prev), F.slice(words, prev + 2, i - prev))).cast("long")
            steps = F.transform(F.sequence(F.lit(0), F.size(chosen) - 1), lambda k: length(before(k), chosen[k]))
            ends = _let(steps, lambda each: _running(each, lambda at, n: at + n))
            placed = F.zip_with(ends, chosen, lambda end, i: F.struct((end.cast("int") - F.length(words[i])).alias("start"), end.cast("int").alias("end"), words[i].alias("value")))
            return F.when(F.size(chosen) > 0, placed).otherwise(F.array().cast(PLACES))

        return F.when(F.size(words) > 0, _let(chosen, place)).otherwise(F.array().cast(PLACES))

    return _let(F.struct(F.split(part, WORD, -1).alias("gaps"), F.regexp_extract_all(part, F.lit(WORD), F.lit(0)).alias("words")), find)


def _term(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), f"^{MARKS}++|(?<!{MARKS}){MARKS}++$", "")


def _terms(text: Column) -> Column:
    """Each term of the text once: what _term gives for its words, by splitting at white space and the marks next to it."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.concat(F.lit(" "), text, F.lit(" "))), BETWEEN)), "")


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def sanitise(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.9,
    min_support: int = 1,
    generalise: bool = True,
    with_text: bool = False,
) -> DataFrame:
    """Per row of df: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, and with_text the sanitised text."""
    scratch = Scratch(session_of(df), "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    base = F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(F.array().cast(SPAN))
    terms = F.when(F.size("base") > 0, F.array_distinct(F.flatten(F.transform(_clear(F.col("text"), F.col("base")), lambda p: _terms(p["part"])))))
    kept = docs.select("id", "digest", base.alias("base"), "text").select("id", "digest", "base", terms.alias("terms"))
    kept = scratch.keep(kept, "base")
    held = kept.filter("size(base) > 0").select("id", "digest", F.array_distinct(F.transform("base", _entity)).alias("entities"), "terms")

    ids = docs.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1")
    shared = scratch.keep(ids, "shared").select(F.col("id").alias("shared_id"), "rows")
    twice = shared.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))).first()[0]
    total = kept.count() - twice

    def frequencies(rows: DataFrame, keys: list[str]) -> DataFrame:
        """keys, n: distinct ids; keys are distinct in a row, and only those of ids that several rows share are told apart by id."""
        if not twice:
            return rows.groupBy(*keys).agg(F.count("*").alias("n"))
        on = F.col("id").eqNullSafe(F.col("shared_id"))
        once = rows.join(shared, on, "left_anti").groupBy(*keys).agg(F.count("*").alias("n"))
        more = rows.join(shared, on, "left_semi").select("id", *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
        return once.unionByName(more).groupBy(*keys).agg(F.sum("n").alias("n"))

    n = F.lit(float(max(total, 1)))
    discloses = lambda both, df_t, df_e: (df_e < total) & (F.log(n * both / (df_t * df_e)) >= F.log(n / df_e) * threshold)
    entities = frequencies(held.select("id", F.explode("entities").alias("entity")), ["entity"]).withColumnRenamed("n", "df_e")
    entities = scratch.keep(entities, "entities")
    # Of its documents, a term shares with an entity at most all of either's; terms of more documents disclose nothing.
    most = entities.filter(F.col("df_e") < total).agg(F.max(F.col("df_e") * F.pow(n / F.col("df_e"), F.lit(1 - threshold)))).first()[0] or 0.0
    candidates = scratch.keep(held.select(F.explode("terms").alias("term")).distinct(), "candidates")
    every = docs.select("id", F.explode(_terms(F.col("text"))).alias("term"))
    frequency = frequencies(likely(every, F.col("term"), candidates, F.col("term")), ["term"]).withColumnRenamed("n", "df_t")
    rare = scratch.keep(frequency.filter(F.col("df_t") <= most * 1.000001).join(candidates, "term", "left_semi"), "rare")

    # Entities by row, with their counts, meet the row's rare terms. With one document in common a term may disclose
    # already; where that is too few and all documents would be enough, the common ones are counted.
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    known = held.select("id", "digest", F.explode("entities").alias("entity")).join(entities, "entity").filter(F.col("df_e") < total)
    known = scratch.keep(known.groupBy("id", "digest").agg(F.min("df_e").alias("least"), F.collect_set(F.struct("entity", "df_e")).alias("known")), "known")
    seen = likely(held.select("id", "digest", F.explode("terms").alias("term")), F.col("term"), rare, F.col("term")).join(rare, "term")
    pairs = seen.alias("s").join(known.alias("k"), same("s", "k")).select("s.id", "s.term", "s.df_t", "k.least", "k.known")
    sure = discloses(F.lit(1), F.col("df_t"), F.col("least")) if min_support <= 1 else F.lit(False)
    maybe = F.filter("known", lambda e: discloses(F.least(F.col("df_t"), e["df_e"]), F.col("df_t"), e["df_e"]))
    pairs = pairs.select("id", "term", "df_t", sure.alias("sure"), F.when(sure, F.array().cast("array<struct<entity:string,df_e:long>>")).otherwise(maybe).alias("known"))
    pairs = scratch.keep(pairs.filter("sure or size(known) > 0"), "pairs")
    open_ = pairs.select("id", "term", "df_t", F.explode("known").alias("e")).select("id", "term", "df_t", "e.entity", "e.df_e")
    counted = frequencies(open_, ["term", "entity", "df_t", "df_e"]).filter((F.col("n") >= min_support) & discloses(F.col("n"), F.col("df_t"), F.col("df_e")))
    disclosing = scratch.keep(pairs.filter("sure").select("term").union(counted.select("term")).distinct(), "disclosing")

    # A disclosing term is marked in every document: first the documents that have one, then the places in these.
    having = docs.select("id", "digest", F.explode(_terms(F.col("text"))).alias("term"))
    having = likely(having, F.col("term"), disclosing, F.col("term")).join(disclosing, "term")  # a semi-join would be moved below the filter
    having = scratch.keep(having.groupBy("id", "digest").agg(F.collect_set("term").alias("terms")), "having")
    spans = likely(kept.select("id", "digest", "base"), F.col("digest"), having, F.col("digest")).dropDuplicates(["id", "digest"])
    wanted = having.alias("h").join(spans.alias("s"), same("h", "s")).select("h.id", "h.digest", _buckets(F.col("terms")).alias("buckets"), "base")
    texts = likely(docs, F.col("digest"), having, F.col("digest")).dropDuplicates(["id", "digest"])
    parts = texts.alias("t").join(wanted.alias("h"), same("t", "h")).select("t.id", "t.digest", "h.buckets", _clear(F.col("t.text"), F.col("h.base")).alias("parts"))
    placed = lambda p: F.transform(_places(p["part"], F.col("buckets")), lambda w: F.struct(F.lit("term").alias("kind"), (p["at"] + w["start"]).alias("start"), (p["at"] + w["end"]).alias("end"), w["value"].alias("value")))
    places = scratch.keep(parts.select("id", "digest", F.flatten(F.transform("parts", placed)).alias("places")), "places")
    rows = kept.alias("k").join(places.alias("t"), same("k", "t"), "left").select("k.id", "k.digest", "base", F.coalesce("places", F.array().cast(SPAN)).cast(SPAN).alias("terms"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = [
        F.col("id").alias(id_col),
        *map(count, KINDS),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    ]
    if with_text:
        once = docs.dropDuplicates(["id", "digest"])
        rows = rows.alias("r").join(once.alias("o"), same("r", "o")).select("r.id", "base", "terms", "text")
        out.append(_sanitised(F.col("text"), F.concat("base", "terms"), generalise).alias("sanitised"))
    return rows.select(*out)


def _sanitised(text: Column, spans: Column, generalise: bool) -> Column:
    """text with each span replaced by its class (a term by [TERM], or by nothing); of overlapping spans the first counts."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    name = lambda s: F.when((s["kind"] == "term") & F.lit(not generalise), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), name(s)).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    return _let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
