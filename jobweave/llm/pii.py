"""Personal data by pattern, and terms that give it away by corpus co-occurrence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.session import written

# The patterns of the base kinds, in their order. The groups repeat possessively and a run of characters is
# tried from its begin only (or from the end of the last match): the same matches, in linear time and constant stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Kind of the terms that the method adds, listed after the others.
TERM = "term"
# What a span is generalised to.
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}

# No base kind does without: an address has an @, a phone a digit after its plus, the others two digits with at most one sign between.
MARKED = r"@|[0-9][\x20.-]?[0-9]|\+[0-9]"

# A term: a run of letters, with marks, apostrophes and hyphens inside.
WORD = r"\p{L}[\p{L}\p{M}'-]{2,}+"
SPAN = "struct<kind:string,begin:int,end:int,value:string>"
# Lines are looked at in segments of at most so many words; a number with blanks inside is one word.
SEGMENT = 32
SEGMENTS = (r"(?:(?:[0-9+(][0-9()+.\x20-]*+|[^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09\x0B-\x0D]*+){1,%d}" % SEGMENT)
# A text's disclosing terms are dealt over so many lists by a hash, so that looking up a word reads a short one.
TERM_LISTS = 64
# Items of a text whose results gather in one array before they join the others.
BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts twice, less 9 if over 9."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """The condition that a match of the pattern must meet."""
    if kind == "ip":
        def small(part: Column) -> Column:
            own = F.ltrim(part, F.lit("0"))
            return (F.length(own) <= 3) & (F.concat(F.lit("0"), F.substring(own, 1, 3)).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _scan(items: Column, kind: str, after, piece) -> Column:
    """Walk through an array with a running place: `after` moves it on by an item, `piece` gives an array of 0 or more results.

    Results gather by blocks of BLOCK items, as appending to one array would take the square of their number.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))
    none = F.array().cast(f"array<{kind}>")

    def inner(block: Column, at: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            return F.struct(after(state["at"], x).alias("at"), F.concat(state["out"], piece(state["at"], x)).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def outer(state: Column, block: Column) -> Column:
        return F.struct(F.aggregate(block, state["at"], after).alias("at"), F.concat(state["out"], F.array(inner(block, state["at"]))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, start, outer, lambda s: F.flatten(s["out"]))).otherwise(none)


def spans_of(text: Column, kind: str, holds=None) -> Column:
    """Spans (kind, begin, end, value) of a kind whose value passes `holds`, in code points, end exclusive; empty for null.

    The text between matches comes from splitting at the same pattern; lengths of both add up to the places.
    """
    holds = holds or (lambda value: _holds(kind, value))
    pattern = PATTERNS.get(kind, WORD)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    def after(at: Column, pair: Column) -> Column:
        return at + pair["gap"] + F.length(pair["hit"])

    def piece(at: Column, pair: Column) -> Column:
        here = F.struct(F.lit(kind).alias("kind"), (at + pair["gap"]).alias("begin"), after(at, pair).alias("end"), pair["hit"].alias("value"))
        return F.when(holds(pair["hit"]), F.array(here)).otherwise(_none())

    return F.when(F.size(found) > 0, F.transform(F.array(pairs), lambda p: _scan(p, SPAN, after, piece))[0]).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by kind as listed, then begin."""
    return F.concat(*(spans_of(text, k) for k in PATTERNS))


def _values(text: Column) -> Column:
    """The different values of a text's base spans."""
    return F.array_distinct(F.transform(base_spans(text), lambda s: s["value"]))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def _segments(text: Column) -> Column:
    """The lines of a text that hold more than white space, cut every SEGMENT words."""
    return F.regexp_extract_all(text, F.lit(SEGMENTS), F.lit(0))


def segments_near_entities(docs: DataFrame) -> DataFrame:
    """(entities, terms) of each segment that is near an entity: it or a neighbouring segment has it, or both share it.

    A segment has SEGMENT words at most, so pairs of entities and terms grow with the text, however long its lines are.
    """
    nothing = F.array().cast("array<string>")
    marked = docs.where(F.col("text").rlike(MARKED)).select(F.concat(F.array(F.lit("")), _segments(F.col("text")), F.array(F.lit(""))).alias("segments"))

    def shared(segment: Column, following: Column) -> Column:  # lines keep their end: no base kind goes over it
        both = F.concat_ws("\n", segment, following)
        joined = F.when(segment.rlike(r"[\x20\x09\x0B-\x0D]$"), F.concat(segment, following)).otherwise(both)
        return F.when(joined.rlike(MARKED), _values(joined)).otherwise(nothing)

    pairs = F.zip_with(F.slice("segments", F.lit(1), F.size("segments") - 1), F.slice("segments", F.lit(2), F.size("segments") - 1), shared)
    near = marked.select("segments", pairs.alias("pairs")).where(F.exists("pairs", lambda values: F.size(values) > 0))
    each = F.arrays_zip(F.slice("segments", F.lit(2), F.size("segments") - 2).alias("segment"), F.slice("pairs", F.lit(1), F.size("pairs") - 1).alias("before"),
                        F.slice("pairs", F.lit(2), F.size("pairs") - 1).alias("after"))
    row = near.select(F.explode(each).alias("x")).select(F.col("x.segment").alias("segment"), F.array_distinct(F.concat("x.before", "x.after")).alias("entities"))
    return row.where(F.size("entities") > 0).select("entities", _terms(F.col("segment")).alias("terms"))


def disclosing_terms(docs: DataFrame, share: float) -> DataFrame:
    """(entity, term): terms that give away an entity, by smoothed pointwise mutual information over all segments of lines.

    An entity is the value of a base span, however seldom it stands. A segment is near it if it or a neighbouring one has it
    (see `segments_near_entities`). All four counts are over the same segments, those of all texts; copies count as
    often as they stand. With N segments, n(e) near e, n(t) with t and n(e, t) with t near e, a term discloses the share
    log(N n(e,t) / (n(e) n(t))) / log(N / n(e)) of what the entity itself tells, and counts from `share` up. Half a segment is
    added to each of the four cells (with and without t, near e or not), as counts of one or two are uncertain.
    """
    lines = docs.where("text is not null").select(_segments(F.col("text")).alias("lines"))
    near = written(segments_near_entities(docs), "near").select(F.explode("entities").alias("entity"), "terms")
    n_entity = near.groupBy("entity").agg(F.count("*").alias("n_e"))
    joint = near.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    n_term = lines.select(F.explode("lines").alias("line")).select(F.explode(_terms(F.col("line"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(lines.agg(F.sum(F.size("lines").cast("long"))).first()[0] or 0)
    told = F.log((n + 2) * (F.col("n_et") + 0.5) / ((F.col("n_e") + 1) * (F.col("n_t") + 1)))
    return joint.join(n_entity, "entity").join(n_term, "term").where((F.col("n_e") < n) & (told >= share * F.log((n + 2) / (F.col("n_e") + 1)))).select("entity", "term")


def _outside(spans: Column, base: Column) -> Column:
    """Those of the spans, in order of place, that overlap no base span: two sweeps over both in order."""
    far = (1 << 31) - 1
    place = f"struct<begin:int,own:int,end:int,span:{SPAN}>"

    def placed(array: Column, own: int) -> Column:
        return F.transform(array, lambda s: F.struct(s["begin"].alias("begin"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span")))

    def sweep(items: Column, after, clear) -> Column:  # all base spans stay, of the others those that are clear
        return _scan(items, place, lambda at, x: F.when(x["own"] == 0, F.greatest(at, after(x))).otherwise(at),
                     lambda at, x: F.when((x["own"] == 0) | clear(at, x), F.array(x)).otherwise(F.array().cast(f"array<{place}>")))

    items = F.array_sort(F.concat(placed(base, 0), placed(spans, 1)))
    ahead = _let(items, lambda p: sweep(p, lambda x: x["end"], lambda at, x: x["begin"] >= at))
    back = _let(F.reverse(ahead), lambda p: sweep(p, lambda x: F.lit(far) - x["begin"], lambda at, x: x["end"] <= F.lit(far) - at))
    return F.transform(F.filter(F.reverse(back), lambda x: x["own"] == 1), lambda x: x["span"])


def _let(value: Column, then) -> Column:
    """What `then` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _list_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_LISTS)).cast("int")


def find_personal_data(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """Rows of `docs` with base_spans and all_spans: arrays of (kind, begin, end, value) by kind, then begin.

    Base spans match the kinds' patterns and conditions. The method's spans (kind `term`) are words of a text that disclose
    an entity of the same text (see `disclosing_terms`) and stand outside its base spans. Statistics cover all lines of
    all texts. Null and empty texts have no spans; rows with equal id and text get equal results; an empty table gives
    none; columns with the names of results are replaced, others stay. Work grows with a text's length, also where it is one
    line. All expressions run in the JVM.
    """
    kept = docs.drop("base_spans", "all_spans")
    docs = kept.toDF(*(c if c in ("doc_id", "text") else f"own {i}" for i, c in enumerate(kept.columns)))  # clear of the names below
    text, key = F.col("text"), ["doc_id", "_hash"]
    holds = text.rlike(MARKED) & (F.size(base_spans(text)) > 0)
    marked = docs.where(holds).withColumn("_hash", F.xxhash64("text"))
    pairs = written(disclosing_terms(docs, share), "disclosing")
    held = written(marked.select(*key, _values(text).alias("entities"), _terms(text).alias("terms")).dropDuplicates(key), "held")

    def same(other: DataFrame, one: DataFrame) -> Column:
        return one["doc_id"].eqNullSafe(other["_id"]) & (one["_hash"] == other["_h"])

    # By term first: a term discloses few entities, while an entity in many texts may have many terms.
    near = held.select(*key, F.explode("terms").alias("term")).join(pairs, "term")
    values = held.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), F.explode("entities").alias("_entity"))
    told = near.join(values, same(values, near) & (near["entity"] == values["_entity"]), "left_semi").groupBy(*key, _list_of(F.col("term")).alias("list")).agg(
        F.collect_set("term").alias("terms")).groupBy(*key).agg(F.collect_list(F.struct("list", "terms")).alias("lists"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(TERM_LISTS - 1)), lambda i: F.get(F.filter("lists", lambda x: x["list"] == i), F.lit(0))["terms"])
    told = written(told.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), filled.alias("_terms")), "told")
    rows = marked.join(told, same(told, marked), "left").withColumn("base_spans", base_spans(text))
    own = spans_of(text, TERM, lambda value: F.coalesce(F.array_contains(F.get("_terms", _list_of(value)), value), F.lit(False)))
    rows = rows.withColumn("all_spans", F.when(F.col("_terms").isNull(), F.col("base_spans")).otherwise(
        _let(F.col("base_spans"), lambda base: F.concat(base, _outside(own, base)))))
    # Texts without spans, by far the most, take no part in the join.
    rest = docs.where(~F.coalesce(holds, F.lit(False))).withColumns({"base_spans": _none(), "all_spans": _none()})
    return rest.unionByName(rows.select(rest.columns)).toDF(*kept.columns, "base_spans", "all_spans")


def number(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """Spans as text: kind:begin:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with every span generalised to the tag of its kind; spans that overlap become the first one's tag."""
    kinds = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def clean(x: Column) -> Column:  # the text's characters, and its spans in order
        letters = x["letters"]

        def after(at: Column, s: Column) -> Column:
            return F.greatest(at, -s["less"])

        def piece(at: Column, s: Column) -> Column:
            before = F.array_join(F.slice(letters, at + 1, F.greatest(s["begin"] - at, F.lit(0))), "")
            return F.when(s["begin"] >= at, F.array(before, kinds[s["kind"]])).otherwise(F.array().cast("array<string>"))

        last = F.array_max(F.transform(x["own"], lambda s: -s["less"]))
        rest = F.array_join(F.slice(letters, last + 1, F.greatest(F.size(letters) - last, F.lit(0))), "")
        return F.concat(F.array_join(_scan(x["own"], "string", after, piece), ""), rest)

    parts = F.struct(F.split(text, "").alias("letters"), in_order.alias("own"))
    done = F.transform(F.array(parts), clean)[0]
    return F.when(F.size(spans) > 0, done).otherwise(text)
