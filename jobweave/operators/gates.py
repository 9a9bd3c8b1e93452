"""The three gates a posting must pass: experience, location and remote work."""
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions.experience import parse_years
from jobweave.functions.text import token_text

_WORDS = "|".join(fixed.GATE_SENIOR_WORDS)
# Stands between the words of a head and those of the text behind it; no word holds it.
MARK = "\x01"
# Stands between the names of places.
BETWEEN = "\x02"


def gate_senior(title: Column) -> Column:
    """The title holds one of the gate's words as a whole word, or `sr.`."""
    return F.lower(title).rlike(rf"(^|[^a-z])(sr\.|(?:{_WORDS})([^a-z]|$))")


def gate_experience(title: Column, req: Column, years: Column, tolerance: float = fixed.GATE_TOLERANCE) -> Column:
    """P-06: no senior title below the threshold, and no requirement beyond years plus tolerance."""
    senior = F.coalesce(gate_senior(title), F.lit(False)) & (years < fixed.SENIOR_YEARS)
    return ~senior & F.coalesce(parse_years(req) <= years + F.lit(tolerance), F.lit(True))


def gate_location(country: Column, wanted: Column) -> Column:
    """P-07: no country found, none wanted, or the wanted one; `country` is that of `stated_country`."""
    return country.isNull() | wanted.isNull() | (country == wanted)


def stated_country(*found: Column) -> Column:
    """The country that title, location and text of a posting agree on, null where none of them names one.

    Each is the one country its field names. Where fields name different ones, all are listed, so that nobody's country is
    equal to it and the posting is rejected for everyone who wants one (a title says one country, the text another).
    """
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return F.nullif(F.array_join(named, " / "), F.lit(""))


def gate_remote(text: Column, remote_only: Column) -> Column:
    """P-08: asked for only by candidates who work remotely."""
    return ~remote_only | F.coalesce(text.rlike(fixed.REMOTE), F.lit(False))


class Places:
    """A table of places, prepared for finding them in texts; `places` has columns `place` and `country`.

    A table of up to `most_places` is one pattern, so a text's country is told where the text lies (`with_country`), without a join. For a
    larger one, a text's words are looked up by the first words of places (`begins`, `countries`). Up to `most_words`
    different ones, they are part of the expression that reads the text, so only words that may begin a place leave it; a
    table with more of them is met by a join on every word instead. All give the same places.
    """

    def __init__(self, places: DataFrame, most_words: int = 10_000, most_places: int = 1_000):
        name = F.trim(token_text(F.col("place")))
        named = places.select(name.alias("place"), "country").where("place <> '' and country is not null")
        # a place of several countries keeps the least and the largest of them
        self.lookup = named.groupBy("place").agg(F.min("country").alias("low"), F.max("country").alias("high")).select(
            "*", F.split_part("place", F.lit(" "), F.lit(1)).alias("first"), (F.regexp_count("place", F.lit(" ")) + 1).alias("words"))
        firsts = self.lookup.groupBy("first").agg(F.max("words").alias("words"))
        size = firsts.agg(F.count("*").alias("n"), F.max("words").alias("longest")).first()
        self.longest = size["longest"] or 1
        self.firsts = [r["first"] for r in firsts.select("first").collect()] if size["n"] <= most_words else None
        few = self.lookup.limit(most_places + 1).collect() if size["n"] <= min(most_words, most_places) else None
        self.pattern = None if few is None or len(few) > most_places else self._pattern(few)
        self.low, self.high = ({r["place"]: r[c] for r in few or []} for c in ("low", "high"))

    @staticmethod
    def _pattern(places: list) -> str:
        """Matches, in blank-separated words, the longest place that begins at a word; MARK may stand between its words."""
        tails: dict[str, list[list[str]]] = {}
        for r in sorted(places, key=lambda r: -r["words"]):
            first, *rest = (re.escape(w) for w in r["place"].split(" "))
            tails.setdefault(first, []).append(rest)
        gap = f" (?:{MARK} )?"
        some = [f"{first}(?:{'|'.join(''.join(gap + w for w in rest) + '(?= )' for rest in all_)})" for first, all_ in tails.items()]
        return rf"(?<= )({'|'.join([*some, f'{MARK}(?= )'])})"

    def mentions(self, text: Column) -> Column:
        """False where no word of the text can begin a place; told for few first words only."""
        if self.firsts is None or len(self.firsts) > 50:
            return text.isNotNull()
        low = F.lower(text)
        return reduce(or_, [F.contains(low, F.lit(w)) for w in self.firsts], F.lit(False))

    def names(self, text: Column) -> Column:
        """Places that a text names, from left to right, with BETWEEN between them; null where it mentions none."""
        return F.when(self.mentions(text), self.names_in(token_text(text)))

    def names_in(self, tokens: Column) -> Column:
        """Places in the words of `token_text`."""
        return F.array_join(F.regexp_extract_all(tokens, F.lit(self.pattern), F.lit(1)), BETWEEN)

    def bounds(self, names: Column) -> Column:
        """The least and the largest country of `names`; only several names are taken one by one."""
        one = F.btrim(names, F.lit(BETWEEN))

        def of(known: dict, merge) -> Column:
            if not known:
                return F.lit(None).cast("string")
            table = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())))
            each = F.transform(F.split(one, BETWEEN), lambda p: F.try_element_at(table, p))
            return F.when(F.contains(one, F.lit(BETWEEN)), merge(each)).otherwise(F.try_element_at(table, one))

        return F.struct(of(self.low, F.array_min).alias("low"), of(self.high, F.array_max).alias("high"))

    def with_country(self, df: DataFrame, column: str, text: str) -> DataFrame:
        """Adds the one country that a text's places name, null for none or several; needs the pattern of a small table."""
        both = self.bounds(F.col("_names"))
        named = df.withColumn("_names", self.names(F.col(text))).withColumn("_both", both)
        return named.withColumn(column, F.expr("nullif(_both.low, nullif(_both.low, _both.high))")).drop("_names", "_both")

    def after_words(self, tokens: Column) -> Column:
        """`names_in` where a place before the words takes the first 0, 1, ... of them."""
        cut = [self.names_in(F.regexp_replace(tokens, rf"^(?: [^ ]++){{0,{n}}}", "")) for n in range(self.longest)]
        return F.when(tokens.isNotNull(), F.array(*cut))

    def opening(self, text: Column) -> Column:
        """The first words of a text, as many as a place that begins before it may take, and a few more."""
        return F.trim(token_text(F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{N}}|]*+(?:\||[\p{{L}}\p{{N}}]++)){{0,{self.longest}}}+", 0)))

    def names_before(self, head: Column, opening: Column) -> Column:
        """Names that begin in `head`, then one with MARK in it: MARK alone, or a place that reaches into the text behind."""
        return F.when(self.mentions(head), self.names_in(F.concat(token_text(head), F.lit(f"{MARK} "), opening, F.lit(" "))))

    def own_names(self, before: Column) -> Column:
        """Names that begin in a head, of its `names_before`."""
        return F.concat(F.substring_index(before, MARK, 1), F.substr(self._reaching(before), F.lit(2)))

    def taken(self, before: Column) -> Column:
        """How many words of the text behind the last place of a head takes."""
        return F.coalesce(F.regexp_count(self._reaching(before), F.lit(" ")), F.lit(0))

    @staticmethod
    def _reaching(before: Column) -> Column:
        return F.split_part(F.split_part(before, F.lit(MARK), F.lit(2)), F.lit(BETWEEN), F.lit(1))

    def begins(self, text: Column) -> Column:
        """Where a text may begin to name a place: an array of (at, window), the word's number and the words from there on."""
        none = F.array().cast("array<struct<at:int,window:string>>")

        def windows(words: Column) -> Column:  # split once, however many words begin a place
            def window(word: Column, i: Column) -> Column:
                ahead = F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, F.lit(self.longest)), " ").alias("window"))
                return ahead if self.firsts is None else F.when(word.isin(self.firsts), ahead)

            return F.transform(words, window)

        found = F.transform(F.array(F.split(F.trim(token_text(text)), " ")), windows)[0]
        if self.firsts is None:
            return F.coalesce(found, none)
        found = F.array_compact(found)
        if len(self.firsts) <= 50:  # a text without any of few words need not be split
            low = F.lower(text)
            found = F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in self.firsts], F.lit(False)), found)
        return F.coalesce(found, none)

    def countries(self, df: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
        """keys and a column per field: the one country which that field's places name, null for none or several.

        `fields` gives for a result column the column of `df` with what `begins` gave; keys that name no place have no row.
        From left to right the longest place counts, and none that begins inside it.
        """
        def in_field(field: str):
            return lambda b: F.struct(F.lit(field).alias("field"), b["at"].alias("at"), b["window"].alias("window"))

        marked = [F.transform(F.col(column), in_field(field)) for field, column in fields.items()]
        rows = df.select(*keys, F.explode(F.concat(*marked)).alias("b")).select(*keys, "b.*").withColumn("_first", F.split_part("window", F.lit(" "), F.lit(1)))
        hits = (rows.join(self.lookup, F.col("_first") == F.col("first"))
                .where(F.startswith(F.concat("window", F.lit(" ")), F.concat("place", F.lit(" ")))))
        hit = F.struct("field", "at", (-F.col("words")).alias("back"), "low", "high")
        per_key = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"))

        def country(field: str) -> Column:
            none = F.lit(None).cast("string")
            start = F.struct(F.lit(0).alias("end"), none.alias("low"), none.alias("high"))

            def step(seen: Column, h: Column) -> Column:
                return F.when(h["at"] < seen["end"], seen).otherwise(F.struct(
                    (h["at"] - h["back"]).alias("end"), F.least(seen["low"], h["low"]).alias("low"), F.greatest(seen["high"], h["high"]).alias("high")))

            last = F.aggregate(F.filter("hits", lambda h: h["field"] == field), start, step)
            return F.when(last["low"] == last["high"], last["low"])

        return per_key.select(*keys, *(country(field).alias(field) for field in fields))


def as_places(places: DataFrame | Places) -> Places:
    """A table of places, prepared; one that is prepared stays as it is."""
    return places if isinstance(places, Places) else Places(places)


def place_countries(df: DataFrame, key: str, text: str, places: DataFrame | Places) -> DataFrame:
    """Rows (key, country) with the country named by a text; keys whose text names no places, or those of several countries, have none or a null.

    Without a filter by what is found: Spark would move it to where the text is made and search each text again for it.
    """
    known = as_places(places)
    if known.pattern:
        return known.with_country(df.select(key, F.col(text).alias("_text")), "country", "_text").select(key, "country")
    begins = df.select(key, known.begins(F.col(text)).alias("_begins"))
    return known.countries(begins, [key], {"country": "_begins"})


def detect_places(df: DataFrame, key: str, text: str, places: DataFrame | Places) -> DataFrame:
    """Country named by a text: one row (key, country) per key whose text names places of exactly one country."""
    return place_countries(df, key, text, places).where("country is not null")


def evaluate_gates(df: DataFrame) -> DataFrame:
    """P-09: verdict and trace per row.

    Reads columns `title, required_text, years, country, wanted_country, location, remote_only`; `location` is the text that
    says where the work is done, such as the whole posting.
    A row without `required_text` counts as one whose evaluation failed (P-10).
    """
    req, years = F.col("required_text"), F.col("years")
    evaluated = req.isNotNull()
    gates = {
        "experience_gate": (gate_experience(F.col("title"), req, years),
                            F.format_string("JD requires %s, candidate has %s yrs.", req, years.cast("string"))),
        "location_gate": (gate_location(F.col("country"), F.col("wanted_country")),
                          F.concat(F.lit("location "), F.coalesce(F.col("country"), F.lit("not stated")))),
        "remote_gate": (gate_remote(F.col("location"), F.col("remote_only")),
                        F.when(F.col("remote_only"), F.lit("remote work asked for")).otherwise(F.lit("not asked for"))),
    }
    trace = F.struct(*[
        F.when(evaluated, F.concat(F.when(ok, F.lit("Passed — ")).otherwise(F.lit("Failed — ")), why)).alias(name)
        for name, (ok, why) in gates.items()])
    verdict = evaluated
    for ok, _ in gates.values():
        verdict = verdict & ok
    return with_gate_defaults(df.withColumn("is_valid", F.when(evaluated, verdict)).withColumn("reasoning_trace", trace))


def with_gate_defaults(df: DataFrame) -> DataFrame:
    """P-10: a missing verdict rejects with `Error` traces; a missing requirement becomes `Unknown`."""
    failed = F.col("is_valid").isNull()
    trace = F.struct(*[
        F.when(failed, F.lit("Error")).otherwise(F.coalesce(F.col(f"reasoning_trace.{g}"), F.lit(""))).alias(g)
        for g in ("experience_gate", "location_gate", "remote_gate")])
    return (df.withColumn("reasoning_trace", trace)
            .withColumn("is_valid", F.coalesce(F.col("is_valid"), F.lit(False)))
            .withColumn("required_text", F.coalesce(F.col("required_text"), F.lit("Unknown"))))
