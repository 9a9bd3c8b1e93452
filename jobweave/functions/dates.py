"""Lenient dates: a text's numbers and words, taken apart and resolved to year, month and day in any order."""
import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import fixed

_MONTHS = {name: n for n, names in enumerate(fixed.MONTH_NAMES, 1) for name in names}
_DAYS = {name: names[0] for names in fixed.WEEKDAY_NAMES for name in names}
_NAMED = "|".join(sorted([*_MONTHS, *_DAYS], key=len, reverse=True))
_WORDS = "|".join(sorted([*_MONTHS, *_DAYS, *fixed.DATE_FILLERS], key=len, reverse=True))
# A time of day with its zone; it says nothing about the date.
_CLOCK = (r"(?:(?<=\d)t|(?<![\d:]))\s*(?<!\d)\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\.?(?![a-z]))?"
          r"\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?(?![\d:])")
# Digits, single marks and known words in a row, and nothing else.
_READABLE = rf"^(?:\d++|[\s.,;/'-]|(?<!\p{{L}})(?:{_WORDS})(?!\p{{L}}))++$"
# A number that is no day of a month must not run into a name.
_STUCK = rf"(?<!\d)(?:0++|3[2-9]|[4-9]\d|\d{{3,}}+)(?:{_NAMED})"
# One dot or comma inside digits makes a number of them, whose whole part counts.
_DECIMAL = r"(?<![\d.,])(\d++)(?:\.|(?<=\d\d),)\d++(?![.,]?\d)"
# Six characters of it are taken for a time of day, which they are not.
_CUT = r"(?<![\d.,])(?:\d\.\d{4}|\d{2}[.,]\d{3}|\d{3}[.,]\d{2}|\d{4}[.,]\d)(?![.,]?\d)"
# A dash or slash right behind a month's name wants a number, and right behind any other number a whole one.
_TORN = rf"(?<!\p{{L}})(?:{'|'.join(sorted(_MONTHS, key=len, reverse=True))})[/-](?!\d)|(?<![\d.,])\d++[.,]\d++[/-]|[\p{{L}}\d][/-]\d++[.,]\d++(?![.,]?\d)"


def lenient_date(text: Column, near_year: Column) -> Column:
    """The date a text names, missing parts taken from 1 January 2000; null for texts that name none.

    Month names count as months, numbers above 100 or of more than two digits as years. The others follow from order:
    `03/2019`, `mar 3 2019`, `3 march, 2019`, `2019 mar`, `20190301`, `2019-03-01t10:00:00`, `mar 3rd 2019`. Of two plain
    numbers the first is the month unless one is above 31; of three it is month, day, year, unless the first is above 12
    (day, month, year) or 31 (year, month, day). A single plain number is a day, above 31 a year. Years of two digits lie
    within 50 years of `near_year`. A weekday without a day means the first one on or after the date. Unknown words, a
    second month, more than three numbers and impossible days make a text unreadable. A time of day is cut out; alone it is no
    date. All patterns are linear.
    """
    return _let(F.regexp_replace(F.lower(text), _CLOCK, " "), lambda t: _let(
        F.when(_readable(t), F.regexp_extract_all(F.regexp_replace(t, _DECIMAL, "$1 "), F.lit(r"(\d+|\p{L}+)"), F.lit(1))),
        lambda tokens: _let(F.struct(
            F.flatten(F.transform(tokens, _values)).alias("read"),
            F.get(F.filter(tokens, lambda w: w.isin(list(_DAYS))), F.lit(0)).alias("weekday")), lambda r: _let(
                _parts(r["read"], r["weekday"]), lambda parts: _date(parts, r["weekday"], near_year)))))


def _let(value: Column, then) -> Column:
    """What `then` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _readable(t: Column) -> Column:
    """Digits, marks and known words only; texts of over 100 characters are no dates."""
    return (F.length(t) <= 100) & t.rlike(_READABLE) & ~t.rlike(_STUCK) & ~t.rlike(_CUT) & ~t.rlike(_TORN)


def _values(w: Column) -> Column:
    """The numbers a token stands for, with their kind: `m` month, `y` year, or open."""
    def number(digits: Column, kind: str = "") -> Column:
        value = F.when(F.length(digits) <= 9, digits).otherwise("999999999").cast("int")
        return F.struct(value.alias("value"), (F.lit(kind) if kind else F.when((F.length(digits) > 2) | (value > 100), "y").otherwise("")).alias("kind"))

    def part(at: int, length: int = 2, kind: str = "") -> Column:
        return number(F.substr(w, F.lit(at), F.lit(length)), kind)

    size, month = F.length(w), reduce(lambda chain, m: chain.when(w == m[0], F.lit(m[1])), _MONTHS.items(), F.when(F.lit(False), F.lit(0)))
    return (F.when(w.rlike(r"^\d"), F.when(size.isin(8, 12, 14), F.array(part(1, 4, "y"), part(5), part(7)))
                   .when(size == 6, F.array(part(1), part(3), part(5))).otherwise(F.array(number(w))))
            .when(w.isin(list(_MONTHS)), F.array(F.struct(month.alias("value"), F.lit("m").alias("kind"))))
            .otherwise(F.array().cast("array<struct<value:int,kind:string>>")))


def _parts(read: Column, weekday: Column) -> Column:
    """Year, month and day by the rules of order; null where they cannot be told. `dated` tells that the year is labelled."""
    kinds = F.transform(read, lambda v: v["kind"])
    facts = F.struct(F.size(read).alias("n"), F.array_position(kinds, "m").cast("int").alias("m"), F.array_position(kinds, "y").cast("int").alias("y"),
                     F.size(F.filter(kinds, lambda k: k == "m")).alias("months"), *[F.get(read, F.lit(i))["value"].alias("abc"[i]) for i in range(3)])

    def told(f: Column) -> Column:
        n, m, y, a, b, c = (f[name] for name in ("n", "m", "y", "a", "b", "c"))  # m and y: place from 1, 0 where there is none
        none, labelled = F.lit(None).cast("int"), (m > 0).cast("int") + (y > 0).cast("int")

        def at(place: Column) -> Column:
            return F.when(place == 1, a).when(place == 2, b).when(place == 3, c)

        def of(year: Column, month: Column, day: Column) -> Column:
            return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), (y > 0).alias("dated"))

        cases = [
            (f["months"] > 1, F.lit(None)),
            ((n == labelled) & (n > 0), of(at(y), at(m), none)),
            ((n == 3) & (labelled == 2), of(at(y), at(m), at(6 - m - y))),
            ((n == 1) & (a > 31), of(a, none, none)), (n == 1, of(none, none, a)),
            ((n == 2) & (m > 0) & (at(3 - m) > 31), of(at(3 - m), at(m), none)), ((n == 2) & (m > 0), of(none, at(m), at(3 - m))),
            ((n == 2) & (a > 31), of(a, b, none)), ((n == 2) & (b > 31), of(b, a, none)), (n == 2, of(none, a, b)),
            ((n == 3) & (m == 1) & (b > 31), of(b, a, c)), ((n == 3) & (m == 1), of(c, a, b)),
            ((n == 3) & (m == 2) & (a > 31), of(a, b, c)), ((n == 3) & (m == 2), of(c, b, a)),
            ((n == 3) & (m == 3) & (b > 31), of(b, c, a)), ((n == 3) & (m == 3), of(a, c, b)),
            ((n == 3) & ((a > 31) | (y == 1)), of(a, b, c)), ((n == 3) & (a > 12), of(c, b, a)), (n == 3, of(c, a, b)),
            ((n == 0) & weekday.isNotNull(), of(none, none, none)),
        ]
        return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))

    return _let(facts, told)


def _date(parts: Column, weekday: Column, near_year: Column) -> Column:
    """The date of parts that are possible; a weekday without a day moves it forward."""
    near = parts["y"] + F.floor(near_year / 100).cast("int") * 100
    full = F.when((parts["y"] >= 100) | parts["dated"], parts["y"]).otherwise(
        F.when(near >= near_year + 50, near - 100).when(near < near_year - 50, near + 100).otherwise(near))

    def moved(date: Column) -> Column:
        following = reduce(lambda chain, d: chain.when(weekday.isin(list(d)), F.next_day(F.date_sub(date, 1), d[0])), fixed.WEEKDAY_NAMES, F.when(F.lit(False), date))
        return F.when(weekday.isNull() | parts["d"].isNotNull(), date).otherwise(following)

    def dated(p: Column) -> Column:
        possible = p["y"].between(1, 9999) & p["m"].between(1, 12)
        first = F.when(possible, F.make_date(p["y"], p["m"], F.lit(1)))
        return F.when((p["d"] >= 1) & (p["d"] <= F.dayofmonth(F.last_day(first))), F.date_add(first, p["d"] - 1))

    whole = F.struct(F.coalesce(full, F.lit(2000)).alias("y"), F.coalesce(parts["m"], F.lit(1)).alias("m"), F.coalesce(parts["d"], F.lit(1)).alias("d"))
    return F.when(parts.isNotNull(), _let(_let(whole, dated), moved))


def parse_role_date(s: Column, as_of) -> Column:
    """F-07: lenient date; missing, open-ended or unreadable texts mean `as_of`, which also places years of two digits."""
    now = F.lit(as_of if isinstance(as_of, datetime.date) else str(as_of)).cast("date")
    text = F.lower(F.trim(s))
    for word in fixed.OPEN_END_CUTS:
        text = F.replace(text, F.lit(word), F.lit(""))
    is_open = s.isNull() | F.lower(s).isin(*fixed.OPEN_END_WORDS)
    return F.when(is_open, now).otherwise(F.coalesce(lenient_date(text, F.year(now)), now))
