"""Text functions built from native expressions, so they stay inside whole-stage codegen."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import fixed

# The patterns of `fixed` for matching in the JVM: repeats are possessive and an address is sought from the begin of its run
# of characters, so that long inputs take linear time and constant stack.
COMPANY = r"\b(?:About|at)\s++([A-Z0-9][A-Za-z0-9&-]*+(?: [A-Z0-9][A-Za-z0-9&-]*+)*+)"
EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9.-]*\.[A-Za-z]{2})"
         r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def py_strip(s: Column) -> Column:
    """Trim every Unicode space at both ends."""
    return F.regexp_replace(s, rf"\A{fixed.PY_SPACE}+|{fixed.PY_SPACE}+\z", "")


def py_title(s: Column) -> Column:
    """F-02: title case where any non-letter starts a new word (`3m-x` -> `3M-X`)."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))

    def word(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))  # may grow, as in ß -> SS -> Ss
        return F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2))), F.substr(run, F.lit(2)))

    return F.array_join(F.transform(runs, word), "")


def token_text(s: Column) -> Column:
    """Lower-cased words separated and surrounded by one blank; `|` stays a word of its own."""
    bars = F.replace(F.lower(s), F.lit("|"), F.lit(" | "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bars, r"[^\p{L}\p{N}|]+", " ")), F.lit(" "))


def truncate(s: Column, n: int) -> Column:
    """F-06: the first n characters."""
    return F.substring(s, 1, n)


def word_count(s: Column) -> Column:
    """F-11: number of words between Unicode spaces."""
    return F.regexp_count(s, F.lit("[^" + fixed.JS_SPACE[1:] + "+"))


def with_protocol(url: Column) -> Column:
    """F-09: prefix `https://` unless a web protocol is there already."""
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def referrer_name(title: Column) -> Column:
    """F-10: the text before the first hyphen; a missing title gives a fixed name."""
    return py_strip(F.substring_index(F.coalesce(title, F.lit("LinkedIn Member")), "-", 1))


def extract_company(text: Column) -> Column:
    """F-05: the name after `About` or `at`, null when there is none."""
    return F.nullif(F.regexp_extract(text, COMPANY, 1), F.lit(""))


def extract_team(text: Column) -> Column:
    """F-05: the name after `Team:`, null when there is none."""
    return F.nullif(F.regexp_extract(F.when(F.contains(text, F.lit("eam:")), text), fixed.TEAM, 1), F.lit(""))


def extract_emails(text: Column) -> Column:
    """P-21: all e-mail addresses, in text order; only texts with an `@` are searched. An address ends with letters."""
    found = F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))
    found = F.filter(F.transform(found, lambda a: F.regexp_extract(a, r"^([^@]*@.*\.[A-Za-z]{2,})", 1)), lambda a: a != "")
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def extract_phones(text: Column) -> Column:
    """P-21: all phone-like numbers, in text order."""
    return F.regexp_extract_all(text, F.lit(f"({fixed.PHONE})"), F.lit(1))


def redact(text: Column) -> Column:
    """P-21: replace e-mail addresses and phone numbers."""
    mailed = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, "[email]")).otherwise(text)
    return F.regexp_replace(mailed, fixed.PHONE, "[phone]")


def skill_overlap(skills: Column, text: Column) -> Column:
    """F-13: share of the first skills that occur in the text; null without skills."""
    first = F.slice(skills, 1, fixed.MAX_SKILLS)
    low = F.lower(text)
    hits = F.size(F.filter(first, lambda s: F.contains(low, F.lower(s))))
    return F.when(F.size(first) > 0, hits / F.size(first))


def confidence_tier(c: Column) -> Column:
    """P-19: null or 0 has no badge."""
    return F.when(c.isNull() | (c == 0), F.lit("none")).when(c >= 0.85, F.lit("high")).otherwise(F.lit("medium"))


def confidence_label(c: Column) -> Column:
    """P-19: whole percent, halves rounded up; null without a badge."""
    return F.when(c.isNotNull() & (c != 0),
                  F.concat(F.floor(c * 100 + 0.5).cast("bigint").cast("string"), F.lit("% fit")))


def main_content(html: Column) -> Column:
    """S-04: text without boilerplate elements, comments and tags; entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in fixed.BOILERPLATE:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in fixed.ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s\x{a0}]+", " "))
