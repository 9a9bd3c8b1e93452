"""Clean-up and checks of model outputs and drafts."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave import fixed
from jobweave.functions.text import py_strip, word_count


def clean_output(raw: Column) -> Column:
    """F-14: drop reasoning blocks and a surrounding code fence."""
    text = py_strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))

    def inner(mark: str) -> Column:
        return py_strip(F.substr(text, F.lit(len(mark) + 1), F.greatest(F.length(text) - len(mark) - 3, F.lit(0))))

    return F.when(text.startswith("```json"), inner("```json")).when(text.startswith("```"), inner("```")).otherwise(text)


def is_json(text: Column) -> Column:
    """The text is one well-formed JSON value; keys may repeat. `NaN` and infinities are no JSON.

    It is read as the first item of a list with a second one, which a value that ends early or runs on would upset.
    """
    item = F.concat(F.lit("["), text, F.lit(",0]"))
    whole = (F.get_json_object(item, "$[1]") == "0") & F.get_json_object(item, "$[2]").isNull()
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")  # the reader would take single quotes
    return F.coalesce(whole & ~F.contains(bare, F.lit("'")), F.lit(False))


def call_outcome(status: Column, error: Column, raw: Column) -> Column:
    """F-19: class of one model call, by status, error text and output."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (F.when(low.contains("limit reached"), "limit")
            .when(low.contains("timeout"), "timeout")
            .when(status >= 400, "http")
            .when((low != "") | status.isNull(), "request")
            .when(raw.isNull(), "bad format")
            .when(~is_json(clean_output(raw)), "bad json")
            .otherwise("ok"))


def draft_body(body: Column, email: Column) -> Column:
    """F-15: the body, else the e-mail field, else an empty text."""
    return F.coalesce(body, email, F.lit(""))


def draft_check(body: Column, has_intent: Column) -> Column:
    """F-15: names of the broken draft rules, joined with commas; empty when all hold."""
    banned = rf"(?i)^\s*(?:{'|'.join(fixed.BANNED_OPENERS)})"
    return F.concat_ws(",",
                       F.when(word_count(body) > fixed.DRAFT_WORDS, "too long"),
                       F.when(body.rlike(banned), "banned opener"),
                       F.when(~F.coalesce(has_intent, F.lit(False)), "no intent line"))
