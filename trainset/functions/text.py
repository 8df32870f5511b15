"""String columns with the trimming, templating and JSON rules of the record format."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from trainset.functions.binding import let

# ---- fixed values: the characters that count as white space when text is trimmed ----
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
# --------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and all-white-space text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def shorten_counted(c: Column, limit: int = 300) -> Column:
    """Like :func:`shorten`, but says how much was left out."""
    cut = F.format_string("%s… [%d more chars]", F.substring(c, 1, limit), F.length(c) - limit)
    return F.when(F.length(c) > limit, cut).otherwise(c)


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """Uniform, reproducible order key: the md5 of ``seed:key[:key…]`` as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def render_template(template: str, columns: list[str], types: dict[str, str] | None = None) -> Column:
    """``"Translate: {en}"`` over columns; NULL becomes empty, unknown columns fail here."""
    pieces: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if name not in columns:
            raise KeyError(f"no column {name!r} for the template")
        if conversion:
            raise ValueError("conversions such as {x!r} are not supported in templates")
        value = F.col(f"`{name}`")
        if spec:
            value = F.when(value.isNotNull(), F.format_string(f"%{spec}", value))
        pieces.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def split_reasoning(content: Column) -> Column:
    """``struct<reasoning, answer>`` of an assistant answer.

    Recognises a leading ``<think>…</think>`` block, or a single closing tag that has
    text before it (the opening tag was part of the prompt).
    """
    body = lstrip(content)
    after_open = F.substr(body, F.lit(len(THINK_OPEN) + 1))
    leading = body.startswith(F.lit(THINK_OPEN)) & body.contains(THINK_CLOSE)
    closes = (F.length(content) - F.length(F.replace(content, F.lit(THINK_CLOSE)))) / len(THINK_CLOSE)
    before = strip(_head(content))
    lone = ~content.contains(THINK_OPEN) & (closes == 1) & (before != "")
    # The head of a leading block may be empty text: that still counts as extracted.
    return (
        F.when(
            leading,
            F.struct(
                strip(_head(after_open)).alias("reasoning"),
                F.ltrim(_tail(after_open), F.lit("\n")).alias("answer"),
            ),
        )
        .when(
            lone,
            F.struct(before.alias("reasoning"), F.ltrim(_tail(content), F.lit("\n")).alias("answer")),
        )
        .otherwise(F.struct(F.lit(None).cast("string").alias("reasoning"), content.alias("answer")))
    )


def _head(c: Column) -> Column:
    return F.substring_index(c, THINK_CLOSE, 1)


def _tail(c: Column) -> Column:
    return F.substr(c, F.length(_head(c)) + F.lit(len(THINK_CLOSE) + 1))


def parse_json(c: Column) -> Column:
    """VARIANT of a JSON text, NULL if the text is anything but exactly one JSON value.

    The built-in parser ignores what follows the first value. Text that closes the list around it
    early breaks the object around it, and the reverse, so only one value passes both.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return let(
        F.try_variant_get(inside, "$", "array<variant>"),
        lambda values: F.when((F.size(values) == 1) & member.isNotNull(), F.get(values, F.lit(0))),
    )


def json_like(c: Column) -> Column:
    """VARIANT of text that looks like a JSON list or object, NULL for other text."""
    return F.when(lstrip(c).rlike(r"^[\[{]"), parse_json(c))


def parse_reply(reply: Column) -> Column:
    """VARIANT in a model reply: plain JSON, a fenced block, or the outermost brackets."""
    text = strip(reply)
    fences = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?s)```(.*?)(?:```|\z)"), F.lit(1)),
            lambda chunk: parse_json(
                strip(
                    F.when(
                        lstrip(chunk).startswith("json") | lstrip(chunk).startswith("JSON"),
                        F.substr(chunk, F.locate("\n", chunk) + F.lit(1)),
                    ).otherwise(chunk)
                )
            ),
        ),
        lambda v: v.isNotNull(),
    )
    brackets = parse_json(F.regexp_extract(text, r"(?s)^[^\[{]*(\[.*\]|\{.*\})", 1))
    return F.coalesce(parse_json(text), F.try_element_at(fences, F.lit(1)), brackets)
