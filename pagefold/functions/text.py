"""Text rules of layout elements: figure labels and numbers, roles, scripts, shares of numbers, safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefold.functions.geometry import Box, height, sides, width, zero
from pagefold.functions.values import let

# How a figure label is written.
FIGURE_PREFIX = r"(?:fig(?:ure)?\.?|图|圖)"
FIGURE_NUMBER = r"\d+(?:\.\d+)*(?:-\d+)?[A-Za-z]?"
LABEL_END = r"(?=\s|[:：.。)、\]-]|$)"
CAPTION = rf"(?i)^\s*({FIGURE_PREFIX})\s*({FIGURE_NUMBER}){LABEL_END}"
REFERENCE = rf"(?i)({FIGURE_PREFIX})\s*({FIGURE_NUMBER}){LABEL_END}"
SUBFIGURE = r"^\s*(\([a-zA-Z]\)|[a-zA-Z]\))\s*$"
SECTION_HEAD = r"^\s*\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z -]{4,}"
AFTER_LABEL = (":", "：", ".", "。", ")", "）", "]", "-", "—")
#: A caption has at most so many lines and characters.
CAPTION_LINES, CAPTION_CHARS = 6, 520
#: What goes on after the label of a reference, and the shares of the page that a full-width line has.
SHOWS, GOES_ON = "所示|显示|顯示", "[a-z]"
FULL_WIDTH, FULL_MARGIN, FULL_HEIGHT = 0.68, 0.18, 0.08
#: Words and numbers of a label.
TOKEN = r"[A-Za-z]+|\d+(?:\.\d+)?"
#: Weights of a text over a caption.
SCOPE = {"distance": 0.45, "symbol": 0.28, "compact": 0.34, "structured": 0.34}
UNIT = r"(?:\[[^\]]{1,28}\]|\((?=[^)]*[A-Za-zμµ°/%])[A-Za-z0-9μµ°/%.\s-]{1,18}\)|\d+(?:\.\d+)?\s*%|/[A-Za-z])"


def leading_figure_number(text: Column) -> Column:
    """The number of a figure label at the start, such as 3.2, 4-1 or 2A; null without one."""
    return F.nullif(F.regexp_extract(F.trim(text), CAPTION, 2), F.lit(""))


def starts_like_caption(text: Column) -> Column:
    return F.trim(text).rlike(CAPTION)


def is_plausible_caption(text: Column, full_width: Column) -> Column:
    """Short enough, no section heading in a later line, and no full-width sentence that goes on after the label."""
    t = F.trim(text)
    lines = F.filter(F.transform(F.split(t, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.ltrim(F.regexp_replace(t, CAPTION, ""))
    goes_on = full_width & (rest != "") & ~F.substring(rest, 1, 1).isin(*AFTER_LABEL) & rest.rlike(f"^(?:{SHOWS}|{GOES_ON})")
    headed = F.exists(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(SECTION_HEAD))
    return (F.size(lines) <= CAPTION_LINES) & (F.length(t) <= CAPTION_CHARS) & ~headed & ~goes_on


def text_role(text: Column, full_width: Column | None = None) -> Column:
    """``struct(role, confidence, prefix, number)``: figure_caption, body_reference or subfigure_label, first match; null for other text."""
    t = F.trim(text)
    found = lambda role, conf, prefix, number: F.struct(F.lit(role).alias("role"), F.lit(conf).alias("confidence"), prefix.alias("prefix"), number.cast("string").alias("number"))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    plausible = is_plausible_caption(t, F.lit(False) if full_width is None else full_width)
    return (
        F.when(t.rlike(CAPTION) & plausible, found("figure_caption", 0.95, part(CAPTION, 1), part(CAPTION, 2)))
        .when(t.rlike(CAPTION), found("body_reference", 0.7, part(CAPTION, 1), part(CAPTION, 2)))
        .when(t.rlike(SUBFIGURE), found("subfigure_label", 0.85, part(SUBFIGURE, 1), F.lit(None)))
        .when(t.rlike(REFERENCE), found("body_reference", 0.7, part(REFERENCE, 1), part(REFERENCE, 2)))
    )


def cjk_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[㐀-鿿]"))


def numeric_share(text: Column, token: str = TOKEN) -> Column:
    """Share of tokens that begin with a digit; null without tokens."""
    tokens = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    return F.try_divide(F.size(F.filter(tokens, lambda x: x.rlike("^[0-9]"))).cast("double"), F.size(tokens))


def looks_like_table_row(text: Column, least_tokens: int = 6, least_share: float = 0.3) -> Column:
    tokens = F.regexp_count(text, F.lit(TOKEN))
    return (tokens >= least_tokens) & (F.coalesce(numeric_share(text), F.lit(0.0)) >= least_share)


def has_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for k in keywords:
        found = found | low.contains(k)
    return found


def safe_stem(name: Column) -> Column:
    """Letters, digits and ``._-`` stay, anything else becomes ``_``."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def safe_run_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "_")


def is_scale_text(text: Column) -> Column:
    """Axis or scale numbers: at least two, in several lines or 35 % of at most 18 tokens."""
    tokens = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    numbers = F.regexp_count(text, F.lit(r"[-+]?\d+(?:\.\d+)?"))
    return (numbers >= 2) & (text.contains("\n") | ((tokens <= 18) & (numbers / F.greatest(tokens, F.lit(1)) >= 0.35)))


def is_full_width(box: Box, page_w: float, page_h: float) -> Column:
    """A low line over most of the page's width, with small margins."""
    x0, _, x1, _ = sides(box)
    w, h = max(page_w, 1.0), max(page_h, 1.0)
    return (zero(width(box)) / w >= FULL_WIDTH) & (x0 / w <= FULL_MARGIN) & (zero(w - x1) / w <= FULL_MARGIN) & (zero(height(box)) / h <= FULL_HEIGHT)


def normal(text: Column) -> Column:
    """Text with single blanks between its words."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_lines(text: Column) -> Column:
    """Lines that aren't blank, without white space at their ends."""
    return F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def numbers_in(words: Column) -> Column:
    """How many tokens begin with a digit."""
    return F.size(F.filter(words, lambda x: x.rlike("^[0-9]")))


def is_unit_label(text: Column) -> Column:
    """A short text with a unit: in brackets, a per cent, a slash before a letter."""
    n = normal(text)
    return (F.length(n) <= 90) & (F.regexp_count(n, F.lit(TOKEN)) <= 14) & n.rlike(UNIT)


def is_structured_label(text: Column) -> Column:
    """A label in a few short lines, numbered, with units or symbols."""
    n = normal(text)

    def of(lines: Column, words: Column) -> Column:
        some = (F.size(words) > 0) & (F.size(words) <= 24)
        short = F.size(lines).between(2, 6) & ~F.exists(lines, lambda x: F.length(x) > 54)
        marked = (F.size(lines) >= 3) | (numbers_in(words) >= 1) | n.rlike("[+−=:/]|[•·]")
        numbered = text.rlike(r"(?:^|\n)\s*[A-Za-z]?\d+\s*[-:.)]?")
        return some & F.when(numbered, F.size(words) <= 20).when(is_unit_label(text), True).otherwise(short & marked)

    return let(text_lines(text), lambda lines: let(tokens(n), lambda words: of(lines, words)))


def scope_text_score(text: Column, high: Column, distance: Column, page_h: float) -> Column:
    """How much a text ``distance`` points over a caption looks like a label of its figure: near, short, numbered or structured, less what makes it body text."""
    n = normal(text)
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))

    def of(words: Column, lines: Column, built: Column) -> Column:
        good = SCOPE["distance"] / (1 + distance / max(page_h * 0.035, 1.0)) + one(n.rlike(r"\d|[+−=:/]|[•·]")) * SCOPE["symbol"] + one((words <= 8) & (lines <= 2)) * SCOPE["compact"] + one(built) * SCOPE["structured"]
        body = zero((words - 18) / 18.0) + zero((lines - F.when(built, 6).otherwise(3)) * 0.7) + zero((high - F.when(built, 52.0).otherwise(32.0)) / 32.0)
        return F.when(n == "", F.lit(-1.0)).when((F.length(n) >= 4) & starts_like_caption(n), F.lit(-0.8)).otherwise(good - body)

    return let(F.struct(F.size(tokens(n)).alias("w"), F.greatest(F.lit(1), F.size(text_lines(text))).alias("l"), is_structured_label(text).alias("b")), lambda x: of(x["w"], x["l"], x["b"]))
