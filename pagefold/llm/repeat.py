"""Repetition and other ratios of one text, as a table of thresholds compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.values import computed

#: Words in a run that counts as repeated.
RUN = 6

# Common function words of the three languages of the texts.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "was", "for", "with", "on", "that", "by", "at", "from", "as", "it", "der", "die", "das", "und", "oder", "von", "zu", "in", "ist", "sind", "mit", "auf", "den", "im", "ein", "eine", "的", "了", "在", "是", "和", "与", "为", "有", "中", "对")

#: rule, metric, comparison, threshold: what is flagged. The projection is built from this table.
THRESHOLDS = (
    ("repeated_words", "repeated_word_share", ">=", 0.5),
    ("repeated_lines", "repeated_line_share", ">=", 0.5),
    ("repeated_paragraphs", "repeated_paragraph_share", ">=", 0.5),
    ("repeated_sentences", "repeated_sentence_share", ">=", 0.5),
    ("few_words", "n_words", "<", 5),
    ("many_symbols", "symbol_share", ">", 0.4),
    ("no_stop_words", "stop_word_share", "<", 0.02),
    ("short_lines", "mean_line_chars", "<", 4),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters or digits; each Chinese character is a word of its own."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"(\p{IsHan})", " $1 "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _sorted_runs(w: Column, run: int) -> Column:
    """The runs of ``run`` words with their positions, sorted, so that equal runs are neighbours; empty where there are fewer than two.

    n log n in the number of words; runs are compared as text, not by hash.
    """
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - run + 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(w, i, run), " ").alias("g"), i.alias("i")))
    return F.when(F.size(w) > run, F.sort_array(runs)).when(w.isNotNull(), F.array().cast("array<struct<g:string,i:int>>"))


def _repeats(ordered: Column) -> Column:
    """Positions, ascending, of the runs whose left neighbour in ``ordered`` (sorted by run, position) is the same run."""
    again = F.zip_with(ordered, F.slice(F.concat(F.array(F.lit(None).cast("struct<g:string,i:int>")), ordered), F.lit(1), F.size(ordered)), lambda x, y: F.when(x["g"] == y["g"], x["i"]))
    return F.sort_array(F.filter(again, lambda x: x.isNotNull()))


def _covered(at: Column, run: int) -> Column:
    """Words in the union of the runs of ``run`` words that start at ``at``: the gaps between starts, ``run`` at most."""
    following = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
    return F.aggregate(F.zip_with(at, following, lambda x, y: F.when(x.isNull(), 0).otherwise(F.least(F.coalesce(y - x, F.lit(run)), F.lit(run)))), F.lit(0), lambda s, x: s + x)


def _unit_share(units: Column) -> Column:
    """Share of characters in units (lines, sentences) that stood before: total less distinct, by length."""
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return F.try_divide((size(units) - size(F.array_distinct(units))).cast("double"), size(units))


def repetition(df: DataFrame, text: str, run: int = RUN, rules: tuple = THRESHOLDS, only_needed: bool = False) -> DataFrame:
    """``df`` with its metrics (``only_needed``: those that ``rules`` read), and ``flags``: the names of the rules that hold, in their order.

    ``n_words``, ``repeated_words`` (words in runs of ``run`` or more that stood earlier in the same text),
    ``repeated_word_share``, the share of characters in repeated lines, paragraphs and sentences (trimmed, blank ones
    ignored), ``symbol_share`` (characters neither letter, digit nor space), ``stop_word_share``, ``mean_line_chars``.
    All are column expressions of the row; no row is moved and no user function runs. A null text has null metrics
    and no flags; shares of an empty or blank text are 0, its ``symbol_share`` too. Columns of ``df`` with a
    metric's name are replaced; those starting with ``_rep_`` may not occur.
    """
    t = F.col(text)
    tidy = lambda a: F.filter(F.transform(a, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    lines, paragraphs, sentences = tidy(F.split(t, r"\R")), tidy(F.split(t, r"\R\s*\R")), tidy(F.split(t, r"(?<=[.!?])\s+|(?<=[。！？])|\R"))
    units = {"_rep_l": lines, "_rep_p": paragraphs, "_rep_s": sentences}
    if only_needed and not {rule[1] for rule in rules} & {"repeated_line_share", "repeated_paragraph_share", "repeated_sentence_share", "mean_line_chars"}:
        units = {k: F.array().cast("array<string>") for k in units}
    out = computed(df, _rep_w=words(t), **units)
    w, n = F.col("_rep_w"), F.size("_rep_w")
    out = computed(out, _rep_g=_sorted_runs(w, run))
    out = computed(out, _rep_at=_repeats(F.col("_rep_g")))
    out = computed(out, _rep_c=_covered(F.col("_rep_at"), run))
    safe = lambda c: F.when(t.isNotNull(), F.coalesce(c, F.lit(0.0)))
    chars = F.length(t)
    metrics = {
        "n_words": F.when(t.isNotNull(), n),
        "repeated_words": F.col("_rep_c"),
        "repeated_word_share": safe(F.try_divide(F.col("_rep_c").cast("double"), n)),
        "repeated_line_share": safe(_unit_share(F.col("_rep_l"))),
        "repeated_paragraph_share": safe(_unit_share(F.col("_rep_p"))),
        "repeated_sentence_share": safe(_unit_share(F.col("_rep_s"))),
        "symbol_share": safe(F.try_divide(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")).cast("double"), chars)),
        "stop_word_share": safe(F.try_divide(F.size(F.filter(w, lambda x: x.isin(*dict.fromkeys(STOP_WORDS)))).cast("double"), n)),
        "mean_line_chars": safe(F.try_divide(F.aggregate(F.col("_rep_l"), F.lit(0).cast("long"), lambda s, x: s + F.length(x)).cast("double"), F.size(F.col("_rep_l")))),
    }
    if only_needed:
        metrics = {k: v for k, v in metrics.items() if k in {rule[1] for rule in rules}}
    out = out.drop(*metrics, "flags")
    return computed(out, **metrics).select(*[c for c in out.columns if not c.startswith("_rep_")], *metrics, flags(rules).alias("flags"))


def flags(rules: tuple = THRESHOLDS) -> Column:
    """The names of the rules that hold; a null metric holds for none."""
    holds = {">=": lambda c, x: c >= x, ">": lambda c, x: c > x, "<": lambda c, x: c < x, "<=": lambda c, x: c <= x}
    return F.array_compact(F.array(*[F.when(holds[op](F.col(metric), F.lit(limit)), F.lit(rule)) for rule, metric, op, limit in rules]))
