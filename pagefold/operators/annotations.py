"""Which texts annotate a figure: labels of axes, legends and parts, as against body text, tables, formulas and headings.

One pass computes the facts of a text (words, lines, numbers, ideographs) once; the rules are built on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.geometry import Box, cover_of_smaller, height, overlap_x, overlap_y, sides, width, zero
from pagefold.functions.text import TOKEN, UNIT, numbers_in
from pagefold.functions.values import computed

# White space of any script, and the patterns and words that the rules look for.
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{3400}-\x{9fff}]"
FIGURE_CAPTION = r"(?i)^\s*(?:fig(?:ure)?\.?|图|圖)\s*[\divxlcdm]+[.:：、]?"
TABLE_CAPTION = r"(?i)^\s*(?:table|tab\.|表)\s*[\divxlcdm]+(?:[.:：、]|END)"
TABLE_WORDS = ("Dataset", "Example File", "Task", "Reference", "Question Statement", "Model", "Format", "User", "Ground Truth", "GPT", "GPT-4", "GPT4", "GPT-4V", "GPT4V", "LLaVA", "ViP", "InstructBLIP", "Qwen", "Kosmos", "Shikra")
STATEMENT = "Statement:"
SYSTEM_NAMES = ("GPT-4V", "GPT4V", "LLaVA", "ViP", "InstructBLIP", "Qwen", "Kosmos", "Shikra", "InternLM", "GeminiProVision", "DeepSeek", "Claude")
PAGE_NUMBER = r"^\d{1,4}\s*/\s*\d{1,4}$"
GREEK = r"(?iu)[αβγδεθκλμρσφψωξ]"
FORM_LABEL = "(?:名称|编号|日期|单位|行业|专业|来源|类别|期限|关键词|主题词|项目|姓名|奖项|密级|备注|是否公布)$"
FORM_WORDS = "(?:项目|课题|计划|基金|工程|单位|日期|编号|类别|来源|行业|专业|期限|关键词)"
NUMBERED_CJK = r"^[（(]?\d{1,3}[）).、]\s*[\x{3400}-\x{9fff}“\"《]"
LISTED_CJK = r"^[一二三四五六七八九十百]+[、.．]\s*[\x{3400}-\x{9fff}]"
CJK_STOPS = "[，。；：:“”《》（）]"
DIAGRAM_LABEL = "(?:拱顶|拱腰|墙角|台阶|测线|掌子面|界面|透镜|空洞|断面|^[左右上下前后内外中](?:拱|墙|角|腰|顶|底|线|侧|端|部|面|层|段))"
ELLIPSIS = r"^(?:\.{2,}|…)(?:\s+(?:\.{2,}|…))*$"
LETTER, NUMBER = r"^\(?[a-zA-Z]\)?$", r"^\d+(?:\.\d+)?$"
AUTHOR_HEADER = r"^[A-Z]\.\s+[A-Z][A-Za-z-]+ et al\.?$"
JOURNAL_HEADER = ("JOURNAL", "PROCEEDINGS", "TRANSACTIONS")
EQUATION_END, EQUATION_SIGN = r"\(\d{1,3}\)\s*$", r"[=+−×/{}|]"
MATH = r"(?iu)[=≜∈∑∏√≤≥≈∞{}\[\]^]|(?:\.\s*){2,}|[θκπλμξ]"
SECTION = r"^(?:[A-Z]\.\d+|\d+(?:\.\d+)+)\.?\s+[A-Z]|^[A-Z]\.\s+[A-Z][A-Za-z -]{3,}"
HEADING = r"^\s*(?:[A-Z]\.|[IVXLCDM]+\.)\s+[A-Z][A-Za-z -]{3,}"
ENUMERATED = r"^[A-Za-z]?\d+\s*[-:.)]?"
# How well a text annotates, by the first rule that fits.
SUPPORTS = {"heading": 0.12, "axis": 0.95, "legend": 0.75, "numbers": 0.9, "number": 0.85, "letter": 0.75, "two": 0.6, "six": 0.35, "eight": 0.18}
# Gaps and shares of a text near its content.
NEAR_LEAST, NEAR_MOST, NEAR_SHARE, NEAR_OVERLAP = 16.0, 36.0, 0.16, 0.35
_WORD = r"[\p{L}\p{N}_]"


def _alone(words: tuple[str, ...], start: str) -> str:
    """A pattern of whole words."""
    return rf"(?i){start}(?:{'|'.join(words)})(?!{_WORD})"


def facts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the facts of a text, each computed once: ``_n`` (single blanks), ``_joined`` (lines joined), ``_lines``, ``_len``, ``_words``, ``_nums``, ``_cjk``, ``_compact``. A null text is an empty one."""
    raw = F.coalesce(F.col(text), F.lit(""))
    ends = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    lines = F.filter(F.transform(F.split(raw, r"[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), ends), lambda x: x != "")
    df = computed(df, _n=ends(F.regexp_replace(raw, f"{SPACE}+", " ")), _lines=lines)
    df = computed(df, _joined=F.array_join("_lines", " "), _tokens=F.regexp_extract_all("_n", F.lit(TOKEN), F.lit(0)), _compact=F.regexp_replace("_n", f"{SPACE}+", ""))
    return computed(df, _len=F.length("_n"), _words=F.size("_tokens"), _nums=numbers_in(F.col("_tokens")), _cjk=F.regexp_count("_n", F.lit(CJK)), _rows=F.size("_lines"), _widest=F.coalesce(F.array_max(F.transform("_lines", F.length)), F.lit(0))).drop("_tokens")


def _is(pattern: str, column: str = "_n") -> Column:
    return F.col(column).rlike(pattern)


def _axis_variable() -> Column:
    letters = F.regexp_count("_n", F.lit(rf"(?<!{_WORD})[xyz](?:[A-Z]{{1,3}})?(?!{_WORD})"))
    return (F.col("_len") <= 48) & (_is(GREEK) | (letters >= 2))


def _legend() -> Column:
    return F.col("_rows").between(3, 8) & (F.col("_widest") <= 42) & F.col("_words").between(3, 24) & (F.col("_nums") / F.col("_words") <= 0.4)


def _unit() -> Column:
    return (F.col("_len") <= 90) & (F.col("_words") <= 14) & _is(UNIT)


def _table_start() -> Column:
    return _is(_alone(TABLE_WORDS, "^")) | _is(rf"(?i)^{STATEMENT}(?={_WORD})")


def _share() -> Column:
    return F.when(F.col("_words") > 0, F.col("_nums") / F.col("_words")).otherwise(F.lit(0.0))


def _axis(flat: bool = False) -> Column:
    """Axis or legend: variables, lists, scales, units, short lines; ``flat`` takes the text as one line."""
    words, nums, rows = F.col("_words"), F.col("_nums"), F.lit(1) if flat else F.col("_rows")
    scale = ((nums >= 2) & (words <= 18) & (_share() >= 0.35)) | ((rows >= 2) & (words <= 16) & (nums >= 2))
    short = rows.between(2, 6) & (words <= 18) & (F.col("_widest") <= 48)
    fits = _axis_variable() | (F.lit(False) if flat else _legend()) | ((words > 0) & (scale | _unit() | short))
    return (F.col("_n") != "") & (F.col("_len") <= 180) & ~_is(PAGE_NUMBER) & ~_table_start() & fits


def _form_label() -> Column:
    return F.col("_cjk").between(2, 14) & _is(FORM_LABEL, "_compact")


def _cjk_table() -> Column:
    listed = (_is(NUMBERED_CJK) & (F.col("_cjk") >= 10)) | (_is(LISTED_CJK) & (F.col("_cjk") >= 8))
    named = _is(FORM_WORDS, "_compact") & (F.col("_cjk") >= 4) & _is(r"[:：]|^[（(]?\d")
    return (F.col("_cjk") > 0) & (_form_label() | listed | named)


def _cjk_body(rows: Column) -> Column:
    stops = (F.col("_cjk") >= 18) & _is(CJK_STOPS, "_compact")
    return (F.col("_cjk") > 0) & (_form_label() | _cjk_table() | stops | ((F.col("_cjk") >= 24) & (rows <= 2)))


def annotation_rules(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what each text is: ``axis`` (axis or legend), ``table_cell``, ``excluded`` (captions, headings, formulas, tables, body text), ``cjk_body``, ``label`` (short enough to annotate), ``annotates`` (a label and not excluded) and ``support`` (0 to 0.95, how well it annotates)."""
    kept = df.columns
    df = computed(facts(df, text), axis=_axis(), _cell=_table_start() | _cjk_table() | _is(_alone(SYSTEM_NAMES, f"(?<!{_WORD})")) | ((F.col("_words") >= 6) & (_share() >= 0.3)))
    words, axis = F.col("_words"), F.col("axis")
    caption = _is(FIGURE_CAPTION) | _is(TABLE_CAPTION.replace("END", rf"(?!{_WORD})"))
    math = ~_axis(flat=True) & _is(MATH, "_joined") & ((words >= 6) | (F.length("_joined") >= 42))
    equation = _is(EQUATION_END, "_joined") & _is(EQUATION_SIGN, "_joined")
    df = computed(df, table_cell=(F.col("_n") != "") & ~axis & F.col("_cell"), _caption=caption, _math=math, _section=_is(SECTION), cjk_body=_cjk_body(F.col("_rows")))
    never = F.col("_caption") | _is(PAGE_NUMBER) | _is(AUTHOR_HEADER) | equation | F.col("_math") | F.col("_section")
    rather = _cjk_body(F.lit(1)) | _is(HEADING) | F.col("table_cell") | (words >= 8)
    short_cjk = _is(r"^[\x{3400}-\x{9fff}]{2,8}$", "_compact") & _is(DIAGRAM_LABEL, "_compact")
    label = ((F.col("_len") <= 36) & _is(ELLIPSIS)) | axis | _is(LETTER) | _is(NUMBER) | _axis_variable() | short_cjk | ((F.col("_len") <= 90) & words.between(1, 6))
    df = computed(df, excluded=never | (~axis & rather), label=(F.col("_n") != "") & label)
    annotates = F.col("label") & ~F.col("excluded") & ~F.col("cjk_body")
    return computed(df, annotates=annotates, support=_support()).select(*kept, "axis", "table_cell", "excluded", "cjk_body", "label", "annotates", "support")


def _support() -> Column:
    words, nums, rows = F.col("_words"), F.col("_nums"), F.col("_rows")
    scale = (words.between(1, 24)) & (nums >= 2) & (words <= 18) & ((rows >= 2) | (_share() >= 0.35))
    block = rows.between(2, 6) & (F.col("_widest") <= 48) & words.between(3, 18) & (F.exists("_lines", lambda x: x.rlike(ENUMERATED)) | (nums >= 1))
    axis = _axis_variable() | scale | _unit() | block
    header = _is(rf"(?i)(?<!{_WORD})(?:{'|'.join(JOURNAL_HEADER)})(?!{_WORD})|(?<!{_WORD})VOL\.(?={_WORD})")
    # a line break parts words, so a text in one line is judged for formulas on its own
    flat = _axis_variable() | (words.between(1, 18) & (nums >= 2) & (_share() >= 0.35)) | _unit()
    math = ~flat & _is(MATH, "_joined") & ((words >= 6) | (F.length("_joined") >= 42))
    s = SUPPORTS
    return (
        F.when((F.col("_n") == "") | F.col("_caption"), 0.0)
        .when(F.col("_section"), s["heading"])
        .when(header | math, 0.0)
        .when(axis, s["axis"])
        .when(_legend(), s["legend"])
        .when((rows >= 2) & (words <= 18) & (nums >= 2), s["numbers"])
        .when(_is(NUMBER), s["number"])
        .when(_is(LETTER), s["letter"])
        .when(words <= 2, s["two"])
        .when(words <= 6, s["six"])
        .when(words <= 8, s["eight"])
        .otherwise(F.lit(0.0))
    )


def is_near(content: Box, text: Box) -> Column:
    """A text that meets a content box or runs along one of its sides within a gap that follows its size."""
    (cx0, cy0, cx1, cy1), (tx0, ty0, tx1, ty1) = sides(content), sides(text)
    one = lambda c: F.greatest(F.lit(1.0), c)
    most = F.greatest(F.lit(NEAR_LEAST), F.least(F.lit(NEAR_MOST), F.least(one(width(content)), one(height(content))) * NEAR_SHARE))
    along = lambda o, s: zero(o(content, text)) / F.least(one(s(content)), one(s(text))) >= NEAR_OVERLAP
    above_or_below = along(overlap_x, width) & (((cy0 - ty1) >= 0) & ((cy0 - ty1) <= most) | ((ty0 - cy1) >= 0) & ((ty0 - cy1) <= most))
    beside = along(overlap_y, height) & (((cx0 - tx1) >= 0) & ((cx0 - tx1) <= most) | ((tx0 - cx1) >= 0) & ((tx0 - cx1) <= most))
    return (cover_of_smaller(content, text) > 0) | above_or_below | beside
