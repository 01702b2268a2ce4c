"""Column expressions for text: white space, tables in text, titles, tokens, dates and languages.

Java's `\\s` knows ASCII only and Spark's trim only the blank, so white space is spelled out once, here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: all Unicode white space, as a character class and as characters
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
INK = WS.replace("[", "[^", 1)  # any character but white space
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: fixed values: what stands for an unknown date, and what a title reading says where there is none
UNKNOWN_DATE = "미상"
NO_TITLE = "없음"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def normalize_ws(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends. Visible ASCII and single blanks are told apart first."""
    return F.btrim(F.regexp_replace(c, rf"(?![\x21-\x7e]| [\x21-\x7e]| {INK}){WS}++", " "))


def squash(c: Column) -> Column:
    """Without any white space, for containment tests."""
    return F.regexp_replace(c, WS, "")


def has_line(text: Column, chars: int) -> Column:
    """Whether a line that is not blank has so many characters."""
    return text.rlike(rf"(?:\A|\n)(?=[^\n]{{{chars}}})(?:(?!\n){WS})*+{INK}")


def needs_reread(text: Column, tables: Column | None = None, low_text: int = 200, max_line: int = 20, tab_rows: int = 4, tab_cols: int = 3) -> Column:
    """Whether extracted page text is too poor: too little, only short lines, or a table. Null text is empty; null
    tables are none."""
    body = strip(F.coalesce(text, F.lit("")))
    poor = (F.length(body) < low_text) | ~has_line(body, max_line)
    if tables is None:
        return poor
    return poor | F.coalesce(F.exists(tables, lambda t: (t["rows"] >= tab_rows) & (t["cols"] >= tab_cols)), F.lit(False))


def table_shapes(text: Column) -> Column:
    """array<struct<rows, cols>> of the pipe tables in text: runs of lines with a pipe, and their widest line."""
    cells = lambda x: F.size(F.split(F.btrim(x, F.lit(" |")), r"\|"))
    shape = "array<struct<rows:int,cols:int>>"
    start = F.struct(F.array().cast(shape).alias("out"), F.lit(0).alias("rows"), F.lit(0).alias("cols"))
    closed = lambda a: F.when(a["rows"] > 0, F.concat(a["out"], F.array(F.struct(a["rows"].alias("rows"), a["cols"].alias("cols"))))).otherwise(a["out"])

    def step(a: Column, line: Column) -> Column:
        piped = F.contains(line, F.lit("|"))
        return F.struct(
            F.when(piped, a["out"]).otherwise(closed(a)).alias("out"),
            F.when(piped, a["rows"] + 1).otherwise(0).alias("rows"),
            F.when(piped, F.greatest(a["cols"], cells(line))).otherwise(0).alias("cols"),
        )

    return F.when(F.contains(text, F.lit("|")), F.aggregate(F.split(text, "\n"), start, step, closed)).otherwise(F.array().cast(shape))


def is_degenerate(text: Column, max_chars: int = 6000, max_line_len: int = 1500, unique_ratio: float = 0.5, short: int = 10) -> Column:
    """Whether a page reading ran away: too long, a line too long, or too many equal lines. Lines are taken without white
    space at their ends; those of `short` characters do not count."""
    lines = F.regexp_extract_all(text, F.lit(rf"{INK}[^\n]{{{short - 1},}}{INK}"), F.lit(0))  # from ink to ink, more than `short`
    few = lambda ls: F.size(F.array_distinct(ls)) / F.size(ls) < unique_ratio
    judged = lambda ls: (F.size(ls) > 0) & (F.exists(ls, lambda x: F.length(x) > max_line_len) | few(ls))
    return F.when(F.length(text) > max_chars, True).when(text.isNotNull(), F.transform(F.array(lines), judged)[0])


def clean_title(raw: Column, max_title: int = 80) -> Column:
    """First line without decoration; '' where it says that there is none, or is too long."""
    line = strip(F.btrim(strip(F.split(raw, "\n")[0]), F.lit("#*\"'` ")))
    return F.when((line == "") | F.contains(line, F.lit(NO_TITLE)) | (F.length(line) > max_title), "").otherwise(line)


def first_line(text: Column) -> Column:
    """The first line that is not blank, without decoration; '' where there is none."""
    lines = F.filter(F.split(text, LINE_ENDS), lambda x: strip(x) != "")
    return strip(F.btrim(strip(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), F.lit("#* ")))


#: a token is looked at ahead, then its run of ASCII or one syllable is passed over; the last syllable of a run is no token
_HANGUL = "[가-힣]"
TOKENS = f"(?=([a-z0-9]+|{_HANGUL}{{2}}|(?<!{_HANGUL}){_HANGUL}))(?:[a-z0-9]+|{_HANGUL})"


def tokenize(text: Column) -> Column:
    """ASCII words, and Hangul runs as overlapping pairs, in order and with repeats, in one pass."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(1))


def token_count(text: Column) -> Column:
    """How many tokens tokenize gives, without making them: ASCII words, syllables before another one, and single ones."""
    return F.regexp_count(F.lower(text), F.lit(f"[a-z0-9]++|{_HANGUL}(?={_HANGUL})|(?<!{_HANGUL}){_HANGUL}"))


#: fixed values: how dates are written in names (eight digits, six, six with dots, a year), in texts and in files' metadata
NAME_8 = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
NAME_6 = rf"(?:^|[_\-(]|{WS})(\d{{2}})(\d{{2}})(\d{{2}})(?:$|[_\-).]|{WS})"
NAME_DOTS = r"(?<!\d)(\d{2})\.(\d{2})\.(\d{2})(?!\d)"
NAME_YEAR = rf"(20\d{{2}}){WS}*년"
TEXT_DAY = rf"(20\d{{2}}){WS}*[.\-년]{WS}*(\d{{1,2}}){WS}*[.\-월]{WS}*(\d{{1,2}})"
TEXT_MONTH = rf"(20\d{{2}}){WS}*[.\-년]{WS}*(\d{{1,2}}){WS}*[.월]"
FILE_DAY = r"^D:(\d{4})(\d{2})(\d{2})"


def _in_year(month: Column, day: Column) -> Column:
    return month.cast("int").between(1, 12) & day.cast("int").between(1, 31)


def _groups(c: Column, pattern: str, n: int) -> list[Column]:
    """Groups of the first match; null where there is none."""
    return [F.nullif(F.regexp_extract(c, pattern, k + 1), F.lit("")) for k in range(n)]


def date_from_name(name: Column) -> Column:
    """A date in a document's name, of whatever precision; null where there is none."""
    y8, m8, d8 = _groups(name, NAME_8, 3)
    y6, m6, d6 = _groups(name, NAME_6, 3)
    yd, md, dd = _groups(name, NAME_DOTS, 3)
    (year,) = _groups(name, NAME_YEAR, 1)
    century = F.when(y6.cast("int") < 70, "20").otherwise("19")
    return F.coalesce(
        F.concat(y8, F.lit("-"), m8, F.lit("-"), d8),
        F.when(_in_year(m6, d6), F.concat(century, y6, F.lit("-"), m6, F.lit("-"), d6)),
        F.when(_in_year(md, dd), F.concat(F.lit("20"), yd, F.lit("-"), md, F.lit("-"), dd)),
        year,
    )


def date_from_text(text: Column, head: int = 1200) -> Column:
    """A date printed near the start of the first page."""
    top = F.substring(text, 1, head)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    y, m, d = _groups(top, TEXT_DAY, 3)
    y2, m2 = _groups(top, TEXT_MONTH, 2)
    return F.coalesce(F.concat(y, F.lit("-"), two(m), F.lit("-"), two(d)), F.concat(y2, F.lit("-"), two(m2)))


def date_from_pdf(meta: Column) -> Column:
    """The date in a file's own metadata (a map)."""
    found = []
    for key in ("creationDate", "modDate"):
        y, m, d = _groups(F.try_element_at(meta, F.lit(key)), FILE_DAY, 3)
        found.append(F.concat(y, F.lit("-"), m, F.lit("-"), d))
    return F.coalesce(*found)


def doc_date(name: Column, first_page: Column, meta: Column) -> Column:
    return F.coalesce(date_from_name(name), date_from_text(first_page), date_from_pdf(meta), F.lit(UNKNOWN_DATE))


def language(ko: Column, latin: Column) -> Column:
    """ko, en or mixed from counts of letters."""
    share = F.try_divide(ko, ko + latin)
    return F.when(ko + latin < 50, "mixed").when(share > 0.5, "ko").when(share < 0.12, "en").otherwise("mixed")


def query_lang(question: Column) -> Column:
    return F.when(question.rlike("[가-힣]"), "ko").otherwise("en")


def l2_normalize(v: Column) -> Column:
    """A vector of unit length, in doubles; null for a null vector or one of length zero."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b))
    return F.when(norm > 0, F.transform(F.array(norm), lambda n: F.transform(x, lambda y: y / n))[0])  # the norm once, not for each component
