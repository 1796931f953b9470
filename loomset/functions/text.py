"""Text predicates and transformations as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NOT_ALNUM = "[^a-zA-Z0-9 ]+"


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), where value is worked out once, however often fn's lambdas use it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


#: Bytes of text that one task cuts, about.
TASK = 4 << 20


def tasks_for(texts: DataFrame, column: str) -> int:
    """How many tasks cutting texts needs: it takes so long a byte that tasks of the size Spark makes for reading are few."""
    total = texts.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-total // TASK))


def stripped(c: Column) -> Column:
    """Without leading and trailing Unicode white space (SQL trim strips spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column, min_len: int = 1, nan_words: Iterable[str] | None = ("nan",)) -> Column:
    """True for null, for fewer than min_len characters after stripping, and for the nan words in any case."""
    s = stripped(c.cast("string"))
    short = c.isNull() | (F.length(s) < min_len)
    words = [w.lower() for w in nan_words] if nan_words is not None else []
    return short | F.lower(s).isin(words) if words else short


def simple(c: Column, lowercase: bool = True, pattern: str = NOT_ALNUM) -> Column:
    """Runs of other characters become one space; stripped, and in lower case if asked (after the pattern was applied)."""
    out = F.regexp_replace(c, pattern, " ")
    out = F.lower(out) if lowercase else out
    return stripped(F.regexp_replace(out, r"(?U)\s+", " "))


def without_nul(c: Column) -> Column:
    return F.regexp_replace(c, "\\x00", " ")


def replace_nul(df: DataFrame) -> DataFrame:
    """NUL becomes a space in all string columns; other types are left alone."""
    return df.withColumns({f.name: without_nul(F.col(f.name)) for f in df.schema if isinstance(f.dataType, StringType)})


def words_and_connectors(c: Column) -> Column:
    """array<struct<word, conn>>: each white-space token with the white space after it. Text before the first token is lost."""
    whole = F.regexp_extract_all(c, F.lit(r"\S+\s*"), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.regexp_replace(x, r"\s+$", "").alias("word"), F.regexp_extract(x, r"(\s*)$", 1).alias("conn")))


#: Marks that no text is expected to hold: between two tokens that no white space parts, and at a sentence's end.
CUT, END = "\ue000", "\ue001"
#: Where Treebank tokens part, in order: a pattern (of Java and of RE2 alike) and its groups with CUT around the token.
#: Fixed values of the Treebank convention: its marks, clitics and contractions.
TREEBANK = (
    (r'(^|[\s(\[{<])(")', "1|2|"),  # opening quotes
    (r"([^'\s])(' )", "1|2"),
    (r"([:,])([^\d\s])", "|1|2"),
    (r"([:,])(\s|$)", "|1|2"),
    (r"(\.{2,})", "|1|"),
    (r"([;@#$%&?!])", "|1|"),
    (r"([^.\s])(\.)([\])}>\"']*)(\s*)(" + END + "|$)", "1|2|3|4 5"),  # the full stop that ends a sentence
    (r"([\]\[(){}<>])", "|1|"),
    (r"(--)", "|1|"),
    (r"([^\s])('')", "1|2|"),
    (r'([^\s])(")', "1|2|"),
    (r"([^'\s])('[sSmMdD])(\s|$|[" + CUT + END + "])", "1|2|3"),
    (r"([^'\s])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)(\s|$|[" + CUT + END + "])", "1|2|3"),
    (r"(?i)\b(can)(not)\b", "1|2"),
    (r"(?i)\b(d)('ye)\b", "1|2"),
    (r"(?i)\b(gim|lem)(me)\b", "1|2"),
    (r"(?i)\b(gon|wan)(na)\b", "1|2"),
    (r"(?i)\b(got)(ta)\b", "1|2"),
    (r"(?i)\b(more)('n)\b", "1|2"),
    (r"(?i)('t)(is|was)\b", "1|2"),
)
SENTENCE = r"""([.!?]+["')\]]*)(\s)"""
TOKEN = f"([^\\s{CUT}{END}]+)[{CUT}{END}]*(\\s*)"


def replacement(groups: str, sign: str) -> str:
    """'1|2' as a replacement string: CUT for each bar; sign marks a group."""
    return "".join(f"{sign}{g}" if g.isdigit() else CUT if g == "|" else "" for g in groups)


#: What stands for the text after a piece of it, so that no pattern takes the piece's end for the text's.
MORE = "\ue002"
#: Pieces that are one token as they are: letters and digits alone, but for words that hide two; and such ones with one mark.
PLAIN = r"^(?!(?i:cannot|gimme|lemme|gonna|wanna|gotta)\b)[\p{L}\p{N}]+"
ALONE, MARKED = PLAIN + r"\s*$", PLAIN + f"([,;:!?]|[.!?]{END})\\s*$"
WHITE = " \t\n\x0b\x0c\r"


def treebank_cut(c: Column) -> Column:
    """c with CUT around its tokens. c: text with END after its sentences, or a piece of such a text."""
    for pattern, groups in TREEBANK:
        c = F.regexp_replace(c, pattern, replacement(groups, "$"))
    return c


def treebank_tokens(marked: Column) -> Column:
    """array<struct<word, conn>> of a text with END after its sentences, each token with the white space after it.

    Tokens part at white space and by patterns that look no further than the white space after a piece, so each piece is
    cut on its own, and only if it holds more than letters and digits. White space before the first token is lost."""
    token = lambda word, conn: F.struct(word.alias("word"), conn.alias("conn"))
    white = lambda x: F.substring(x, F.length(F.rtrim(x, F.lit(WHITE))) + 1, F.length(x))

    def tokens(piece: Column, last: Column) -> Column:
        cut = treebank_cut(F.when(last, piece).otherwise(F.concat(piece, F.lit(MORE))))
        found = F.regexp_extract_all(F.replace(cut, F.lit(MORE), F.lit("")), F.lit(TOKEN), F.lit(0))
        return F.transform(found, lambda x: token(F.regexp_extract(x, TOKEN, 1), F.regexp_extract(x, TOKEN, 2)))

    def of_piece(piece: Column, last: Column) -> Column:
        word = F.rtrim(piece, F.lit(WHITE + END + ",;:!?."))
        mark = F.substring(piece, F.length(word) + 1, F.lit(1))
        out = F.when(piece.rlike(ALONE), F.array(token(F.rtrim(piece, F.lit(WHITE)), white(piece))))
        return out.when(piece.rlike(MARKED), F.array(token(word, F.lit("")), token(mark, white(piece)))).otherwise(tokens(piece, last))

    whole = F.regexp_extract_all(marked, F.lit(r"\S+\s*"), F.lit(0))
    return F.flatten(bound(whole, lambda w: F.transform(w, lambda x, i: of_piece(x, i == F.size(w) - 1))))


def treebank_words(c: Column) -> Column:
    """array<struct<word, conn>>: words, numbers, punctuation and clitics of each sentence, each with the white space after it.

    Sentences end at closing punctuation before white space; see operators.sentences for those of a model."""
    return treebank_tokens(F.regexp_replace(c, SENTENCE, f"$1{END}$2"))


def sentences_and_connectors(c: Column) -> Column:
    """Sentences by closing punctuation before white space, each with the white space after it."""
    pattern = f"([^\\s{END}][^{END}]*){END}?(\\s*)"
    cut = F.regexp_replace(c, SENTENCE, f"$1{END}$2")
    return F.transform(F.regexp_extract_all(cut, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.regexp_replace(F.replace(x, F.lit(END), F.lit("")), r"\s+$", "").alias("word"), F.regexp_extract(x, r"(\s*)$", 1).alias("conn")))


def rebuilt(pairs: Column) -> Column:
    """The text of (word, conn) pairs."""
    return F.array_join(F.flatten(F.transform(pairs, lambda p: F.array(p["word"], p["conn"]))), "")


def split_uri(c: Column, strict: bool = True) -> Column:
    """struct<user, password, server, port, dbname> of a postgresql+psycopg2 URI; no match raises, or gives null if not strict."""
    pattern = r"^postgresql\+psycopg2://([^:]+):([^@]+)@([^:]+):(\d+)/(.+)"
    parts = F.struct(*(F.regexp_extract(c, pattern, i + 1).alias(n) for i, n in enumerate(("user", "password", "server", "port", "dbname"))))
    return F.when(c.rlike(pattern), parts).otherwise(F.raise_error(F.concat(F.lit("not a database URI: "), c)) if strict else F.lit(None))


def colored_html(color: Column, text: Column) -> Column:
    """A span of one colour. color: array of 1 (grey), 3 or 4 numbers from 0 to 255; newlines become <br />."""
    full = F.when(F.size(color) == 1, F.array_repeat(F.element_at(color, 1), 3)).otherwise(color)
    code = F.array_join(F.transform(full, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")
    return F.concat(F.lit('<span style="color:#'), code, F.lit(';">'), F.replace(text, F.lit("\n"), F.lit("<br />")), F.lit("</span>"))


def colored_html_list(colors: Column, texts: Column, sep: str = "") -> Column:
    return F.array_join(F.zip_with(colors, texts, lambda c, t: colored_html(c, t)), sep)


def table_row(cells: Column, header: bool = False) -> Column:
    tag = "th" if header else "td"
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))


def html_table(df: DataFrame, cells: str, position: str, header_positions: tuple = (0,)) -> DataFrame:
    """One row: the table of all rows in order of position. For bounded tables (a report); `limit` first."""
    row = F.when(F.col(position).isin(list(header_positions)), table_row(F.col(cells), True)).otherwise(table_row(F.col(cells)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), row.alias("h")))), lambda r: r["h"])
    return df.agg(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def image_tag(data: Column) -> Column:
    """An inline image of PNG bytes."""
    return F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(data), F.lit('" />'))


def url_candidates(c: Column) -> Column:
    """URLs to try in order: as it is, or with https:// and http:// in front if it has no scheme."""
    bare = F.regexp_replace(c, "^[/:.]+", "")
    return F.when(c.rlike("^https?://"), F.array(c)).otherwise(F.array(F.concat(F.lit("https://"), bare), F.concat(F.lit("http://"), bare)))


def shard_number(c: Column) -> Column:
    """The number before .tar in a shard's URL; null where there is none."""
    found = F.regexp_extract(c, r".*?([0-9]+)\.tar", 1)
    return F.when(found != "", found.cast("long"))


def dot_values(c: Column) -> Column:
    """A comma-separated option value as an array, a trailing comma dropped."""
    return F.filter(F.split(c, ","), lambda x: x != "")


def parse_dotlist(options: list[str] | None) -> dict:
    """['a.b=1', 'c=x,y'] -> {'a': {'b': 1}, 'c': ['x', 'y']}: a driver's helper for job options."""

    def scalar(v: str):
        if v == "" or v.lower() in ("null", "none", "~"):
            return None
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    out: dict = {}
    for option in options or []:
        path, _, value = option.partition("=")
        *outer, last = path.split(".")
        at = out
        for name in outer:
            at = at.setdefault(name, {})
        items = value.split(",")
        at[last] = [int(x) if x.isdigit() else x for x in items if x] if len(items) > 1 else scalar(value)
    return out
