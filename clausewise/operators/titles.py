"""Titles of contracts from their paragraphs, table cells or page lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, let, strip

# The patterns of the reference results.
SPACED = r"(?:договор|д о г о в о р)"
SPACED_WORD = r"[Дд]\s+[Оо]\s+[Гг]\s+[Оо]\s+[Вв]\s+[Оо]\s+[Рр]"
NUMBER = r"(?U)\s*№\s*[\w\s\-/.]+.*$"
NUMBER_MARK, HASH_MARK = r"(?U)\s*№\s*[\w\s\-/.]*", r"(?U)\s*#\s*[\w\s\-/.]*"
PLACE_OR_DATE = r"(?U)^(?:[гГ]\.\s*|[оО][тТ]\b\s*)"
DATE_OR_NUMBER = r"(?iuU)\s+(?:от\s+\d{2}\.\d{2}\.\d{4}|№\s+[\w\s\-/.]+)"

#: Paragraphs and lines are searched as they are, and only those that are found are stripped.
AFTER_BLANKS = r"(?iuU)^\s*" + SPACED
FIRST_WORD = r"(?U)^\s*(\S+)"


def from_heading(paragraphs: Column) -> Column:
    """From the first paragraph that begins with the word for contract, with what follows it; null if there is none."""
    place = F.array_position(F.transform(paragraphs, lambda t: t.rlike(AFTER_BLANKS)), F.lit(True)).cast("int")

    def title(at: Column) -> Column:
        head = strip(F.regexp_replace(F.regexp_replace(strip(F.get(paragraphs, at - 1)), SPACED_WORD, "ДОГОВОР"), "(?s)" + NUMBER, ""))
        with_next = lambda t: F.when((t != "") & ~t.rlike(PLACE_OR_DATE), t)
        return F.when(at > 0, collapse(F.concat_ws(" ", head, let(strip(F.get(paragraphs, at)), with_next))))

    return let(place, title)


def _without_numbers(line: Column, english: bool) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(line, HASH_MARK, "") if english else line, NUMBER_MARK, ""))


def _both(english: Column, russian: Column) -> Column:
    return collapse(F.concat_ws(" ", F.nullif(english, F.lit("")), F.nullif(russian, F.lit(""))))


def from_cells(cells: Column) -> Column:
    """From the first table cell with either word for contract, joined with a neighbour in the other language; null if none."""
    texts = F.transform(cells, strip)
    holds = lambda t: F.lower(t).rlike("contract|договор")
    first = F.get(F.filter(F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: holds(x["t"])), 0)

    def title(ts: Column) -> Column:
        def of(x: Column) -> Column:
            near = F.coalesce(F.get(ts, x["i"] + 1), F.lit(""))
            en, ru = F.lower(x["t"]).contains("contract"), F.lower(x["t"]).contains("договор")
            english = F.when(en, _without_numbers(x["t"], True)).when(F.lower(near).contains("contract"), _without_numbers(near, True)).otherwise("")
            russian = F.when(ru, _without_numbers(x["t"], False)).when(F.lower(near).contains("договор"), _without_numbers(near, False)).otherwise("")
            return F.when(x.isNotNull(), _both(english, russian))

        return let(first, of)

    return let(texts, title)


def from_first_paragraph(paragraphs: Column) -> Column:
    """The first paragraph up to its date or number; those with nothing before it are passed over. Empty if none is left."""

    def title(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(DATE_OR_NUMBER))
        words = F.split(F.lower(collapse(t)), " ")
        stops = F.filter(F.array(F.array_position(words, "№"), F.array_position(words, "от")), lambda k: k > 0)
        kept = F.slice(F.split(collapse(t), " "), F.lit(1), F.coalesce(F.array_min(stops).cast("int") - 1, F.size(words)))
        return F.when(at > 0, strip(F.substring(t, F.lit(1), at - 1))).otherwise(F.array_join(kept, " "))

    numbered = lambda t: F.regexp_instr(t, F.lit(DATE_OR_NUMBER)) > 0
    word = lambda t: F.lower(F.regexp_extract(t, FIRST_WORD, 1))
    named = F.filter(paragraphs, lambda t: let(word(t), lambda w: (w != "") & (~w.isin("№", "от") | numbered(strip(t)))))
    return F.coalesce(let(strip(F.get(named, 0)), title), F.lit(""))


def from_page_lines(lines_: Column) -> Column:
    """From the first line with either word for contract, without numbers; a line with both gives its text twice. Empty if none."""
    named = lambda t: t.contains("contract") | t.contains("договор")
    first = collapse(F.get(F.filter(lines_, lambda t: let(F.lower(t), named)), 0))

    def of(t: Column) -> Column:
        english = F.when(F.lower(t).contains("contract"), _without_numbers(t, True)).otherwise("")
        russian = F.when(F.lower(t).contains("договор"), _without_numbers(t, False)).otherwise("")
        return F.coalesce(F.when((english != "") & (russian != ""), _both(english, russian)).when(english != "", english).otherwise(russian), F.lit(""))

    return let(first, of)


def title(kind: Column, paragraphs: Column, cells: Column, page_lines: Column) -> Column:
    """By the kind of file: docx in three stages, pdf by its lines, an empty title for any other."""
    docx = F.coalesce(from_heading(paragraphs), from_cells(cells), from_first_paragraph(paragraphs))
    return F.when(kind == "docx", docx).when(kind == "pdf", from_page_lines(page_lines)).otherwise("")
