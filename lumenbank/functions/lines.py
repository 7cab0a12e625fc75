"""Parsers of line-based texts: lines are cut into segments where a segment begins or ends, and segments become records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: list markers, findings of a report, and how a line of a finding is indented.
BULLET = r"^\s*(?:[-*•–]|\d+[.)])\s+"
FINDING = r"^\s*(FAIL|soft|note)\s+(\S+)\s+\["
INDENT = r"^ {10,}\S"
QUESTION = r"^\s*(?:Q|Question)\s*\d*\s*[:.]\s*"
ANSWER = r"^\s*(?:A|Answer)\s*[:.]\s*"
HEADING = r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*:?\s*$"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def blank(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*$"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def segments(rows: Column, begins: Callable[[Column], Column], ends: Callable[[Column], Column] | None = None) -> Column:
    """Runs of lines that each begin where ``begins`` says and reach to the next one, or to a line that ``ends``, which is left out.

    Lines before the first run, and those between an end and the next
    beginning, belong to none. Every line is looked at once, and cut out once.
    """
    mark = lambda x: F.when(begins(x), 1).when(ends(x), 2).otherwise(0) if ends else F.when(begins(x), 1).otherwise(0)
    marked = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("at"), mark(x).alias("mark"))), lambda m: m["mark"] > 0)
    # Each mark beside the next one; the last one reaches to the end.
    stops = F.concat(F.slice(F.transform(marked, lambda m: m["at"]), 2, F.size(rows) + 1), F.array(F.size(rows)))
    spans = F.filter(F.zip_with(marked, stops, lambda m, stop: F.struct(m["mark"].alias("mark"), m["at"].alias("at"), stop.alias("stop"))), lambda s: (s["mark"] == 1) & s["stop"].isNotNull())
    return F.transform(spans, lambda s: F.slice(rows, s["at"] + 1, s["stop"] - s["at"]))


def joined(rows: Column) -> Column:
    """Lines as one: trimmed, with single spaces, blank ones left out."""
    return F.array_join(F.filter(F.transform(rows, stripped), lambda x: x != ""), " ")


def section(rows: Column, header: str, headers: list[str]) -> Column:
    """The lines under a header, up to the next of ``headers`` or a heading in capitals; empty if the header is absent, the first one if it is there twice."""
    is_header = lambda names: lambda x: F.rlike(x, F.lit(r"(?i)^\s*(?:" + "|".join(names) + r")\s*:?\s*$"))
    mine, other = is_header([header]), is_header(headers)
    found = segments(rows, mine, lambda x: other(x) | F.rlike(x, F.lit(HEADING)))
    return F.coalesce(F.slice(F.get(found, F.lit(0)), 2, F.size(rows)), F.array().cast("array<string>"))


def list_items(rows: Column) -> Column:
    """Items of a list without their markers, each with its continuation lines; lines before the first marker are an item too."""
    full = F.filter(F.transform(rows, stripped), lambda x: x != "")
    bullet = lambda x: F.rlike(x, F.lit(BULLET))
    at = F.array_position(F.transform(full, bullet), F.lit(True))
    lead = F.slice(full, F.lit(1), F.when(at == 0, F.size(full)).otherwise((at - 1).cast("int")))
    runs = segments(full, bullet)
    first = F.transform(runs, lambda r: F.concat(F.array(F.regexp_replace(F.get(r, F.lit(0)), BULLET, "")), F.slice(r, 2, F.size(full) + 1)))
    found = F.concat(F.array(joined(lead)), F.transform(first, joined))
    return F.filter(found, lambda x: x != "")


def findings(rows: Column) -> Column:
    """(id, kind, lines): the FAIL and soft entries of a report with their indented lines; a note and all under it are left out.

    An entry ends at a blank line or the next entry; what stands under no entry belongs to none.
    """
    runs = segments(rows, lambda x: F.rlike(x, F.lit(FINDING)), blank)
    part = lambda r, k: F.regexp_extract(F.get(r, F.lit(0)), FINDING, k)
    made = F.transform(runs, lambda r: F.struct(part(r, 2).alias("id"), part(r, 1).alias("kind"), F.transform(F.filter(F.slice(r, 2, F.size(rows) + 1), lambda x: F.rlike(x, F.lit(INDENT))), stripped).alias("lines")))
    return F.filter(made, lambda f: f["kind"] != "note")


def questions(rows: Column) -> Column:
    """(question, answer): each question with its lines up to the answer, and the answer's up to the next question; null if there is none."""
    runs = segments(rows, lambda x: F.rlike(x, F.lit(QUESTION)))

    def record(run: Column) -> Column:
        at = F.array_position(F.transform(run, lambda x: F.rlike(x, F.lit(ANSWER))), F.lit(True)).cast("int")
        asked = F.when(at == 0, run).otherwise(F.slice(run, F.lit(1), F.greatest(at - 1, F.lit(0))))
        said = F.when(at > 0, F.slice(run, F.greatest(at, F.lit(1)), F.size(run)))
        return F.struct(F.regexp_replace(joined(asked), QUESTION, "").alias("question"), F.regexp_replace(joined(said), ANSWER, "").alias("answer"))

    return F.transform(runs, record)


def report_tail(rows: Column, marker: str) -> Column:
    """(name, value): the ``name: value`` lines after the last line that is the marker, up to the first other line that isn't blank; names in lower case."""
    is_marker = lambda x: F.rlike(x, F.lit(r"(?i)^\s*" + marker + r"\s*:?\s*$"))
    tail = F.slice(F.element_at(F.concat(F.array(F.array().cast("array<string>")), segments(rows, is_marker)), -1), 2, F.size(rows) + 1)
    full = F.filter(tail, lambda x: ~blank(x))
    pair = r"^\s*([A-Za-z][A-Za-z _-]*?)\s*:\s*(.*?)\s*$"
    stop = F.array_position(F.transform(full, lambda x: F.rlike(x, F.lit(pair))), F.lit(False)).cast("int")
    kept = F.when(stop == 0, full).otherwise(F.slice(full, F.lit(1), F.greatest(stop - 1, F.lit(0))))
    return F.transform(kept, lambda x: F.struct(F.lower(F.regexp_extract(x, pair, 1)).alias("name"), F.regexp_extract(x, pair, 2).alias("value")))


def exhibits(rows: Column, title: str, headers: list[str]) -> Column:
    """(section, heading, rows): each exhibit, the header of the section that it stands in (null before the first), and its cells.

    An exhibit's rows follow its title up to a blank line, a header or another
    heading in capitals; a row's cells are what stands between its bars.
    """
    is_title = lambda x: F.rlike(x, F.lit(r"(?i)^\s*" + title))
    is_header = lambda x: F.rlike(x, F.lit(r"(?i)^\s*(?:" + "|".join(headers) + r")\s*:?\s*$"))
    numbered = F.transform(rows, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    heads = F.filter(numbered, lambda n: is_header(n["line"]))
    starts = F.filter(numbered, lambda n: is_title(n["line"]))
    runs = segments(rows, is_title, lambda x: blank(x) | is_header(x) | F.rlike(x, F.lit(HEADING)))

    def made(run: Column, start: Column) -> Column:
        over = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(heads, lambda h: h["at"] < start["at"]), lambda h: F.trim(h["line"]))), -1)
        body = F.filter(F.slice(run, 2, F.size(rows) + 1), lambda x: F.contains(x, F.lit("|")))
        cells = F.transform(body, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"\|"), stripped))
        return F.struct(over.alias("section"), F.trim(start["line"]).alias("heading"), cells.alias("rows"))

    return F.zip_with(runs, starts, made)
