"""From extracted pages to sections, tables and exam questions.

``pages``: doc_id, page, text, tables (array<array<array<string>>>). All order-dependent steps stay within one
document, so documents are what is dealt out to tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import clean_cell, shorten, trim

# Headings by level, running headers, and the footers of exam sheets.
HEADINGS = (("chapter", r"^제\s*(\d+)\s*장\s+(.+)"), ("section", r"^제\s*(\d+)\s*절\s+(.+)"), ("subsection", r"^(\d{1,2})\.\s+(.+)"), ("item", r"^([가나다라마바사아자차카타파하])\.\s+(.+)"))
NOISE = r"^농작물재해보험\s*(및|&)\s*가축재해보험\s*손해평가의\s*이론과\s*실무|^[12]권\.|^-\s*\d권\s*$"
FOOTER = r"^\s*\d{4}년[도]?\s*제?\d{1,2}회\s*손해평가사|^\s*\(\s*\d+\s*-\s*\d+\s*\)\s*$"
SUBJECTS = ((r"(?i)상법\s*[(（]?\s*보험편\s*[)）]?", "상법보험편"), (r"｢상법｣\s*보험편", "상법보험편"), (r"농어업재해보험법령", "농어업재해보험법령"), (r"농작물재해보험\s*(및|&)\s*가축재해보험", "농어업재해보험법령"), (r"농학\s*개론", "농학개론"))
EXAM_FILE = r"(\d{4})년[도]?\s*제?(\d{1,2})회"
QUESTIONS_PER_SUBJECT, LEAST_CHOICES = 25, 4


def page_lines(pages: DataFrame, noise: str | None = NOISE) -> DataFrame:
    """doc_id, page, line, text: trimmed lines that are not blank and don't match ``noise``."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = rows.select("doc_id", "page", "line", trim(F.col("raw")).alias("text")).where("text != ''")
    return rows if noise is None else rows.where(~F.col("text").rlike(noise))


def document_text(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """doc_id, text: the pages' texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), separator).alias("text"))


def page_range(pages: DataFrame, spec: str | None) -> DataFrame:
    """Pages of ``a`` or ``a-b``, both included; all for None."""
    if spec is None:
        return pages
    if not (m := re.fullmatch(r"(\d+)(?:-(\d+))?", spec)):
        raise ValueError(f"not a page range: {spec}")
    return pages.where(F.col("page").between(int(m[1]), int(m[2] or m[1])))


def heading_level(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(i)) for i, (_, p) in enumerate(HEADINGS)])


def sections(pages: DataFrame) -> DataFrame:
    """doc_id, section_id, level, heading, number, body, start_page, end_page.

    A heading opens a section that holds the lines up to the next one; lines before the first are
    dropped. A section ends on the page where the next begins, the last on the document's last page with text.
    """
    lines = page_lines(pages).withColumn("level", heading_level(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    lines = lines.withColumn("section_id", F.count("level").over(order)).where("section_id > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("page", "line", "text")))), lambda x: x["text"])
    head = lambda c: F.max(F.when(F.col("level").isNotNull(), F.col(c))).alias(c)
    out = lines.groupBy("doc_id", "section_id").agg(head("level"), head("text"), F.array_join(body, "\n").alias("body"), F.min("page").alias("start_page"), F.max("page").alias("last_page"))
    by_doc = Window.partitionBy("doc_id").orderBy("section_id")
    number = F.coalesce(*[F.when(F.col("level") == i, F.regexp_extract("text", p, 1)) for i, (_, p) in enumerate(HEADINGS)])
    names = F.array(*[F.lit(n) for n, _ in HEADINGS])
    end = F.coalesce(F.lead("start_page").over(by_doc), F.col("last_page"))
    return out.select("doc_id", "section_id", F.get(names, F.col("level")).alias("level"), F.col("text").alias("heading"), number.alias("number"), "body", "start_page", end.alias("end_page"))


def section_tree(flat: DataFrame) -> DataFrame:
    """``flat`` with parent_id: the nearest section before whose level is higher; null at the top."""
    level = F.array_position(F.array(*[F.lit(n) for n, _ in HEADINGS]), F.col("level"))
    before = Window.partitionBy("doc_id").orderBy("section_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = flat.withColumn("_depth", level)
    rows = rows.withColumns({f"_last{k}": F.max(F.when(F.col("_depth") == k, F.col("section_id"))).over(before) for k in range(1, len(HEADINGS))})
    candidates = [F.when(F.col("_depth") > k, F.col(f"_last{k}")) for k in range(1, len(HEADINGS))]
    return rows.withColumn("parent_id", F.greatest(*candidates)).select(*flat.columns, "parent_id")


def tables(pages: DataFrame) -> DataFrame:
    """doc_id, page, table_index, headers, rows, n_rows, n_cols, ragged: cells cleaned, first row as header.

    n_rows counts the header; ragged counts rows of another width. Tables without a row, or with a header
    without cells, are dropped.
    """
    # The outer form, since for the other Spark infers a filter on its input and computes all of that once more, for each table.
    flat = pages.select("doc_id", "page", F.posexplode_outer("tables").alias("table_index", "t")).where("size(t) > 0 AND size(t[0]) > 0")
    cleaned = F.transform("t", lambda r: F.transform(r, clean_cell))
    flat = flat.withColumn("t", cleaned).withColumns({"headers": F.get("t", 0), "rows": F.slice("t", 2, 1_000_000_000)})
    ragged = F.size(F.filter("rows", lambda r: F.size(r) != F.size("headers")))
    return flat.select("doc_id", "page", "table_index", "headers", "rows", F.size("t").alias("n_rows"), F.size("headers").alias("n_cols"), ragged.alias("ragged"))


def prompt(flat: DataFrame, body_limit: int = 3000) -> DataFrame:
    """doc_id, prompt: the sections' headings, pages and shortened bodies, one after another."""
    part = F.concat_ws("\n", F.format_string("[%s] %s (p.%d-%d)", "level", "heading", "start_page", "end_page"), shorten(F.col("body"), body_limit))
    return flat.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("prompt"))


def exam_metadata(filename: Column) -> Column:
    """Struct of year, round (0 if the name has none), exam_type and recognised."""
    year, number = (F.coalesce(F.regexp_extract(filename, EXAM_FILE, k).try_cast("int"), F.lit(0)) for k in (1, 2))
    kind = F.when(F.instr(filename, "2차") > 0, "2nd").otherwise("1st")
    return F.struct(year.alias("year"), number.alias("round"), kind.alias("exam_type"), filename.rlike(EXAM_FILE).alias("recognised"))


def subject_of(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), F.lit(s)) for p, s in SUBJECTS])


CIRCLES = "①②③④⑤"
QUESTION = "doc_id long, subject string, question int, stem string, choices array<struct<number:int,text:string>>, page int, skipped boolean, answer int"


def exam_questions(pages: DataFrame) -> DataFrame:
    """The multiple-choice questions of each document, in QUESTION's columns.

    Which line starts a question depends on the number accepted last, so the lines of a document, already
    classified by Spark, are folded in order, one document at a time. A number may skip ahead by up to two (skipped); any
    other number is text of the question before. A line of several choices is split; text after such a line
    adds a choice with the last number.
    """
    lines = page_lines(pages, FOOTER)
    asks = F.regexp_extract("text", r"^\s*(\d{1,2})\.\s+(.+)", 1).try_cast("int")
    circle = f"[{CIRCLES}]"
    parts = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(f"({circle})\\s*([^{CIRCLES}]+)"), F.lit(1)).alias("mark"),
        F.regexp_extract_all("text", F.lit(f"({circle})\\s*([^{CIRCLES}]+)"), F.lit(2)).alias("said"),
    )
    chosen = F.when(F.col("text").rlike(f"^\\s*{circle}\\s*.+"), F.transform(parts, lambda p: F.struct(F.instr(F.lit(CIRCLES), p["mark"]).alias("number"), trim(p["said"]).alias("text"))))
    lines = lines.select(
        "doc_id", "page", "line", "text", asks.alias("number"), F.regexp_extract("text", r"^\s*\d{1,2}\.\s+(.+)", 1).alias("stem"), chosen.alias("choices"),
        F.when(asks.isNull() & chosen.isNull(), subject_of(F.col("text"))).alias("subject"),
    )
    # Null doc_ids are one document, as in a grouping; a task folds its documents one after another, in one call.
    return lines.repartition("doc_id").sortWithinPartitions("doc_id", "page", "line").mapInPandas(_fold, QUESTION)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The questions of the documents in sorted lines; only what belongs to the last document waits for the next batch."""
    columns = [c.split()[0] for c in QUESTION.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "answer": "Int32"})
    own, out = None, []
    subject, last, open_choice = "", 0, None
    for rows in batches:
        done: list[dict] = []
        ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        for doc, page, text, number, stem, choices, said in zip(ids, *(rows[c].tolist() for c in ("page", "text", "number", "stem", "choices", "subject")), strict=True):
            if own is None or doc != own[0]:
                done += out
                own, out = (doc,), []
                subject, last, open_choice = "", 0, None
            now = out[-1] if out else None
            if isinstance(said, str):
                subject = said
                continue
            marked = list(choices) if choices is not None else []
            if marked and now:
                now["choices"] += [dict(c) for c in marked]
                single = len(marked) == 1
                open_choice = (now["choices"][-1] if single else None, marked[-1]["number"])
                continue
            n = None if pd.isna(number) else int(number)
            if n is not None and (n in range(last + 1, last + 4) or (n == 1 and last > 1)):
                out.append({"doc_id": doc, "subject": subject, "question": n, "stem": stem, "choices": [], "page": page, "skipped": n > last + 1, "answer": None})
                last, open_choice = n, None
                continue
            if now is None:
                continue
            if open_choice is None:
                now["stem"] += " " + text
            elif open_choice[0] is None:  # behind a line of several choices: one more, with the last number
                now["choices"].append({"number": open_choice[1], "text": text})
                open_choice = (now["choices"][-1], open_choice[1])
            else:
                open_choice[0]["text"] += " " + text
        if done:
            yield frame(done)
    if out:
        yield frame(out)


def question_warnings(questions: DataFrame) -> DataFrame:
    """doc_id, kind, subject, question, n: few choices, skipped numbers, and subjects without 25 questions."""
    few = questions.where(F.size("choices") < LEAST_CHOICES).select("doc_id", F.lit("FEW_CHOICES").alias("kind"), "subject", "question", F.size("choices").cast("long").alias("n"))
    skipped = questions.where("skipped").select("doc_id", F.lit("SKIPPED_NUMBER").alias("kind"), "subject", "question", F.lit(1).cast("long").alias("n"))
    counts = questions.groupBy("doc_id", "subject").agg(F.count("*").alias("n")).where(F.col("n") != QUESTIONS_PER_SUBJECT)
    return few.union(skipped).union(counts.select("doc_id", F.lit("SUBJECT_COUNT").alias("kind"), "subject", F.lit(None).cast("int").alias("question"), "n"))


def apply_answers(questions: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("subject", "question"), answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Questions with their answers filled in, and what has no partner: key columns and kind UNANSWERED or SURPLUS."""
    own, given = questions.drop(answer).withColumn("_own", F.lit(True)), answers.select(*keys, answer).withColumn("_given", F.lit(True))
    both = own.join(given, list(keys), "full_outer")
    filled = both.where("_own").select(*[c for c in questions.columns if c != answer], answer)
    kind = F.when(F.col("_given").isNull(), "UNANSWERED").otherwise("SURPLUS")
    return filled, both.where("_own IS NULL OR _given IS NULL").select(*keys, kind.alias("kind"))


def read_pages(spark, path: str) -> DataFrame:
    """Pages as an extractor writes them, JSON lines of doc_id, page, text, tables; null cells and texts become empty."""
    raw = spark.read.schema("doc_id long, page int, text string, tables array<array<array<string>>>").json(path)
    cells = F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: F.transform(t, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))))
    return raw.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), cells.alias("tables"))
