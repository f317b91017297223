"""Queries over documents as extracted pages, outside ``loam.llm``: sections, tables and exam questions of whole texts.

The texts have no such structure of their own, so their lines are rewritten by their number: some as headings, cells, questions or choices.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.catalogue import query, table
from loam.operators import etl

#: Lines of a page.
PAGE_LINES = 30
#: What all lines are made of, in SQL: their words of ASCII letters and digits.
_LINES = """r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, CAST(i // 30 AS INTEGER) AS page, trim(regexp_replace(raw, '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM r)"""


def _pages(spark, sf, rewrite):
    """doc_id, page, text: the documents' lines, each what ``rewrite`` makes of its number and its words."""
    lines = F.transform(F.split("text", "\n"), lambda raw, i: F.trim(rewrite(i, F.trim(F.regexp_replace(raw, "[^A-Za-z0-9]+", " ")))))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE_LINES).cast("int"))
    # Pages are cut before they become rows, or each would carry all lines of its document.
    texts = F.transform(starts, lambda page: F.array_join(F.slice("lines", page * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
    return docs.select("doc_id", F.posexplode(texts).alias("page", "text"))


@query(f"""WITH {_LINES},
t AS (SELECT doc_id, i, page, w, CASE WHEN i % 20 = 0 THEN 0 WHEN i % 20 = 7 THEN 1 WHEN i % 10 = 5 THEN 2 WHEN i % 10 = 8 THEN 3 END AS level FROM l),
s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS section_id FROM t),
g AS (SELECT doc_id, section_id, max(level) AS level, min(page) AS start_page, max(page) AS last_page, max(CASE WHEN level IS NOT NULL THEN i END) AS i,
  coalesce(string_agg(trim('x ' || w), chr(10) ORDER BY i) FILTER (level IS NULL), '') AS body FROM s GROUP BY doc_id, section_id),
p AS (SELECT *, coalesce(lead(start_page) OVER o, last_page) AS end_page,
  max(CASE WHEN level = 0 THEN section_id END) OVER b AS a0, max(CASE WHEN level = 1 THEN section_id END) OVER b AS a1, max(CASE WHEN level = 2 THEN section_id END) OVER b AS a2
  FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY section_id), b AS (PARTITION BY doc_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, section_id, ['chapter', 'section', 'subsection', 'item'][level + 1] AS level, CASE level WHEN 2 THEN CAST(i // 10 % 99 + 1 AS VARCHAR) WHEN 3 THEN '가' ELSE CAST(i // 20 + 1 AS VARCHAR) END AS number,
  md5(body) AS body, start_page, end_page, CASE level WHEN 1 THEN a0 WHEN 2 THEN greatest(a0, a1) WHEN 3 THEN greatest(a0, a1, a2) END AS parent_id FROM p""")
def document_sections(spark, sf):
    """Every document as a tree of chapters, sections, subsections and items."""

    def rewrite(i, w):
        k = i % 20
        chapter, section = (F.concat(F.lit("제 "), (i / 20).cast("int") + 1, F.lit(f" {kind} t "), w) for kind in ("장", "절"))
        item = F.concat((i / 10).cast("int") % 99 + 1, F.lit(". u "), w)
        return F.when(k == 0, chapter).when(k == 7, section).when(i % 10 == 5, item).when(i % 10 == 8, F.concat(F.lit("가. v "), w)).otherwise(F.concat(F.lit("x "), w))

    found = etl.section_tree(etl.sections(_pages(spark, sf, rewrite)))
    return found.select("doc_id", "section_id", "level", "number", F.md5("body").alias("body"), "start_page", "end_page", "parent_id")


@query("""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, list_transform(string_split(regexp_replace(raw, '[^A-Za-z0-9 ,]', '', 'g'), ','), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))) AS cells FROM r),
t AS (SELECT doc_id, i // 4 AS table_index, first(cells ORDER BY i) AS headers, count(*) AS n_rows, list(cells ORDER BY i) AS cells FROM c GROUP BY 1, 2)
SELECT doc_id, CAST(table_index AS INTEGER) AS table_index, array_to_string(headers, '|') AS headers, array_to_string(list_transform(cells[2:], lambda x: array_to_string(x, '|')), ' / ') AS body,
  CAST(n_rows AS INTEGER) AS n_rows, CAST(len(headers) AS INTEGER) AS n_cols, CAST(len(list_filter(cells[2:], lambda x: len(x) <> len(headers))) AS INTEGER) AS ragged FROM t""")
def document_tables(spark, sf):
    """Every four lines of a document as a table, cells parted by commas: cleaned cells, header, and rows of another width."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, "[^A-Za-z0-9 ,]", ""), ","), lambda x: F.concat(F.lit(" \n"), x, F.lit("　 ")))
    lines = F.transform(F.split("text", "\n"), cells)
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int"))
    pages = docs.select("doc_id", F.lit(1).alias("page"), F.transform(starts, lambda k: F.slice("lines", k * 4 + 1, F.lit(4))).alias("tables"))
    found = etl.tables(pages)
    return found.select("doc_id", "table_index", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), " / ").alias("body"), "n_rows", "n_cols", "ragged")


@query(f"""WITH {_LINES},
q AS (SELECT *, i // 6 AS k, i % 6 AS j FROM l),
g AS (SELECT doc_id, k, max(w) FILTER (j = 0) AS stem, max(w) FILTER (j = 1) AS more, max(w) FILTER (j = 2) AS a, max(w) FILTER (j = 3) AS b, max(w) FILTER (j = 4) AS c, max(w) FILTER (j = 5) AS d FROM q GROUP BY doc_id, k)
SELECT doc_id, CAST(k * 6 // 30 AS INTEGER) AS page, CAST(k % 24 + k % 24 // 5 + 1 AS INTEGER) AS question, trim('q ' || stem) || coalesce(' ' || trim('m ' || more), '') AS stem,
  concat_ws('|', '1:' || trim('o ' || a), '2:' || trim('p ' || b) || coalesce(' ' || trim('r ' || c), ''), '3:s', '4:' || trim('t ' || d)) AS choices, k % 24 > 0 AND k % 24 % 5 = 0 AS skipped FROM g
WHERE d IS NOT NULL""")
def document_questions(spark, sf):
    """Every six lines of a document as a question of two lines, choices on lines of their own, one that goes on, and two on one line; every fifth number is skipped."""

    def rewrite(i, w):
        k, j = (i / 6).cast("int") % 24, i % 6
        ask = F.concat(k + (k / 5).cast("int") + 1, F.lit(". q "), w)
        lines = [ask, F.concat(F.lit("m "), w), F.concat(F.lit("① o "), w), F.concat(F.lit("② p "), w), F.concat(F.lit("r "), w), F.concat(F.lit("③ s ④ t "), w)]
        return F.coalesce(*[F.when(j == n, line) for n, line in enumerate(lines)])

    found = etl.exam_questions(_pages(spark, sf, rewrite))
    shown = F.array_join(F.transform("choices", lambda c: F.concat_ws(":", c["number"], c["text"])), "|")
    return found.where(F.size("choices") == 4).select("doc_id", "page", "question", "stem", shown.alias("choices"), "skipped")
