"""SQL fragments that the oracles share (DuckDB)."""

from __future__ import annotations

#: Lines of documents as chunks.
LINES = r"""lines AS (
  SELECT CAST(doc_id AS VARCHAR) || '__s' || CAST((i - 1) // 5 AS VARCHAR) || '__p' || CAST(i - 1 AS VARCHAR) AS chunk_id, doc_id,
         doc_id * 1000000 + (i - 1) AS ordinal, CAST((i - 1) // 5 AS INTEGER) AS sec_idx, 's' || CAST((i - 1) // 5 AS VARCHAR) AS section, parts[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(i)
  WHERE regexp_matches(parts[i], '\S'))"""

#: Documents as chunks, and benchmark items as questions.
DOCS = "chunks AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id AS ordinal, text, source, lang FROM documents)"
ITEMS = "queries AS (SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark)"


def toks(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def bm25(name: str, chunks: str, queries: str, scope: str = "", text: str = "text", distinct: bool = False) -> str:
    """CTEs that end in ``name`` (scope, qid, chunk_id, ordinal, score) over ``chunks`` (chunk_id, ordinal, text) and ``queries`` (qid, text)."""
    sc, on, words = (f"{scope}, ", f" AND a.{scope} = b.{scope}", f"list_distinct({toks(text)})" if distinct else toks(text))
    sc, on = (sc, on) if scope else ("", "")
    by = f"GROUP BY {scope}" if scope else ""
    join = f"USING ({scope})" if scope else "ON true"
    over = f"OVER (PARTITION BY {scope})" if scope else "OVER ()"
    return f"""
{name}_d AS (SELECT {sc}chunk_id, ordinal, {words} AS toks FROM {chunks}),
{name}_n AS (SELECT {sc}count(*) AS n_docs, avg(len(toks)) AS avgdl FROM {name}_d {by}),
{name}_df AS (SELECT {sc}term, count(*) AS df FROM (SELECT {sc}unnest(list_distinct(toks)) AS term FROM {name}_d) GROUP BY {sc}term),
{name}_raw AS (SELECT {sc}term, df, n_docs, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM {name}_df JOIN {name}_n {join}),
{name}_stats AS (SELECT {sc}term, df, n_docs, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) {over} ELSE raw END AS idf FROM {name}_raw),
{name}_q AS (SELECT {sc}qid, term, count(*) AS qtf FROM (SELECT {sc}qid, unnest({toks("text")}) AS term FROM {queries}) GROUP BY {sc}qid, term),
{name}_tf AS (SELECT {sc}chunk_id, ordinal, term, dl, count(*) AS tf FROM (SELECT {sc}chunk_id, ordinal, len(toks) AS dl, unnest(toks) AS term FROM {name}_d) GROUP BY {sc}chunk_id, ordinal, term, dl),
{name} AS (SELECT {"a." + scope + "," if scope else ""} b.qid, a.chunk_id, a.ordinal, sum(b.qtf * s.idf * a.tf * 2.5 / (a.tf + 1.5 * (0.25 + 0.75 * a.dl / s.avgdl))) AS score
  FROM {name}_tf a JOIN {name}_q b ON a.term = b.term{on} JOIN {name}_stats s ON s.term = a.term{" AND s." + scope + " = a." + scope if scope else ""}
  GROUP BY {"a." + scope + "," if scope else ""} b.qid, a.chunk_id, a.ordinal)"""


def completed(name: str, scored: str, chunks: str, queries: str, k: int) -> str:
    """``scored`` with chunks of score 0 for questions that have fewer than k rows above 0."""
    return f"""
{name}_enough AS (SELECT qid FROM {scored} WHERE score > 0 GROUP BY qid HAVING count(*) >= {k}),
{name} AS (SELECT qid, chunk_id, ordinal, score FROM {scored}
  UNION ALL
  SELECT q.qid, c.chunk_id, c.ordinal, 0.0 FROM {queries} q, {chunks} c
  WHERE q.qid NOT IN (SELECT qid FROM {name}_enough) AND NOT EXISTS (SELECT 1 FROM {scored} s WHERE s.qid = q.qid AND s.chunk_id = c.chunk_id))"""


def top(name: str, scored: str, k: int, digits: int = 9) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, {digits}) DESC, ordinal) AS rank FROM {scored}) WHERE rank <= {k})"


def dense(name: str) -> str:
    """Scores of document vectors (vec_id as doc) for items (vec_id as item)."""
    return f"""{name} AS (SELECT CAST(q.item_id AS VARCHAR) AS qid, CAST(v.vec_id AS VARCHAR) AS chunk_id, v.vec_id AS ordinal,
  list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))) AS score
  FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings v)"""


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def rules_case(rules: list[tuple[str, str]], column: str = "question") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{label}'" for label, p in rules) + " ELSE 'factual' END"


def literal(values: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in values) + ")"
