"""Docket search."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docketscope.operators import search as SE
from docketscope.session import ensure_checkpoint_dir
from workload.catalog import TEXT_SQL, query

for _p in ("", "part_"):
    TEXT_SQL[f"{_p}tokens"] = ([f"{_p}corpus"], f"""
        SELECT docket_id, field, list_filter(regexp_split_to_array(lower(text), '[\\n\\r\\p{{Z}}\\p{{P}}]+'),
                                             lambda w: w <> '') AS toks
        FROM (SELECT docket_id, 'title' AS field, coalesce(title, '') AS text FROM {_p}corpus
              UNION ALL SELECT docket_id, 'abstract', coalesce(abstract, '') FROM {_p}corpus)""")
    TEXT_SQL[f"{_p}words"] = ([f"{_p}tokens"], f"""
        SELECT field, docket_id, term, count(*) AS tf
        FROM (SELECT docket_id, field, unnest(toks) AS term FROM {_p}tokens) GROUP BY 1, 2, 3""")
    TEXT_SQL[f"{_p}postings"] = ([f"{_p}words"], f"""
        SELECT w.field, w.term, w.docket_id, l.length, w.tf
        FROM {_p}words w JOIN (SELECT field, docket_id, count(*) AS length FROM {_p}words GROUP BY 1, 2) l
          ON l.field = w.field AND l.docket_id = w.docket_id""")


def hits_sql(p: str) -> str:
    """CTEs q (given) -> hits(docket_id, score, query_terms, matched)."""
    plain = "regexp_replace(term, '[^\\x00-\\x7f]', '#', 'g')"
    return f"""
    vocab AS (SELECT field, term, count(*) AS df FROM {p}postings GROUP BY 1, 2),
    sizes AS (SELECT field, count(*) AS docs, avg(len(list_distinct(toks))) AS avg_length
              FROM {p}tokens GROUP BY 1),
    dist AS (SELECT field, term, df, q, length(term) AS lt, length(q) AS lq,
                    levenshtein({plain}, q) AS ed, CAST(round(length(q) * 0.2) AS int) AS k
             FROM vocab, q WHERE term LIKE q || '%' OR abs(length(term) - length(q)) <= round(length(q) * 0.2)),
    matched AS (SELECT *, CASE WHEN term = q THEN 1.0
                     WHEN starts_with(term, q) THEN lt * 0.375 / (lt + (lt - lq) * 0.3)
                     WHEN ed <= k THEN lt * 0.45 / (lt + ed) END AS weight FROM dist),
    hits AS (
      SELECT docket_id, round(sum(s) * count(DISTINCT q), 6) AS score, count(DISTINCT q) AS query_terms,
             array_to_string(list_sort(list(DISTINCT term)), ' ') AS matched_terms
      FROM (SELECT p.docket_id, p.term, m.q,
                   ln(1 + (docs - df + 0.5) / (df + 0.5)) * CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END * weight
                   * (0.5 + tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * p.length / avg_length))) AS s
            FROM {p}postings p JOIN matched m USING (field, term) JOIN sizes USING (field)
            WHERE weight IS NOT NULL)
      GROUP BY 1)"""


def words(*terms: str) -> str:
    return "q AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in terms) + "]) AS q)"


_STORED: dict[tuple, str] = {}


def stored_index(t, corpus: str = "corpus") -> SE.SearchIndex:
    """The index of a corpus, built and written once per session, read back for each search."""
    ensure_checkpoint_dir(t.spark)
    key = (t.spark.sparkContext.applicationId, t.spark.sparkContext.getCheckpointDir(), t.sf_dir, corpus)
    if key in _STORED:
        try:
            return SE.SearchIndex.read(t.spark, _STORED[key])
        except AnalysisException:  # the folder has been cleaned: build it again
            pass
    path = f"{t.spark.sparkContext.getCheckpointDir()}/index-{uuid4().hex}"
    SE.search_index_build(t(corpus)).write(path)
    _STORED[key] = path
    return SE.SearchIndex.read(t.spark, path)


def flat(df):
    return df.withColumns({"score": F.round("score", 6), "matched_terms": F.array_join("matched_terms", " ")})


@query("search_index_build", "postings", "SELECT field, term, docket_id, length, tf FROM postings")
def _(t):
    return SE.search_index_build(t("corpus")).postings


_PAGE = "docket_id, agency_code, title, docket_type, modify_date, abstract, round(score, 6) AS score, matched_terms"


@query("docket_search", "corpus postings", f"""
    WITH {words('thatin', 'src1', 'nation')}, {hits_sql('')}
    SELECT {_PAGE} FROM hits JOIN corpus USING (docket_id)
    ORDER BY hits.score DESC, docket_id LIMIT 50""")
def _(t):
    return flat(SE.docket_search(stored_index(t), "Thatin, SRC1 nation", limit=50))


@query("docket_search_recency", "corpus postings", f"""
    WITH {words('orantion')}, {hits_sql('')}
    SELECT {_PAGE} FROM hits JOIN corpus USING (docket_id) WHERE agency_code = 'src3'
    ORDER BY modify_date DESC, hits.score DESC, docket_id LIMIT 20 OFFSET 2""")
def _(t):
    index = stored_index(t)
    return flat(SE.docket_search(index, "orantion", "src3", "recency", offset=2))


@query("docket_search_total", "corpus postings", f"""
    WITH {words('orantion', 'hehely')}, {hits_sql('')}
    SELECT count(*) AS total FROM hits JOIN corpus USING (docket_id) WHERE agency_code = 'src2'""")
def _(t):
    return SE.docket_search_total(stored_index(t), "orantion hehely", "src2")


@query("docket_suggest", "part_corpus part_postings", f"""
    WITH {words('red', 'widg')}, {hits_sql('part_')}
    SELECT matched_terms AS suggestion, round(avg(score), 6) AS score FROM hits WHERE query_terms = 2
    GROUP BY 1 ORDER BY round(avg(score), 6) DESC, suggestion LIMIT 5""")
def _(t):
    rows = SE.docket_suggest(stored_index(t, "part_corpus"), "Red widg")
    return rows.withColumn("score", F.round("score", 6))


@query("related_dockets", "part_corpus part_postings", f"""
    WITH w AS (SELECT w, min(i) AS i FROM (
            SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i
            FROM (SELECT regexp_split_to_array(lower(title), '[^a-z]+') AS ws FROM part_corpus WHERE docket_id = '7'))
          WHERE length(w) >= 4 AND w NOT IN ({', '.join(f"'{s}'" for s in SE.STOP_WORDS)}) GROUP BY 1),
    q AS (SELECT w AS q FROM w ORDER BY length(w) DESC, i LIMIT 5), {hits_sql('part_')}
    SELECT docket_id, agency_code, title, round(score, 6) AS score
    FROM hits JOIN part_corpus USING (docket_id) WHERE docket_id <> '7'
    ORDER BY hits.score DESC, docket_id LIMIT 3""")
def _(t):
    rows = SE.related_dockets(stored_index(t, "part_corpus"), "7")
    return rows.withColumn("score", F.round("score", 6))


@query("related_dockets_all", "part_corpus part_postings part_tokens", f"""
    WITH spread AS (SELECT docket_id, w, min(i) AS i FROM (
            SELECT docket_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
            FROM (SELECT docket_id, regexp_split_to_array(lower(title), '[^a-z]+') AS ws FROM part_corpus))
          WHERE length(w) >= 4 AND w NOT IN ({', '.join(f"'{s}'" for s in SE.STOP_WORDS)}) GROUP BY 1, 2),
    mine AS (SELECT docket_id, w AS q FROM spread
             QUALIFY row_number() OVER (PARTITION BY docket_id ORDER BY length(w) DESC, i) <= 5),
    q AS (SELECT DISTINCT q FROM mine), {hits_sql('part_')},
    parts AS (
      SELECT p.docket_id AS other, m.q,
             sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END * weight
                 * (0.5 + tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * p.length / avg_length)))) AS s
      FROM part_postings p JOIN matched m USING (field, term) JOIN sizes USING (field) WHERE weight IS NOT NULL GROUP BY ALL),
    scored AS (
      SELECT m.docket_id, other, round(sum(s) * count(*), 6) AS score FROM mine m JOIN parts USING (q)
      WHERE other <> m.docket_id GROUP BY m.docket_id, other
      QUALIFY row_number() OVER (PARTITION BY m.docket_id ORDER BY round(sum(s) * count(*), 6) DESC, other) <= 3)
    SELECT s.docket_id, row_number() OVER (PARTITION BY s.docket_id ORDER BY score DESC, other) AS place, other AS related_id,
           agency_code, title, score
    FROM scored s JOIN part_corpus p ON p.docket_id = other""")
def _(t):
    return SE.related_to_all(stored_index(t, "part_corpus"))


@query("search_snippet", "corpus", """
    WITH x AS (SELECT docket_id, abstract AS t, list_min(list_filter(
                 [instr(lower(abstract), 'nation'), instr(lower(abstract), 'ther')], lambda p: p > 0)) - 1 AS f
               FROM corpus),
    y AS (SELECT *, greatest(0, f - 120) AS s FROM x),
    z AS (SELECT *, least(length(t), s + 240) AS e FROM y)
    SELECT docket_id, CASE WHEN length(t) <= 240 THEN t WHEN f IS NULL THEN substr(t, 1, 240) || '…'
        ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substr(t, s + 1, e - s)
             || CASE WHEN e < length(t) THEN '…' ELSE '' END END AS snippet FROM z""")
def _(t):
    terms = F.array(F.lit("Nation"), F.lit("x"), F.lit(" ther "))
    return t("corpus").select("docket_id", SE.search_snippet(F.col("abstract"), terms).alias("snippet"))
