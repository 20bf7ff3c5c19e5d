"""Rulemaking tables derived from the driver's tables.

Each stand-in is one SELECT that Spark and the checking engine both accept;
``{name}`` refers to a driver table or to another stand-in. Rows are whole
tables: nothing is sampled or cut.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from docketscope.session import configure
from docketscope.sources.tables import spread

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables with heavy per-row text work.
TEXT_TABLES = ("documents", "pages")

# Words of a text in reverse order, per engine.
REVERSED_WORDS = {
    "spark": "array_join(reverse(split(text, ' ')), ' ')",
    "duckdb": "array_to_string(list_reverse(string_split(text, ' ')), ' ')",
}

STANDINS = {
    "dockets": """
        SELECT CAST(o_orderkey AS string) AS docket_id, n_name AS agency_code,
               c_mktsegment || ' rule by ' || c_name AS title, o_orderpriority AS abstract,
               CASE o_orderstatus WHEN 'F' THEN 'Rulemaking' WHEN 'O' THEN 'Nonrulemaking'
                    ELSE CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Other' END
               END AS docket_type,
               CAST(CAST(o_orderdate AS date) AS string) AS modify_date,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE CAST(CAST(o_orderdate AS date) - 10 AS string) END AS date_created
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey""",
    "reg_documents": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
                 AS document_id,
               CAST(l_orderkey AS string) AS docket_id, n_name AS agency_code,
               'Part ' || l_partkey || ' from ' || s_name AS title,
               CASE l_returnflag WHEN 'R' THEN 'Proposed Rule' WHEN 'A' THEN 'Rule'
                    ELSE 'Notice' END AS document_type,
               CAST(CAST(l_shipdate AS date) AS string) AS posted_date,
               CAST(CAST(l_shipdate AS date) AS string) AS modify_date,
               CASE l_returnflag WHEN 'R' THEN CAST(CAST(l_shipdate AS date) AS string)
                    WHEN 'N' THEN '' END AS comment_start_date,
               CASE l_returnflag
                    WHEN 'R' THEN CAST(CAST(l_shipdate AS date) + CAST(l_quantity AS int) AS string)
                    WHEN 'N' THEN '' END AS comment_end_date,
               CASE WHEN l_linestatus = 'O'
                    THEN 'https://files.example.org/' || l_partkey || '/d' || l_linenumber
                         || CASE WHEN l_returnflag = 'A' THEN '' ELSE '.pdf' END
               END AS file_url
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
             JOIN {nation} ON s_nationkey = n_nationkey""",
    "federal_register": """
        SELECT 'FR-' || o_orderkey AS document_number,
               c_mktsegment || ' notice ' || o_orderkey AS title,
               '"' || o_orderpriority || ' ' || c_name || '"' AS abstract,
               CASE o_orderstatus WHEN 'F' THEN 'Rule' WHEN 'O' THEN 'Proposed Rule'
                    ELSE 'Presidential Document' END AS document_type,
               CASE WHEN o_orderstatus = 'P' THEN 'Executive Order' ELSE '' END AS subtype,
               CAST(CAST(o_orderdate AS date) AS string) AS publication_date,
               CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS date) + 30 AS string)
                    ELSE '' END AS effective_on,
               CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(o_orderdate AS date) + 60 AS string)
               END AS comments_close_on,
               '' AS signing_date,
               lower(n_name) || ', ' || lower(c_mktsegment) || ',' || lower(n_name) AS agency_slugs,
               CASE WHEN o_orderstatus <> 'P'
                    THEN '["' || o_orderkey || '","' || o_custkey || '"]' END AS docket_ids_json,
               CASE o_orderstatus WHEN 'O' THEN '["R' || o_custkey || '","R' || (o_custkey + 1) || '"]'
                    WHEN 'F' THEN '[]' END AS regulation_id_numbers_json,
               'https://fr.example.org/' || o_orderkey AS html_url,
               'https://fr.example.org/' || o_orderkey || '.pdf' AS pdf_url,
               CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS string) END
                 AS executive_order_number
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey""",
    # each document as written, wrapped in markup with digits and one more word,
    # word-reversed, and word-reversed with the extra word; labelled documents add
    # blank, missing and "see attached" bodies
    "comments": """
        SELECT comment_id, upper(lang) AS docket_id, source AS agency_code,
               'Comment ' || doc_id AS title, comment,
               CASE WHEN kind = 1 THEN 'Attachment of ' || doc_id WHEN kind = 3 THEN ' ' END
                 AS text_content,
               CASE WHEN kind = 0 THEN 'Ann' WHEN kind = 1 THEN '' END AS first_name,
               CASE WHEN kind = 0 THEN 'Lee' || doc_id END AS last_name,
               CASE WHEN kind = 2 THEN 'Org of ' || source ELSE '' END AS organization,
               CAST(NULL AS string) AS category,
               CASE WHEN kind = 3 AND doc_id % 7 = 0 THEN 'undated'
                    ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS int) AS string) END
                 AS posted_date,
               CAST(DATE '2024-02-01' + CAST(doc_id % 30 AS int) AS string) AS modify_date,
               CASE WHEN kind = 1 THEN '[{{"title":"","formats":[{{"url":"https://a.example.org/'
                         || doc_id || '/scan.pdf","format":"pdf"}},{{"url":"","format":"x"}}]}}]'
                    WHEN kind = 2 THEN '[{{"title":"Letter ' || doc_id
                         || '","formats":[{{"url":"https://a.example.org/' || doc_id || '"}}]}}]'
                    WHEN kind = 3 THEN 'not json' END AS attachments_json
        FROM (
          SELECT doc_id * 5 AS comment_id, 0 AS kind, doc_id, lang, source, text AS comment
          FROM {documents}
          UNION ALL
          SELECT doc_id * 5 + 1, 1, doc_id, lang, source,
                 '<p>' || text || '</p> 2024&nbsp;furthermore ' || doc_id
          FROM {documents}
          UNION ALL
          SELECT doc_id * 5 + 2, 2, doc_id, lang, source, REVERSED_WORDS FROM {documents}
          UNION ALL
          SELECT doc_id * 5 + 4, 4, doc_id, lang, source, 'Furthermore ' || REVERSED_WORDS
          FROM {documents}
          UNION ALL
          SELECT d.doc_id * 5 + 3, 3, d.doc_id, lang, source,
                 CASE WHEN toxic = 1 THEN 'See attached file(s).' WHEN quality = 1 THEN '  ' END
          FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
        ) x""",
    "html_comments": """
        SELECT page_id AS comment_id, 'pages' AS docket_id, html AS comment FROM {pages}""",
    "event_comments": """
        SELECT event_id AS comment_id, CAST(user_id AS string) AS docket_id,
               event_type AS agency_code,
               CASE WHEN event_type = 'error' AND value < 1 THEN '' ELSE CAST(CAST(ts AS date) AS string) END
                 AS posted_date
        FROM {events}""",
    "raw_dockets": """
        SELECT event_id AS docket_id,
               CASE event_type WHEN 'error' THEN '{{"data":{{"attributes":' || props || '}}}}'
                    WHEN 'view' THEN '{{"data":' || props || '}}' WHEN 'click' THEN props
                    WHEN 'signup' THEN 'broken {{' END AS raw_json,
               CASE WHEN event_type = 'purchase' THEN '"bought"' ELSE '' END AS k
        FROM {events}""",
    "agencies": """
        SELECT n_name AS agency_code, 'Office of ' || n_name AS name FROM {nation}""",
    # nations of one region are left unmapped, so they fall into the last group
    "departments": """
        SELECT n_name AS agency_code, r_name AS department, r_regionkey AS department_order
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'""",
    # the agencies of one region get curated peers: all agencies of another
    "curated": """
        SELECT a.n_name AS agency_code, b.n_nationkey AS position, b.n_name AS peer_code
        FROM {nation} a JOIN {region} ra ON a.n_regionkey = ra.r_regionkey
             JOIN {nation} b ON b.n_regionkey = (ra.r_regionkey + 1) % 5
        WHERE ra.r_name = 'ASIA'""",
    "corpus": """
        SELECT CAST(doc_id AS string) AS docket_id, source AS agency_code,
               lang || ' ' || source AS title, 'Rulemaking' AS docket_type,
               CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS int) AS string) AS modify_date,
               text AS abstract
        FROM {documents}""",
    "part_corpus": """
        SELECT CAST(p_partkey AS string) AS docket_id, p_brand AS agency_code,
               'Proposed ' || p_name || ' rule of ' || p_type || ' trade' AS title,
               p_type AS docket_type,
               CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS int) AS string) AS modify_date,
               p_brand || ' ' || p_name AS abstract
        FROM {part}""",
    "unified_agenda": """
        SELECT 'R' || c_custkey AS rin, c_name || ' rule' AS title, c_mktsegment AS abstract,
               n_name AS agency_name, 'Active' AS rin_status,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Final Rule Stage'
                    WHEN 'MACHINERY' THEN 'Long-Term Actions' ELSE 'Proposed Rule Stage' END
                 AS rule_stage,
               CASE WHEN c_acctbal > 5000 THEN 'Economically Significant' ELSE '' END
                 AS priority_category,
               edition AS agenda_edition,
               CASE WHEN c_acctbal < 0 THEN '3000-01-01' WHEN c_acctbal > 9000 THEN NULL
                    ELSE CAST(DATE '2024-01-01' + CAST(c_custkey % 365 AS int) AS string) END
                 AS next_action_date,
               'https://agenda.example.org/' || c_custkey AS url
        FROM (
          SELECT c.*, '202404' AS edition FROM {customer} c
          UNION ALL
          SELECT c.*, '202410' AS edition FROM {customer} c WHERE c_acctbal > 0
        ) c JOIN {nation} ON c_nationkey = n_nationkey""",
    "congress_bills": """
        SELECT 'B' || o_orderkey AS bill_id, CAST(110 + o_custkey % 14 AS string) AS congress,
               CASE o_orderkey % 9 WHEN 0 THEN 'HR' WHEN 1 THEN 's' WHEN 2 THEN 'hjres'
                    WHEN 3 THEN 'sjres' WHEN 4 THEN 'hconres' WHEN 5 THEN 'sconres'
                    WHEN 6 THEN 'hres' WHEN 7 THEN 'sres' ELSE 'xx' END AS bill_type,
               CAST(o_orderkey AS string) AS bill_number,
               CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'A bill on ' || o_orderpriority END
                 AS title,
               CASE WHEN o_orderkey % 2 = 0 THEN 'House' ELSE 'Senate' END AS origin_chamber,
               CAST(CAST(o_orderdate AS date) AS string) AS latest_action_date,
               o_orderpriority AS latest_action_text
        FROM {orders}""",
    "cfr_sections": """
        SELECT 'G' || p_partkey AS granule_id, CAST(p_size AS string) AS title,
               CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey % 100 AS string) END AS part,
               CASE WHEN p_size <= 25 THEN (p_partkey % 100) || '-' || (p_partkey % 7) END AS section,
               p_name AS heading, '2025' AS edition_year,
               'https://cfr.example.org/' || p_partkey AS url, p_brand AS cfr_ref,
               CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS int) AS string) AS last_modified
        FROM {part}""",
    "sam_entities": """
        SELECT 'U' || s_suppkey AS uei, s_name AS legal_business_name,
               CASE WHEN s_acctbal > 5000 THEN 'Trading ' || s_suppkey ELSE '' END AS dba_name,
               CASE WHEN s_acctbal > 0 THEN 'City ' || s_nationkey END AS city,
               n_name AS state, CAST(100 + s_suppkey % 50 AS string) AS primary_naics,
               CAST(DATE '2020-01-01' + CAST(s_suppkey % 900 AS int) AS string) AS registration_date,
               CAST(NULL AS string) AS registration_expiration_date,
               CASE WHEN s_acctbal > 2000 THEN 'https://e.example.org/' || s_suppkey END AS entity_url
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "lobbying_filings": """
        SELECT 'L' || o_orderkey AS filing_uuid, 'Q' AS filing_type,
               CAST(2024 + o_orderkey % 3 AS string) AS filing_year,
               CASE o_orderkey % 5 WHEN 0 THEN 'first_quarter' WHEN 1 THEN 'second_quarter'
                    WHEN 2 THEN 'year_end' WHEN 3 THEN 'other' END AS filing_period,
               CAST(CAST(o_orderdate AS date) AS string) || ' 10:00:00' AS dt_posted,
               'Firm ' || o_custkey AS registrant_name,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE c_name END AS client_name,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey * 37 AS string) END AS income,
               CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey * 4099 AS string) END AS expenses,
               'https://l.example.org/' || o_orderkey AS url,
               '[{{"description":"' || o_orderpriority || '"}},{{"description":"b"}}]'
                 AS lobbying_activities_json
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "fec_committees": """
        SELECT 'C ' || c_custkey AS committee_id, c_name AS name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'House' WHEN 'MACHINERY' THEN 'Senate'
                    WHEN 'AUTOMOBILE' THEN 'PAC - Qualified' ELSE NULL END AS committee_type_full,
               'Principal' AS designation_full, '' AS party_full, n_name AS state,
               CASE WHEN c_acctbal > 0
                    THEN CAST(DATE '2023-01-01' + CAST(c_custkey % 700 AS int) AS string) END
                 AS last_file_date
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "usaspending_recipients": """
        SELECT 'r-' || s_suppkey AS recipient_id, s_name AS name, 'U' || s_suppkey AS uei,
               CASE s_suppkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'p' WHEN 2 THEN 'C' ELSE 'Z' END
                 AS recipient_level,
               CASE WHEN s_suppkey % 10 = 9 THEN 'n/a'
                    ELSE CAST(s_suppkey * s_suppkey * 7919 AS string) END AS total_award_amount
        FROM {supplier}""",
    "court_dockets": """
        SELECT 'D' || o_orderkey AS cl_docket_id, c_name || ' v. ' || n_name || ' et al.' AS case_name,
               'dcd' AS court, o_orderkey || '-cv' AS docket_number,
               CAST(CAST(o_orderdate AS date) AS string) AS date_filed,
               CASE o_orderstatus WHEN 'F' THEN CAST(CAST(o_orderdate AS date) + 90 AS string)
                    WHEN 'P' THEN '' END AS date_terminated,
               '899 Other Statutes: ' || o_orderpriority AS nature_of_suit,
               CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT' THEN NULL
                    ELSE '05:702' END AS cause,
               CASE WHEN o_orderstatus = 'F' THEN 'Judge' || o_custkey END AS assigned_to,
               'https://c.example.org/' || o_orderkey AS absolute_url
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey""",
    "gao_reports": """
        SELECT 'gao-' || p_partkey AS report_id, p_name AS title,
               'What GAO Found ' || p_type AS abstract,
               CAST(DATE '2022-01-01' + CAST(p_partkey % 900 AS int) AS string) AS published_date,
               'https://g.example.org/' || p_partkey AS url
        FROM {part}""",
    "crs_reports": """
        SELECT 'R ' || p_partkey AS report_id, p_name AS title, p_type AS report_type,
               CAST(DATE '2022-01-01' + CAST(p_partkey % 900 AS int) AS string) AS published_date,
               'https://api.example.org/' || p_partkey AS url
        FROM {part}""",
}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


@cache
def references(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_REF.findall(STANDINS[name])))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a stand-in as a DataFrame."""
    if name in DRIVER_TABLES:
        configure(spark)
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table
    text = STANDINS[name].replace("REVERSED_WORDS", REVERSED_WORDS["spark"])
    return spark.sql(text, **{r: load(spark, sf_dir, r) for r in references(name)})


def _duckdb_text(name: str) -> str:
    text = STANDINS[name].replace("REVERSED_WORDS", REVERSED_WORDS["duckdb"])
    return text.format(**{r: r for r in references(name)})


def ctes(names: list[str], extra: dict[str, tuple[list[str], str]]) -> str:
    """``name AS (…)`` definitions of the named stand-ins and rollups, dependencies first."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name in DRIVER_TABLES:
            return
        needs, text = extra[name] if name in extra else (references(name), None)
        for need in needs:
            add(need)
        done[name] = text if text is not None else _duckdb_text(name)

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({t})" for n, t in done.items())
