"""Registry of checked queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from docketscope.plans import rollups as R
from docketscope.session import configure
from workload.standins import ctes, load

# "Now" of the order-based tables and of the comment and event tables.
AS_OF = "2001-06-30"
AS_OF_2024 = "2024-01-20"

# name -> (needed stand-ins, SQL): the rollups as the checking engine builds them
ROLLUP_SQL = {
    "comments_index": (
        ["reg_documents"],
        """SELECT agency_code, docket_id, CAST(year(CAST(posted_date AS date)) AS bigint) AS year,
                  CAST(month(CAST(posted_date AS date)) AS bigint) AS month, count(*) AS row_count
           FROM reg_documents GROUP BY ALL""",
    ),
    "feed_summary": (
        ["dockets", "comments_index", "reg_documents"],
        """SELECT d.docket_id, d.agency_code, d.title, d.abstract, d.docket_type, d.modify_date,
                  d.date_created, CAST(coalesce(c.n, 0) AS bigint) AS comment_count,
                  e.comment_end_date
           FROM dockets d
           LEFT JOIN (SELECT docket_id, sum(row_count) AS n FROM comments_index GROUP BY 1) c
             USING (docket_id)
           LEFT JOIN (SELECT docket_id, max(comment_end_date) AS comment_end_date
                      FROM reg_documents
                      WHERE document_type = 'Proposed Rule' AND comment_end_date <> ''
                      GROUP BY 1) e USING (docket_id)""",
    ),
    "agency_stats": (
        ["dockets", "reg_documents", "comments_index"],
        """SELECT coalesce(a.agency_code, b.agency_code, c.agency_code) AS agency_code,
                  CAST(coalesce(a.n, 0) AS bigint) AS docket_count,
                  CAST(coalesce(b.n, 0) AS bigint) AS document_count,
                  CAST(coalesce(c.n, 0) AS bigint) AS comment_count
           FROM (SELECT agency_code, count(*) n FROM dockets GROUP BY 1) a
           FULL JOIN (SELECT agency_code, count(*) n FROM reg_documents GROUP BY 1) b
             ON a.agency_code = b.agency_code
           FULL JOIN (SELECT agency_code, sum(row_count) n FROM comments_index GROUP BY 1) c
             ON coalesce(a.agency_code, b.agency_code) = c.agency_code""",
    ),
    "agency_monthly_volume": (
        ["reg_documents"],
        """SELECT agency_code, CAST(year(CAST(posted_date AS date)) AS bigint) AS year,
                  CAST(month(CAST(posted_date AS date)) AS bigint) AS month, document_type,
                  count(*) AS document_count
           FROM reg_documents GROUP BY ALL""",
    ),
    "rulemaking_lifecycles": (
        ["reg_documents", "dockets"],
        """SELECT CASE WHEN f.final_date IS NOT NULL THEN 'pair' ELSE 'stuck' END AS kind,
                  p.docket_id, d.agency_code, d.title, p.proposed_date, f.final_date,
                  CAST(f.final_date - p.proposed_date AS int) AS days
           FROM (SELECT docket_id, min(CAST(posted_date AS date)) AS proposed_date
                 FROM reg_documents WHERE document_type = 'Proposed Rule' GROUP BY 1) p
           JOIN dockets d ON d.docket_id = p.docket_id
           LEFT JOIN (SELECT q.docket_id, min(CAST(r.posted_date AS date)) AS final_date
                      FROM (SELECT docket_id, min(CAST(posted_date AS date)) AS first_day
                            FROM reg_documents WHERE document_type = 'Proposed Rule' GROUP BY 1) q
                      JOIN reg_documents r ON r.docket_id = q.docket_id
                        AND r.document_type = 'Rule' AND CAST(r.posted_date AS date) >= first_day
                      GROUP BY 1) f ON f.docket_id = p.docket_id
           WHERE f.final_date IS NOT NULL
              OR p.docket_id NOT IN (SELECT docket_id FROM reg_documents WHERE document_type = 'Rule')
        """,
    ),
    "discovery_signals": (
        ["reg_documents"],
        f"""SELECT agency_code, coalesce(fresh, 0) AS recent_30d, year_n / 12.0 AS baseline,
                   coalesce(fresh, 0) / (year_n / 12.0) AS ratio
            FROM (SELECT agency_code, count(*) AS year_n FROM reg_documents
                  WHERE TRY_CAST(posted_date AS timestamp) >= DATE '{AS_OF}' - INTERVAL 13 MONTH
                    AND TRY_CAST(posted_date AS timestamp) < DATE '{AS_OF}' - INTERVAL 1 MONTH GROUP BY ALL)
            LEFT JOIN (SELECT agency_code, count(*) AS fresh FROM reg_documents
                  WHERE TRY_CAST(posted_date AS timestamp) >= DATE '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL)
              USING (agency_code)
            WHERE year_n >= 24 AND coalesce(fresh, 0) >= year_n / 12.0""",
    ),
    "fr_docket_links": (
        ["federal_register"],
        """SELECT DISTINCT * FROM (
             SELECT unnest(CAST(json_extract(docket_ids_json, '$') AS VARCHAR[])) AS docket_id, f.*
             FROM federal_register f)""",
    ),
}


@dataclass
class Tables:
    """The driver's tables, the stand-ins and the rollups built from them."""

    spark: SparkSession
    sf_dir: str
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            build = getattr(self, f"_{name}", None)
            self._seen[name] = build() if build else load(self.spark, self.sf_dir, name)
        return self._seen[name]

    def _comments_index(self) -> DataFrame:
        return R.build_comments_index(self("reg_documents"))

    def _feed_summary(self) -> DataFrame:
        return R.build_feed_summary(self("dockets"), self("comments_index"), self("reg_documents"))

    def _agency_stats(self) -> DataFrame:
        return R.build_agency_stats(self("dockets"), self("reg_documents"), self("comments_index"))

    def _agency_monthly_volume(self) -> DataFrame:
        return R.build_agency_monthly_volume(self("reg_documents"))

    def _rulemaking_lifecycles(self) -> DataFrame:
        return R.build_rulemaking_lifecycles(self("reg_documents"), self("dockets"))

    def _discovery_signals(self) -> DataFrame:
        return R.build_discovery_spike(self("reg_documents"), AS_OF, min_ratio=1.0)

    def _fr_docket_links(self) -> DataFrame:
        return R.build_fr_docket_links(self("federal_register"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables)`` under a name, with the SQL that must give the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            head = ctes(uses.split(), ROLLUP_SQL | TEXT_SQL)
            body = sql.strip()
            if body.upper().startswith("WITH "):
                glue = ",\n" + body[5:]
            else:
                glue = "\n" + body
            prefix = "WITH RECURSIVE " if recursive else "WITH "
            SQL[name] = prefix + head + glue if head else body
        return fn

    return register


# name -> (needed, SQL): shared steps of the comment-text checks
TEXT_SQL: dict[str, tuple[list[str], str]] = {}
