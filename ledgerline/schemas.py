"""Explicit schemas of the relations, and the citation struct that every result row carries."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The type of a DDL string; needs a running session."""
    return T.StructType.fromDDL(ddl)


MANIFEST_REQUIRED = ("doc_id", "rcept_no", "corp_code", "corp_name", "doc_group", "is_correction", "file_path", "file_format", "n_files")
MANIFEST_DDL = (
    "doc_id string, rcept_no string, corp_code string, corp_name string, doc_group string, is_correction boolean, file_path string, file_format string, n_files int, "
    "listed_name string, stock_code string, industry string, sector string, doc_subtype string, report_nm string, rcept_dt string, flr_nm string, base_year int, base_month int"
)
UNIVERSE_DDL = (
    "corp_code string, stock_code string, corp_name string, listed_name string, corp_eng_name string, market string, industry string, sector string, sector_no string, "
    "listing_date string, fiscal_month string, market_cap string, n_periodic string, n_major string, n_exchange string, n_holding string, note string"
)
EVENT_DDL = (
    "doc_id string, rcept_no string, rcept_dt string, corp_code string, corp_name string, listed_name string, sector string, industry string, doc_group string, doc_subtype string, "
    "event_type string, report_nm string, is_correction boolean, title string, amount string, amount_type string, ratio string, ratio_base string, counterparty string, "
    "period_start string, period_end string, event_date string, reserved_reason string, extra_json string, fields_json string, corr_date string, corr_reason string, "
    "corr_target_doc string, corr_target_date string, corr_diffs_json string"
)
CHUNK_DDL = "chunk_id string, doc_id string, rcept_no string, src_file string, path string, part int, document_sequence int, section_start int, section_end int, block_start int, block_end int, n_chars int, n_tables int, text string"
LINK_DDL = "correction_rcept_no string, predecessor_rcept_no string, status string, method string, confidence double, evidence_json string, candidates_json string"
STATUS_DDL = "rcept_no string, root_rcept_no string, latest_rcept_no string, is_latest boolean, n_corrections long"
STATEMENT_DDL = (
    "rcept_no string, fs_div string, fs_nm string, sj_div string, sj_nm string, account_nm string, ord string, currency string, thstrm_nm string, thstrm_dt string, thstrm_amount string, "
    "frmtrm_nm string, frmtrm_dt string, frmtrm_amount string, bfefrmtrm_nm string, bfefrmtrm_dt string, bfefrmtrm_amount string, thstrm_add_amount string, frmtrm_add_amount string"
)
LIST_DDL = "rcept_no string, rcept_dt string, corp_code string, corp_name string, stock_code string, report_nm string, flr_nm string, rm string"
CITATION_FIELDS = ("doc_id", "rcept_no", "corp_code", "corp_name", "report_nm", "rcept_dt", "section", "is_latest", "root_rcept_no", "latest_rcept_no", "correction_status", "correction_method")

DOC_GROUPS = ("periodic", "exchange", "major", "holding")
FILE_FORMATS = ("xml", "pdf+html")
LINK_STATUSES = ("linked", "ambiguous_candidate", "unresolved_external_root")
LINK_METHODS = ("periodic_key", "target_date", "content_match", "none")
