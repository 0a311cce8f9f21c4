"""Schemas of the record store, its pages and its reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that stored tables hold.
DOCUMENT_STATUS = ("pendiente", "procesando", "completado", "error")
SIDES = ("CEDULA_FRONT", "CEDULA_BACK", "CEDULA_AMBOS_LADOS", "TARJETA_IDENTIDAD_FRONT", "TARJETA_IDENTIDAD_BACK", "UNKNOWN")
DIFFERENCE_KINDS = ("diferente", "faltante_bd", "nuevo_bd")
WHOLE_RECORD = "registro_completo"
RECORD_STATUS = ("VALID", "REVIEW_REQUIRED", "FALLBACK_TESSERACT")

LAYOUT = """document_id string, text string, elapsed_ms long, pages array<struct<page_number:int, width:double, height:double, text:string,
  lines:array<struct<text:string, confidence:double, page_number:int, x:double, y:double, w:double, h:double>>>>"""



def side_role(side: Column) -> Column:
    """BOTH, FRONT, BACK or UNKNOWN: what a page's side means for grouping, in the codes of SIDES and of page_side().

    Any other code, and null, is UNKNOWN, so no page is lost.
    """
    s = F.upper(F.coalesce(side, F.lit("")))
    return F.when(s.rlike("BOTH|AMBOS_LADOS"), "BOTH").when(s.contains("FRONT"), "FRONT").when(s.contains("BACK"), "BACK").otherwise("UNKNOWN")


RECORD = """id_number string, given_names string, surnames string, birth_date date, issue_date date, issue_place string, sex string,
  confidence decimal(5,2), requires_review boolean, record_status string, engine string, group_id string, doc_type string,
  front_page int, back_page int, page_number int, reviewed_fields array<string>, registered_at timestamp, updated_at timestamp"""
DIFFERENCE = "comparison_id string, id_number string, field string, store_value string, external_value string, diff_kind string"
