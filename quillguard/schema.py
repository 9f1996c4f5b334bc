"""Names, categories and schemas that the whole engine shares."""

from __future__ import annotations

from pyspark.sql import types as T

#: Limits that are part of the contract.
MAX_FILE_SIZE = 100 * 1024 * 1024
SAMPLE_SIZE = 100 * 1024
SNIFF_BYTES = 1024
CHUNK_SIZE = 64 * 1024
MIN_CONFIDENCE = 0.5
DEFAULT_CONFIDENCE = 0.8

FORMATS = ("text", "csv", "json", "html", "pdf", "docx", "xlsx", "pptx", "eml", "msg")
CATEGORIES = (
    "email", "iban", "phone", "credit_card", "ssn", "passport", "drivers_license", "tax_id_de", "ahv_ch", "national_id_de",
    "vat_number", "svnr_at", "svnr_de", "tax_id", "ipv4", "ipv6", "mac_address",
)
VALID, INVALID, UNVALIDATED = "valid", "invalid", "unvalidated"

FINDING = "struct<category:string,start:int,end:int,matched_text:string,confidence:float,validation:string,reason:string>"
MATCH = "struct<start:int,end:int,text:string>"

TABLE_CELL = T.StructType([T.StructField(n, T.LongType()) for n in ("table_index", "row", "column")])
#: One wide struct for the places of all formats; type says which fields hold.
POSITION = T.StructType(
    [T.StructField("type", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("line", "column", "byte_offset", "byte_length", "row", "page", "paragraph", "char_offset", "char_length", "slide", "text_index", "field_index", "part_index")]
    + [T.StructField(n, T.StringType()) for n in ("header", "path", "section", "sheet", "column_letter", "cell_ref", "element", "field")]
    + [T.StructField("hidden_sheet", T.BooleanType()), T.StructField("is_quoted", T.BooleanType()), T.StructField("table_cell", TABLE_CELL)]
    + [T.StructField(n, T.FloatType()) for n in ("x", "y", "width", "height")]
)
WARNING = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "message")])
SEGMENT = T.StructType([T.StructField("content", T.StringType()), T.StructField("position", POSITION)])


def label(category: str) -> str:
    """As in a redaction's [LABEL]."""
    return category.upper()
