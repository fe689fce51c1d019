"""Fixed schemas of the study tables, and the one step that applies defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = "struct<id:string,position:string,title:string,content:string,created_at:string,updated_at:string>"

DOCUMENTS = (
    "doc_id string, filename string, file_type string, is_scanned boolean, parse_mode string, language string, total_pages int, "
    "total_paragraphs int, translated_paragraphs int, status string, "
    "progress struct<current_page:int,total_pages:int,percent:int,detail:string>, source_url string, error_message string, "
    "created_at string, updated_at string, web_config struct<root_url:string,fetch_mode:string,"
    "selected_chapters:array<struct<index:int,title:string,url:string,in_section:boolean,is_current:boolean,selected:boolean>>>, "
    "has_failed_chapters boolean, failed_chapter_count int"
)
CHAPTERS = (
    "doc_id string, chapter_id string, ch_ord int, title string, url string, fetch_success boolean, paragraph_count int, "
    f"translated_count int, file string, header_notes array<{NOTE}>, footer_notes array<{NOTE}>, translation_status struct<status:string,error:string>"
)
PARAGRAPHS = (
    "doc_id string, chapter_id string, ord int, id string, page int, type string, english string, chinese string, extracted_text string, "
    f"status string, no_translate boolean, image_url string, is_heading boolean, notes array<{NOTE}>"
)
CARDS = (
    "doc_id string, id string, chapter_id string, paragraph_id string, type string, front string, back string, tags array<string>, "
    "stats struct<reps:int,lapses:int,state:string,interval_days:bigint,ease_factor:double,last_reviewed:string,next_review:bigint,"
    "is_mistake:boolean,mistake_streak:int,graduated_from_mistakes:boolean>, created_at string, updated_at string"
)
CHAT_MESSAGES = "doc_id string, chat_type string, chapter_id string, paragraph_id string, seq int, role string, content string, timestamp double, created_at string"
DIGESTS = "doc_id string, chapter_id string, title string, source_hash string, is_compressed boolean, original_char_count int, char_count int, digest_content string, updated_at string"

#: Defaults of fields that a record may lack.
DEFAULTS = {
    "paragraphs": {"type": "text", "english": "", "chinese": "", "extracted_text": "", "status": "pending", "no_translate": False, "image_url": "", "is_heading": False, "page": 1},
    "cards": {"type": "qa", "chapter_id": "", "paragraph_id": "", "front": "", "back": ""},
    "chapters": {"title": "", "paragraph_count": 0, "translated_count": 0},
    "documents": {"filename": "Document", "file_type": "doc", "status": "", "created_at": "", "total_paragraphs": 0, "translated_paragraphs": 0, "language": "en"},
}


def normalize(df: DataFrame, table: str) -> DataFrame:
    """df with nulls of the table's defaulted columns filled; card types other than qa and cloze become qa."""
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS[table].items() if c in df.columns})
    if table == "paragraphs" and "source_text" in df.columns:  # two vocabularies for the same field
        out = out.withColumn("english", F.coalesce(F.nullif("english", F.lit("")), "source_text", F.lit("")))
    if table == "cards" and "type" in df.columns:
        out = out.withColumn("type", F.when(F.col("type") == "cloze", "cloze").otherwise("qa"))
    return out
