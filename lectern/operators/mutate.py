"""Changes to chapters, paragraphs and notes, as functions from tables to tables with renewed ordinals.

Tables: paragraphs (doc_id, chapter_id, ord, id, ...), chapters (doc_id, chapter_id, ch_ord, ...). Requests are tables as well, one row
for each document at most, so one plan serves any number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def renumber(paragraphs: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("doc_id", "chapter_id").orderBy(*order)
    return paragraphs.withColumn("ord", F.row_number().over(w) - 1)


def neighbours(chapters: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ch_ord")
    return chapters.withColumn("prev_id", F.lag("chapter_id").over(w)).withColumn("next_id", F.lead("chapter_id").over(w))


def shift_paragraphs(paragraphs: DataFrame, chapters: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves paragraphs to the chapter beside theirs: paragraphs, chapters left, and moved (paragraph_id, new_chapter).

    requests: doc_id, chapter_id, at (ord), direction (prev, next), scope (single, slice). prev moves the paragraphs up to `at` to the end
    of the chapter before; next moves those from `at` on to the start of the one after. Requests without such a chapter do nothing;
    a chapter that loses all its paragraphs goes.
    """
    dest = neighbours(chapters).select("doc_id", F.col("chapter_id").alias("_src"), "prev_id", "next_id")
    req = requests.select("doc_id", F.col("chapter_id").alias("_src"), F.col("at").alias("_at"), "direction", "scope").join(dest, ["doc_id", "_src"])
    req = req.withColumn("_dest", F.when(F.col("direction") == "prev", F.col("prev_id")).otherwise(F.col("next_id"))).where("_dest is not null")
    rows = paragraphs.join(req.select("doc_id", "_src", "_at", "direction", "scope", "_dest"), "doc_id", "left")
    inside = F.col("chapter_id") == F.col("_src")
    span = F.when(F.col("scope") == "single", F.col("ord") == F.col("_at")).when(F.col("direction") == "prev", F.col("ord") <= F.col("_at")).otherwise(F.col("ord") >= F.col("_at"))
    moves = F.coalesce(inside & span, F.lit(False))
    side = F.when(~moves, 0).when(F.col("direction") == "prev", 1).otherwise(-1)
    out = rows.withColumn("_moves", moves).withColumn("_side", side).withColumn("chapter_id", F.when(moves, F.col("_dest")).otherwise(F.col("chapter_id")))
    moved = out.where("_moves").select("doc_id", F.col("id").alias("paragraph_id"), F.col("chapter_id").alias("new_chapter"))
    kept = renumber(out, [F.col("_side"), F.col("ord")]).select(paragraphs.columns)
    left = chapters.join(kept.select("doc_id", "chapter_id").distinct(), ["doc_id", "chapter_id"], "left_semi").select(chapters.columns)
    return kept, left, moved


def split_chapter(paragraphs: DataFrame, chapters: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits chapters before a paragraph that isn't their first. requests: doc_id, chapter_id, at, title."""
    req = requests.where("at > 0").select("doc_id", "chapter_id", F.col("at").alias("_at"), F.col("title").alias("_title"))
    new_id = F.concat(F.lit("ch_"), F.left(F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), "chapter_id", F.col("_at").cast("string")), 256), F.lit(8)))
    sizes = paragraphs.groupBy("doc_id", "chapter_id").agg(F.max("ord").alias("_max"))
    req = req.join(sizes, ["doc_id", "chapter_id"]).where("_at <= _max").drop("_max").withColumn("_new", new_id)
    rows = paragraphs.join(req, ["doc_id", "chapter_id"], "left")
    tail = F.coalesce(F.col("ord") >= F.col("_at"), F.lit(False))
    out = rows.withColumn("chapter_id", F.when(tail, F.col("_new")).otherwise(F.col("chapter_id"))).withColumn("ord", F.when(tail, F.col("ord") - F.col("_at")).otherwise(F.col("ord")))
    made = chapters.join(req, ["doc_id", "chapter_id"]).withColumn("chapter_id", F.col("_new")).withColumn("title", F.col("_title")).withColumn("_half", F.lit(1)).select(*chapters.columns, "_half")
    both = chapters.withColumn("_half", F.lit(0)).unionByName(made)
    order = Window.partitionBy("doc_id").orderBy("ch_ord", "_half")
    return out.select(paragraphs.columns), both.withColumn("ch_ord", F.row_number().over(order) - 1).select(chapters.columns)


def delete_paragraphs(paragraphs: DataFrame, cards: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the doomed paragraphs (doc_id, id), their cards, and their chats."""
    keys = doomed.select("doc_id", F.col("id").alias("paragraph_id"))
    left = renumber(paragraphs.join(doomed.select("doc_id", "id"), ["doc_id", "id"], "left_anti"), [F.col("ord")]).select(paragraphs.columns)
    return left, cards.join(keys, ["doc_id", "paragraph_id"], "left_anti").select(cards.columns), messages.join(keys, ["doc_id", "paragraph_id"], "left_anti").select(messages.columns)


def delete_chapters(documents: DataFrame, chapters: DataFrame, paragraphs: DataFrame, cards: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, ...]:
    """Without the doomed chapters (doc_id, chapter_id) and all that hangs on them; a document that loses its last chapter goes too."""
    key = ["doc_id", "chapter_id"]
    left = chapters.join(doomed, key, "left_anti")
    w = Window.partitionBy("doc_id").orderBy("ch_ord")
    left = left.withColumn("ch_ord", F.row_number().over(w) - 1).select(chapters.columns)
    emptied = chapters.select("doc_id").distinct().join(left.select("doc_id"), "doc_id", "left_anti")
    rest = [t.join(doomed, key, "left_anti").select(t.columns) for t in (paragraphs, cards, messages)]
    return documents.join(emptied, "doc_id", "left_anti"), left, *rest


def rename_chapters(chapters: DataFrame, names: DataFrame) -> DataFrame:
    """Chapters with new titles (doc_id, chapter_id, new_title); blank ones are ignored."""
    n = names.select("doc_id", "chapter_id", F.nullif(T.strip(F.col("new_title")), F.lit("")).alias("_t"))
    return chapters.join(n, ["doc_id", "chapter_id"], "left").withColumn("title", F.coalesce("_t", "title")).select(chapters.columns)


def edit_paragraphs(paragraphs: DataFrame, edits: DataFrame, language: str = "en") -> DataFrame:
    """Paragraphs with new texts (doc_id, id, text[, type]): the type follows the text unless given, and the translation starts anew."""
    e = edits.select("doc_id", "id", F.col("text").alias("_text"), (F.col("type") if "type" in edits.columns else F.lit(None).cast("string")).alias("_type"))
    rows = paragraphs.join(e, ["doc_id", "id"], "left")
    text = T.strip(F.col("_text"))
    url = F.regexp_extract(text, r"^!\[.*?\]\((.*?)\)$", 1)
    inferred = F.when(url != "", "image").when(text.startswith("```"), "code").when(F.col("type").isin("image", "code"), "text").otherwise(F.col("type"))
    kind = F.coalesce("_type", inferred)
    still = kind.isin("image", "code") | T.mostly_target(text) | F.lit(language == "zh")
    hit = F.col("_text").isNotNull()
    new = {
        "english": text, "chinese": F.lit(""), "type": kind, "image_url": F.when(kind == "image", url).otherwise(""),
        "status": F.when(still, "completed").otherwise("pending"), "no_translate": still,
    }
    for name in [c for c in new if c in paragraphs.columns]:
        rows = rows.withColumn(f"_n_{name}", new[name])
    for name in [c for c in new if c in paragraphs.columns]:
        rows = rows.withColumn(name, F.when(hit, F.col(f"_n_{name}")).otherwise(F.col(name)))
    return rows.select(paragraphs.columns)


def insert_after(paragraphs: DataFrame, new: DataFrame) -> DataFrame:
    """New paragraphs (doc_id, chapter_id, after (ord), id, english) placed after a given one; later ones move on."""
    rows = new.select("doc_id", "chapter_id", F.col("after").alias("ord"), "id", "english", F.lit(1).alias("_half"))
    both = paragraphs.withColumn("_half", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return renumber(both, [F.col("ord"), F.col("_half"), F.col("id")]).select(paragraphs.columns)


def merge_paragraphs(paragraphs: DataFrame, requests: DataFrame) -> DataFrame:
    """Merges paragraphs with the next one. requests: doc_id, chapter_id, at (ord of the first); without a next one nothing happens."""
    req = requests.select("doc_id", "chapter_id", F.col("at").alias("_at"))
    w = Window.partitionBy("doc_id", "chapter_id").orderBy("ord")
    rows = paragraphs.withColumn("_next", F.lead("english").over(w)).withColumn("_has", F.lead("ord").over(w).isNotNull()).join(req, ["doc_id", "chapter_id"], "left")
    first = F.coalesce((F.col("ord") == F.col("_at")) & F.col("_has"), F.lit(False))
    gone = F.coalesce((F.col("ord") == F.col("_at") + 1), F.lit(False))
    text = T.joined(F.coalesce("english", F.lit("")), F.coalesce("_next", F.lit("")))
    out = rows.withColumn("_first", first).where(~gone).withColumn("english", F.when(F.col("_first"), text).otherwise(F.col("english")))
    zh = T.mostly_target(F.col("english"))
    out = out.withColumn("chinese", F.when(F.col("_first"), F.lit("")).otherwise(F.col("chinese"))).withColumn("status", F.when(F.col("_first"), F.when(zh, "completed").otherwise("pending")).otherwise(F.col("status")))
    return renumber(out, [F.col("ord")]).select(paragraphs.columns)


def add_note(notes: Column, note: Column) -> Column:
    return F.concat(F.coalesce(notes, F.array().cast("array<struct<id:string,content:string>>")), F.array(note))


def update_note(notes: Column, note_id: Column, content: Column) -> Column:
    return F.transform(notes, lambda n: F.when(n["id"] == note_id, n.withField("content", content)).otherwise(n))


def delete_note(notes: Column, note_id: Column) -> Column:
    return F.filter(notes, lambda n: n["id"] != note_id)


def overlay_settings(base: Column, over: Column) -> Column:
    """Settings of a document over the general ones; blank values don't hide."""
    kept = F.map_filter(over, lambda k, v: F.coalesce(v, F.lit("")) != "")
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(kept), k))
    return F.map_concat(rest, kept)


def upsert_models(models: DataFrame, new: DataFrame) -> DataFrame:
    """Models (name, config, is_default) with new ones in place of those of the same name."""
    return models.join(new.select("name"), "name", "left_anti").select(models.columns).unionByName(new.select(models.columns))


def delete_model(models: DataFrame, name: str) -> DataFrame:
    """Models without one; if that was the default, the first of the rest by name takes its place."""
    rest = models.where(F.col("name") != name)
    w = Window.orderBy(F.col("is_default").desc(), "name")  # a list of models is short
    return rest.withColumn("is_default", F.row_number().over(w) == 1)


def latest_log(log: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """The newest n entries of each key, newest first."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return log.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def latest_paragraphs(snapshot: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows of a snapshot with what has changed since (by doc_id and id); rows that are gone since stay as they were."""
    new = latest.select("doc_id", "id", *(F.col(c).alias(f"_{c}") for c in ("english", "chinese", "status")))
    out = snapshot.join(new, ["doc_id", "id"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("english", "chinese", "status")}).select(snapshot.columns)


def chapter_counts(chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Chapters with their paragraphs counted; one without a body keeps the count it had."""
    n = paragraphs.groupBy("doc_id", "chapter_id").agg(F.count("*").alias("_n"))
    return chapters.join(n, ["doc_id", "chapter_id"], "left").withColumn("paragraph_count", F.coalesce("_n", "paragraph_count").cast("int")).drop("_n")


def append_messages(history: DataFrame, new: DataFrame, chat: str, order: str) -> DataFrame:
    """A chat log with new messages numbered on after those it has."""
    last = history.groupBy(chat).agg(F.max(order).alias("_last"))
    w = Window.partitionBy(chat).orderBy(order)
    rows = new.join(last, chat, "left").withColumn(order, (F.coalesce("_last", F.lit(-1)) + F.row_number().over(w)).cast(history.schema[order].dataType))
    return history.unionByName(rows.select(history.columns))


def set_paragraphs(paragraphs: DataFrame, updates: DataFrame, append: bool = False) -> DataFrame:
    """Paragraphs with the translation, status or extracted text that updates (doc_id, id, chinese, status, extracted_text) give; nulls change nothing.

    With append, a translation goes after the one there is. Only the updated columns are touched, so newer values of others stay.
    """
    u = updates.select("doc_id", "id", *(F.col(c).alias(f"_{c}") for c in ("chinese", "status", "extracted_text")))
    out = paragraphs.join(u, ["doc_id", "id"], "left")
    more = F.when(F.coalesce("chinese", F.lit("")) == "", F.col("_chinese")).otherwise(F.concat_ws("\n", "chinese", "_chinese")) if append else F.col("_chinese")
    out = out.withColumn("chinese", F.when(F.col("_chinese").isNotNull(), more).otherwise(F.col("chinese")))
    for c in ("status", "extracted_text"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(paragraphs.columns)


def set_chapter_status(chapters: DataFrame, updates: DataFrame) -> DataFrame:
    """Chapters with translation_status and error from updates (doc_id, chapter_id, status, error); paragraphs aren't read or written."""
    u = updates.select("doc_id", "chapter_id", F.struct("status", "error").alias("_new"))
    out = chapters.join(u, ["doc_id", "chapter_id"], "left")
    return out.withColumn("translation_status", F.coalesce("_new", "translation_status") if "translation_status" in chapters.columns else F.col("_new")).drop("_new")


def pause_documents(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents with those that are listed and being translated set to paused; nothing else of them changes."""
    hit = documents.join(keys.select("doc_id", F.lit(True).alias("_hit")).distinct(), "doc_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "translating"), "paused").otherwise(F.col("status"))).select(documents.columns)


def normalized_messages(messages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """messages (chat, seq, role, parts: array of type, text, image_url) with `parts` without empty ones, and local images (path, content)
    as data URIs."""
    kept = F.filter("parts", lambda p: ((p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) != "")) | ((p["type"] == "image_url") & (F.coalesce(p["image_url"], F.lit("")) != "")))
    out = messages.withColumn("parts", kept).where(F.size("parts") > 0)
    if images is None:
        return out
    uris = images.select("path", T.data_uri(F.col("path"), F.col("content")).alias("uri"))
    each = out.select("chat", "seq", "role", F.posexplode("parts").alias("n", "p")).join(uris, F.col("p.image_url") == F.col("path"), "left")
    part = F.col("p").withField("image_url", F.coalesce("uri", "p.image_url"))
    return each.groupBy("chat", "seq", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]).alias("parts"))
