"""Scalar text rules as column expressions.

Java's \\w and \\s are ASCII unless (?U) is set; rules that are Unicode-aware say so in their patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-龥]"
ZH_NUM = "一二三四五六七八九十"

# The rules' patterns and word lists.
HEADING_STRICT = (
    rf"^(chapter|section|part|unit)\s+[\dIVX{ZH_NUM}]+",
    r"^[I|V|X]+\.\s+[A-Z]",
    rf"^(第[{ZH_NUM}\d]+[章节回篇部])",
    r"^(abstract|introduction|background|related\s+work|methodology|methods|experiments?|results|discussion|conclusion|references|appendix)(?![\p{L}\p{N}_])",
    r"^(摘要|前言|引言|背景|相关工作|研究方法|实验结果|讨论|总结|结论|参考文献|附录)(?![\p{L}\p{N}_])",
)
HEADING_OUTLINE = (*HEADING_STRICT, r"^\d+(\.\d+)*\s+[A-Za-z一-龥]", rf"^[{ZH_NUM}]+[、.]\s*")
BULLET = rf"^(?:[•●○▪▫\-*]|\(?\d+[.)]|\(?[a-zA-Z][.)]|[ivxIVX]+[.)]|（?[{ZH_NUM}\d]+[）)]|[{ZH_NUM}]+[、.])\s*"
OUTLINE = (
    rf"^(?:\d+(\.\d+)+\s+|\(?([1-9]\d?|[ivxIVX]{{1,5}}|[a-zA-Z]|[{ZH_NUM}\d]{{1,3}})[.)]\s+|（?[{ZH_NUM}\d]+[）)]\s*"
    rf"|[{ZH_NUM}]+[、.]\s*|第[{ZH_NUM}\d]+[章节回篇部]\s*|[•●○▪▫\-*]\s+)"
)
CAPTION = r"(?i)^(?:Figure|Fig\.|Table|Listing|Chart|Plate|图|表)\s*\d+[:.]?"
CODE_PREFIXES = (
    "def ", "class ", "import ", "from ", "return ", "async def ", "function ", "const ", "let ", "var ",
    "public static void", "#include ", "int main(", "SELECT ", "INSERT INTO ",
)
ABBREVIATION = r"(?:^|[^\p{L}\p{N}_])(e\.g|i\.e|etc|vs|al|fig|ref|approx|dept|no|vol|sec|ch|dr|mr|mrs|ms|prof|inc|ltd|co|corp)\.$"
ERROR_MARK = "[翻译调用异常"


#: All characters of Unicode's White_Space, which (?U)\s matches.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends; looks at the ends only."""
    return F.trim(x, F.lit(SPACE))


def unix_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def blank_line_paragraphs(x: Column) -> Column:
    """Array of trimmed non-empty paragraphs between blank lines."""
    return F.filter(F.transform(F.split(unix_newlines(x), r"\n\s*\n+"), strip), lambda p: p != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def language_ratio(x: Column) -> Column:
    """Share of CJK among characters that aren't white space; 0 for blank texts."""
    solid = F.coalesce(F.length(F.regexp_replace(x, r"(?U)\s+", "")), F.lit(0))
    return let(solid, lambda n: F.when(n == 0, 0.0).otherwise(F.regexp_count(x, F.lit(CJK)) / n))


def detect_language(x: Column, sample: int | None = 3000, ratio: Column | None = None) -> Column:
    """By the share of CJK in the first characters (sample None: in all); ratio: that of the whole text, where it is known."""
    if sample is None:
        return F.when((language_ratio(x) if ratio is None else ratio) >= 0.15, "zh").otherwise("en")
    head = let(F.left(x, F.lit(sample)), language_ratio)
    return F.when((head if ratio is None else F.when(F.length(x) <= sample, ratio).otherwise(head)) >= 0.15, "zh").otherwise("en")


def mostly_target(x: Column, target: str = "zh", threshold: float = 0.35) -> Column:
    """Whether a text needs no translation: it is in the target language already, or has under two letters and digits outside links."""
    if target != "zh":
        threshold = 2.0  # never
    bare = F.regexp_replace(F.regexp_replace(x, r"!\[.*?\]\(.*?\)", ""), r"\[.*?\]\(.*?\)", "")
    told = let(
        F.when(x.contains("]("), bare).otherwise(x),
        lambda c: let(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), lambda n: F.when(n < 2, True).otherwise(F.regexp_count(c, F.lit(CJK)) / n >= threshold)),
    )
    return F.when(F.coalesce(x, F.lit("")) == "", True).otherwise(told)


def _bare(x: Column) -> Column:
    return F.trim(x, F.lit(SPACE + "*-_#`"))


def is_heading(x: Column, variant: str = "strict") -> Column:
    """variant: strict (five patterns), or outline (numbered outlines count as well)."""
    pattern = "(?iu)" + "|".join(HEADING_STRICT if variant == "strict" else HEADING_OUTLINE)
    return F.coalesce(let(F.left(_bare(x), F.lit(151)), lambda t: F.length(t).between(2, 150) & t.rlike(pattern)), F.lit(False))


def is_bullet(x: Column) -> Column:
    return strip(x).rlike(BULLET)


def is_caption(x: Column) -> Column:
    return strip(x).rlike(CAPTION)


def _any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def starts_like_code(x: Column) -> Column:
    return _any_of([x.startswith(k) for k in CODE_PREFIXES])


def is_code_line(x: Column, mono: Column | None = None) -> Column:
    t = strip(x)
    found = _any_of([t.startswith(k) | t.contains(" " + k) for k in CODE_PREFIXES]) | t.rlike(r"[∀-⋿]")
    return found if mono is None else (mono & (F.length(t) > 3)) | found


def is_structural(x: Column) -> Column:
    found = let(strip(x), lambda t: t.startswith("#") | is_heading(t, "outline") | t.rlike(BULLET) | let(F.ltrim(t, F.lit(SPACE + "*_`#")), lambda c: c.rlike(BULLET) | c.rlike(r"^\d+(\.\d+)+\s+")))  # a heading is one with or without marks
    return (F.coalesce(x, F.lit("")) != "") & found


def block_type(x: Column) -> Column:
    """heading, table, code, caption, list or text: the first rule that holds."""
    kind = lambda b: (
        F.when(b.startswith("#"), "heading")
        .when(b.startswith("|"), "table")
        .when(b.startswith("```"), "code")
        .when(is_heading(b, "outline"), "heading")
        .when(b.rlike(CAPTION), "caption")
        .when(b.rlike(BULLET), "list")
        .when(starts_like_code(b), "code")
        .otherwise("text")
    )
    return let(strip(x), kind)


def is_list_item(x: Column) -> Column:
    t = strip(x)
    number = F.regexp_extract(t, r"^\(?(\d+)[.)]", 1)
    return t.rlike(OUTLINE) & ~((number != "") & (F.length(F.regexp_replace(number, "^0+", "")) > 2))


def list_type(x: Column) -> Column:
    """Kind of a list item's mark, the first that holds; empty for others."""
    t = strip(x)
    m = strip(F.regexp_extract(t, f"({OUTLINE})", 1))
    return (
        F.when(~t.rlike(OUTLINE), "")
        .when(m.rlike(r"^[A-Za-z][.)]"), "alpha")
        .when(m.rlike(r"^\(?[A-Za-z][.)]"), "alpha_paren")
        .when(m.rlike(r"^\d+(\.\d+)+"), "outline_decimal")
        .when(m.rlike(r"^\(?\d+[.)]"), "decimal")
        .when(m.rlike(r"^[•●○▪▫\-*]"), "bullet")
        .when(m.rlike(rf"^[{ZH_NUM}]+[、.]|^（?[{ZH_NUM}]+[）)]"), "zh_num")
        .when(m.rlike(r"^[ivxIVX]+[.)]"), "roman")
        .otherwise("other")
    )


def is_sentence_terminal(x: Column) -> Column:
    told = lambda t: (
        F.when(t == "", True)
        .when(F.lower(F.right(t, F.lit(9))).rlike(ABBREVIATION), False)  # longer than any abbreviation
        .when(F.right(t, F.lit(2)).rlike(r"(?:[:：—–]|--)$"), True)
        .otherwise(F.right(F.rtrim(t, F.lit("\"')]}”’")), F.lit(1)).isin(*".!?。！？"))
    )
    return let(F.rtrim(strip(x), F.lit(SPACE + "*_`")), told)


def has_open_paren(x: Column) -> Column:
    n = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return (n("(") > n(")")) | (n("[") > n("]"))


# What may follow a terminator, and what terminates.
CLOSING = "\"'”’»›」』)）]】}｝〉》>"
TERMINATORS = ".。!！?？…｡﹗﹖"


def is_terminated(x: Column) -> Column:
    """Ends in a terminator, closing quotes and brackets aside; blank texts don't."""
    core = F.rtrim(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit(CLOSING))
    return F.when(core == "", False).otherwise(core.endswith("...") | F.lit(TERMINATORS).contains(F.right(core, F.lit(1))))


def ends_with_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "").rlike(r"[\p{P}\p{S}]$")


def joined(a: Column, b: Column) -> Column:
    """Two paragraphs as one: new line after a terminator, space after no punctuation, else nothing between."""
    s, t = F.regexp_replace(a, r"(?U)\s+$", ""), F.regexp_replace(b, r"(?U)^\s+", "")
    return (
        F.when(s == "", t).when(t == "", s)
        .when(is_terminated(s), F.concat(s, F.lit("\n"), t))
        .when(~ends_with_punctuation(s), F.concat(s, F.lit(" "), t))
        .otherwise(F.concat(s, t))
    )


def repaired(x: Column) -> Column:
    """Lines of each paragraph joined, end-of-line hyphens dropped, runs of blanks collapsed."""

    def one(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), strip), lambda s: s != "")
        return F.aggregate(
            lines, F.lit(""), lambda a, s: F.when(a == "", s).when(a.endswith("-"), F.concat(F.left(a, F.length(a) - 1), s)).otherwise(F.concat(a, F.lit(" "), s))
        )

    return strip(F.regexp_replace(F.array_join(F.transform(F.split(x, "\n\n"), one), "\n\n"), "[ \t]+", " "))


def heading_level(x: Column) -> Column:
    """Level of a Markdown heading, 0 for others."""
    return F.when(strip(x).rlike(r"^#{1,6}\s+"), F.length(F.regexp_extract(strip(x), "^(#+)", 1))).otherwise(0)


def _words(x: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Common elements of two sets over the larger set; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def heading_parts(x: Column) -> Column:
    """What two headings are compared by: name (letters and digits in lower case), words and CJK characters of the text without marks."""
    plain = F.rtrim(F.ltrim(x, F.lit(SPACE + "#*_`")), F.lit(SPACE))
    parts = lambda c: F.struct(F.regexp_replace(c["low"], r"(?U)[\s\W_]+", "").alias("name"), _words(c["low"], r"[\p{L}\p{N}_]+").alias("words"), _words(c["own"], CJK).alias("chars"))
    return let(let(plain, lambda c: F.struct(c.alias("own"), F.lower(c).alias("low"))), parts)


def first_line(x: Column) -> Column:
    return F.split(x, "\r\n|[\n\r\u000b\u000c\u0085  ]", 2)[0]


def parts_similarity(a: Column, b: Column) -> Column:
    """How alike the heading_parts of two headings are, 0 to 1."""
    tn, bn, ct, cb = a["name"], b["name"], a["chars"], b["chars"]
    short, long = F.least(F.length(tn), F.length(bn)), F.greatest(F.length(tn), F.length(bn))
    words = overlap(a["words"], b["words"])
    chars = F.when((F.size(ct) >= 2) & (F.size(cb) >= 2), overlap(ct, cb))
    return (
        F.when(F.coalesce(tn, F.lit("")).eqNullSafe("") | F.coalesce(bn, F.lit("")).eqNullSafe(""), 0.0)
        .when(tn == bn, 1.0)
        .when((short >= 4) & (tn.contains(bn) | bn.contains(tn)) & (short / long >= 0.6), 0.8 + 0.2 * (short / long))
        .when(words >= 0.65, 0.65 + 0.35 * words)
        .when(chars >= 0.65, 0.65 + 0.35 * chars)
        .otherwise(0.0)
    )


def heading_similarity(title: Column, block: Column) -> Column:
    """How alike a title and a block's first line are, 0 to 1."""
    return let(F.struct(heading_parts(title).alias("t"), heading_parts(first_line(block)).alias("b")), lambda x: parts_similarity(x["t"], x["b"]))


def confidence(sim: Column, flagged: Column, formed: Column, on_page: Column) -> Column:
    """formed: whether the block has a heading's form."""
    bonus = F.when(flagged, 0.15).otherwise(0.0) + F.when(formed, 0.15).otherwise(0.0)
    return let(sim, lambda s: F.when(s < 0.5, 0.0).otherwise(F.least(s + bonus - F.when(on_page, 0.0).otherwise(0.15), F.lit(1.0))))


def heading_confidence(title: Column, block: Column, flagged: Column, on_page: Column) -> Column:
    return confidence(heading_similarity(title, strip(block)), flagged, is_heading(block), on_page)


def span_markdown(text: Column, flags: Column, font: Column) -> Column:
    """A span with its bold, italic or code marks; outer blanks stay outside."""
    f, name = F.coalesce(flags, F.lit(0)), F.lower(F.coalesce(font, F.lit("")))
    bold = (f.bitwiseAND(16) != 0) | name.rlike("bold|black|heavy")
    italic = (f.bitwiseAND(3) != 0) | name.rlike("italic|oblique")
    mono = (f.bitwiseAND(8) != 0) | name.rlike("mono|courier|consolas")
    s = strip(text)
    lead, tail = F.regexp_extract(text, r"(?U)^(\s*)", 1), F.regexp_extract(text, r"(?U)(\s*)$", 1)
    mark = F.when(mono & (F.length(s) > 1), "`").when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(F.coalesce(s, F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(lead, mark, s, mark, tail))


def size_heading_level(size: Column, body: Column, bold: Column, text: Column, listed: Column, caption: Column, body_follows: Column) -> Column:
    """Heading level from the ratio of font sizes, or for short bold lines from their form; 0 for body text."""
    r = size / body
    short = bold & (r >= 0.95) & (F.length(text) < 80) & ~listed & ~caption
    return (
        F.when(r >= 1.5, 1).when(r >= 1.25, 2).when(r >= 1.14, 3)
        .when(short & is_heading(text), 2).when(short & ~is_sentence_terminal(text) & ~body_follows, 3).otherwise(0)
    )


def dotted_heading_level(text: Column) -> Column:
    """Level of a numbered heading: one more than its dots plus one, five at most."""
    number = F.regexp_extract(strip(text), r"^(\d+(?:\.\d+)*)", 1)
    return F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 2, F.lit(5))


def rect_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def percent(done: Column, total: Column) -> Column:
    """Whole percent, truncated."""
    return F.floor(done * 100 / F.greatest(total, F.lit(1))).cast("int")


def html_inline(x: Column) -> Column:
    """Escaped text with bold, italic, code and line breaks as HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    x = F.regexp_replace(x, r"\*(.+?)\*", "<em>$1</em>")
    x = F.regexp_replace(x, r"`(.+?)`", "<code>$1</code>")
    return F.replace(x, F.lit("\n"), F.lit("<br>"))


def seo_clean(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"[*_`#\[\]]", ""), r"(?U)\s+", " "))


def clipped(x: Column, n: int, mark: str) -> Column:
    """x cut to n characters with a mark that says so."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(mark))).otherwise(x)


def split_tags(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(x, F.lit("，"), F.lit(",")), ","), strip), lambda t: t != "")


def natural_key(x: Column) -> Column:
    """Sort key that orders digits by value: runs of digits padded to 18 places, letters in lower case."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 18, "0")).otherwise(p)), "")


def page_numbers(ranges: Column, pages: Column) -> Column:
    """Ascending pages of `1-3,5`; all of them for blank, `all` and `*`; the first five where nothing is valid."""
    parts = F.filter(F.transform(F.split(ranges, ","), strip), lambda p: p != "")
    span = lambda p: F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 1).try_cast("int")
    end = lambda p: F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", 2).try_cast("int")

    def one(p: Column) -> Column:
        a, b = span(p), end(p)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), pages)
        single = p.try_cast("int")
        return (
            F.when(a.isNotNull() & b.isNotNull() & (low <= high), F.sequence(low, high))
            .when(p.rlike(r"^\d+$") & single.between(1, pages), F.array(single))
            .otherwise(F.array().cast("array<int>"))
        )

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one))))
    every = F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    whole = F.coalesce(strip(F.lower(ranges)), F.lit("")).isin("", "all", "全部", "*")
    return F.when(whole, every).when(F.size(found) > 0, found).otherwise(F.slice(every, 1, 5))


def anki_checksum(x: Column) -> Column:
    """First four bytes of the SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(x.cast("binary")), 1, 8), 16, 10).cast("long")


def anki_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    paras = F.filter(F.split(x, "\n\n"), lambda p: strip(p) != "")
    inner = F.transform(paras, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(F.size(inner) > 0, F.array_join(inner, "")).otherwise(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit("<br>")))


def anki_guid(x: Column) -> Column:
    """Ten base-62 characters from the content (the content's hash instead of a random number)."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    byte = lambda i: F.conv(F.substring(F.sha2(x.cast("binary"), 256), 2 * i + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.substring(F.lit(digits), (byte(i) % 62 + 1), F.lit(1)) for i in range(10)))


def numbered_cloze(x: Column) -> Column:
    """{{word}} as {{c1::word}}, {{c2::word}} ...; texts that have such numbers stay."""
    plain = r"\{\{([^{}]+?)\}\}"
    both = F.arrays_zip(F.split(x, plain).alias("rest"), F.regexp_extract_all(x, F.lit(plain), F.lit(1)).alias("found"))  # once a text, not once a cloze
    cloze = lambda word, i: F.when(word.isNull(), "").otherwise(F.concat(F.lit("{{c"), (i + 1).cast("string"), F.lit("::"), word, F.lit("}}")))
    made = F.array_join(F.transform(both, lambda p, i: F.concat(p["rest"], cloze(p["found"], i))), "")
    return F.when(x.rlike(r"\{\{c\d+::"), x).otherwise(made)


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N} ._\-]", "")


# Forms of document ids and image names.
DOC_ID, IMAGE_NAME = r"^[A-Za-z0-9_-]+$", r"(?is)^.+\.(png|jpg|jpeg|webp|gif|bmp|svg)$"


def is_valid_doc_id(x: Column) -> Column:
    return F.coalesce(x.rlike(DOC_ID) & ~x.contains("\n"), F.lit(False))


def is_valid_image_name(x: Column) -> Column:
    """Names without folders or dots that lead out of one, with an image's extension."""
    s = strip(x)
    return F.coalesce(~s.rlike(r"[/\\]|\.\.") & s.rlike(IMAGE_NAME), F.lit(False))


def mask_secret(x: Column) -> Column:
    s = strip(x)
    return F.when(F.coalesce(s, F.lit("")) == "", "").when(F.length(s) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(s, F.lit(4))))


def is_masked(x: Column) -> Column:
    return F.coalesce(x.contains("****") | (F.regexp_count(x, F.lit(r"\*")) >= 4), F.lit(False))


# Names of settings that hold credentials.
SENSITIVE = ("api_key", "secret", "token", "password", "key", "auth_token", "api_token", "secret_key", "access_token", "credential", "credentials")


def is_sensitive_key(x: Column) -> Column:
    k = F.trim(F.lower(x))
    return F.coalesce(k.isin(*SENSITIVE) | _any_of([k.endswith("_" + s) for s in SENSITIVE]) | k.rlike("^(api_key|auth|secret)_"), F.lit(False))


def redacted(x: Column) -> Column:
    """Free text without keys and bearer tokens."""
    return F.regexp_replace(F.regexp_replace(x, r"sk-[A-Za-z0-9_\-]{8,}", "sk-****"), r"(?i)(bearer\s+)[A-Za-z0-9._\-]{8,}", "$1****")


def merge_settings(incoming: Column, existing: Column) -> Column:
    """Map upsert that keeps existing secrets where the incoming value is blank or masked."""
    keep = lambda k, v: is_sensitive_key(k) & (F.coalesce(v, F.lit("")).eqNullSafe("") | is_masked(v))
    return F.map_zip_with(
        incoming, existing,
        lambda k, v, w: F.when(F.array_contains(F.map_keys(incoming), k), F.when(keep(k, v), F.coalesce(w, F.lit(""))).otherwise(v)).otherwise(w),
    )


def masked_settings(settings: Column) -> Column:
    return F.transform_values(settings, lambda k, v: F.when(is_sensitive_key(k), mask_secret(v)).otherwise(v))


def cookies(x: Column) -> Column:
    """`k=v; k=v` as a map, the last of equal names; parts without = are dropped."""
    parts = F.filter(F.transform(F.split(x, ";"), strip), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    last = F.filter(pairs, lambda a, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda b: b["k"] == a["k"]))
    return F.map_from_entries(last)


def cut_answer_json(x: Column) -> Column:
    """The JSON object in a model's answer: no thinking, the fenced block if there is one, then the outermost braces."""
    plain = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(plain, r"(?s)(\{.*\})", 1))


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp")
        .when(ext == "svg", "image/svg+xml").when(ext == "bmp", "image/bmp").otherwise("image/png")
    )


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_of(path), F.lit(";base64,"), F.base64(content))


def asset_name(url: Column) -> Column:
    """Local name of a downloaded asset: cleaned stem, first eight digits of the URL's MD5, extension."""
    base = F.regexp_extract(F.substring_index(F.substring_index(url, "#", 1), "?", 1), "([^/]*)$", 1)
    ext = F.regexp_extract(base, r"(\.[A-Za-z0-9]{1,5})$", 1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", ""), r"[^A-Za-z0-9_\-]", "_")
    return F.concat(F.when(stem == "", "image").otherwise(stem), F.lit("_"), F.left(F.md5(url.cast("binary")), F.lit(8)), F.when(ext == "", ".png").otherwise(ext))
