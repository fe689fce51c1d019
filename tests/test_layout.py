"""Folds over the lines and blocks of a page, against plain readings in Python."""

import re
from collections import defaultdict

from lectern import catalog
from lectern.functions import text as T
from lectern.operators import structure
from lectern.plans import structure as plans

SF = "/root/testdata/sf0.001"


def fold_short_blocks(rows: list[tuple[int, str, str, bool, bool]]) -> list[tuple[int, str, str]]:
    """Merges broken blocks of one page: (page, type, content, structural, terminal) to (page, type, content).

    First pass: a plain block that doesn't end a sentence takes the next plain one; second pass: so does one of under 140 characters
    or 22 words. Structural blocks are never merged, nor are blocks of two pages.
    """
    def glued(a: str, b: str) -> str:
        return a[:-1] + b if a.endswith("-") else f"{a} {b}"

    def run(items, wants):
        out = []
        for page, kind, content, structural, terminal in items:
            if out:
                p, k, c, s, t = out[-1]
                if p == page and k == kind == "text" and not s and not structural and wants(c, t):
                    out[-1] = (p, k, glued(c, content), s, terminal)
                    continue
            out.append((page, kind, content, structural, terminal))
        return out

    first = run(rows, lambda c, t: not t)
    second = run(first, lambda c, t: len(c) < 140 or len(re.findall(r"\S+", c)) < 22)
    return [(p, k, c) for p, k, c, _, _ in second]


def merge_table_boxes(boxes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Boxes by y0, x0, each joined to the one before if they overlap, or if over 65 percent of the width is common and the gap is under 80."""
    out: list[tuple[float, float, float, float]] = []
    for b in sorted(boxes, key=lambda r: (r[1], r[0])):
        if out:
            a = out[-1]
            common, width = min(a[2], b[2]) - max(a[0], b[0]), max(a[2], b[2]) - min(a[0], b[0])
            touches = common > 0 and min(a[3], b[3]) > max(a[1], b[1])
            if touches or (width > 0 and common / width > 0.65 and b[1] - a[3] < 80):
                out[-1] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                continue
        out.append(b)
    return out


def join_lines(lines: list[dict], pitch: float) -> list[str]:
    """Lines of a page (text, y0, is_heading, is_list, is_caption, terminal) as paragraphs.

    The gap to the line before, in line pitches, decides with the accumulated text: up to 2.5 inside an open bracket, up to 2.2 in an
    unfinished sentence that no list item follows, up to 1.4 after a colon, up to 1.35 otherwise before what isn't a list item.
    A heading opens a paragraph; a caption ends one, and under the last two rules opens one too.
    """
    out: list[list] = []
    for line in lines:
        text = line["text"]
        if out:
            prev = out[-1]
            so_far, last = prev[0], prev[1]
            gap = (line["y0"] - last["y0"]) / pitch if pitch else 0.0
            open_ = so_far.count("(") > so_far.count(")") or so_far.count("[") > so_far.count("]")
            colon = so_far.rstrip().endswith((":", "："))
            free = not line["is_heading"] and not last["is_heading"] and not last["is_caption"]
            if free and (
                (open_ and gap <= 2.5)
                or (not last["terminal"] and not line["is_list"] and gap <= 2.2)
                or (colon and gap <= 1.4 and not line["is_caption"])
                or (gap <= 1.35 and not line["is_list"] and not line["is_caption"])
            ):
                out[-1] = [so_far[:-1] + text if so_far.endswith("-") else f"{so_far} {text}", line]
                continue
        out.append([text, line])
    return [t for t, _ in out]


def test_plain_readings():
    assert merge_table_boxes([(0, 0, 10, 10), (0, 50, 10, 60), (0, 200, 10, 210), (5, 205, 30, 220)]) == [(0, 0, 10, 60), (0, 200, 30, 220)]
    line = lambda t, y, **k: {"text": t, "y0": y, "is_heading": False, "is_list": False, "is_caption": False, "terminal": t.endswith("."), **k}
    assert join_lines([line("A (open", 0), line("closed).", 25), line("Next", 60), line("goes on.", 81), line("Head", 95, is_heading=True), line("- item", 105, is_list=True)], 10) == ["A (open closed).", "Next goes on.", "Head", "- item"]
    assert fold_short_blocks([(1, "text", "a b-", False, False), (1, "text", "c.", False, True), (1, "heading", "H", True, False), (2, "text", "x.", False, True), (2, "text", "y.", False, True)]) == [(1, "text", "a bc."), (1, "heading", "H"), (2, "text", "x. y.")]


def by_document(rows, key, order):
    out = defaultdict(list)
    for r in sorted(rows, key=order):
        out[key(r)].append(r)
    return out


def test_short_blocks(spark):
    c = plans._C
    rows = plans.D.lines(spark, SF).select("doc_id", "ord", plans.F.floor(c("ord") / 6).cast("int").alias("page"), c("raw").alias("t"))
    flags = rows.select("*", T.block_type(c("t")).alias("type"), T.is_structural(c("t")).alias("structural"), T.is_sentence_terminal(c("t")).alias("terminal")).collect()
    got = by_document(catalog.queries()["merge_short_blocks"](spark, SF).collect(), lambda r: r.doc_id, lambda r: r.n)
    for doc, mine in by_document(flags, lambda r: r.doc_id, lambda r: r.ord).items():
        want = fold_short_blocks([(r.page, r.type, r.t, r.structural, r.terminal) for r in mine])
        assert [(r.page, r.type, r.content) for r in got[doc]] == want and [r.n for r in got[doc]] == list(range(len(want)))


def test_table_boxes(spark):
    import duckdb

    boxes = duckdb.sql(f"select l_orderkey, (l_quantity % 7) * 5.0 as x0, l_linenumber * 60.0 as y0, x0 + l_quantity as x1, y0 + l_partkey % 70 as y1 from '{SF}/lineitem.parquet'").fetchall()
    got = by_document(catalog.queries()["table_boxes"](spark, SF).collect(), lambda r: r.l_orderkey, lambda r: r.n)
    for key, mine in by_document(boxes, lambda r: r[0], lambda r: r[1:]).items():
        assert [(r.x0, r.y0, r.x1, r.y1) for r in got[key]] == merge_table_boxes([tuple(map(float, r[1:])) for r in mine])
    assert sum(map(len, got.values())) < len(boxes)


def test_layout_paragraphs(spark):
    lines = plans._laid_out(spark, SF)
    c = plans._C
    told = lines.select("*", T.is_list_item(c("text")).alias("li"), T.is_bullet(c("text")).alias("bu"), T.is_caption(c("text")).alias("is_caption"), T.is_sentence_terminal(c("text")).alias("terminal"), T.is_heading(c("text")).alias("form")).collect()
    pages = by_document(told, lambda r: (r.doc_id, r.page), lambda r: r.ord)
    running = defaultdict(int)
    for r in told:
        if r.band and r.page <= 80 and len(r.text) <= 120:
            running[r.doc_id, r.band, r.text] += 1
    got = by_document(catalog.queries()["layout_paragraphs"](spark, SF).collect(), lambda r: (r.doc_id, r.page), lambda r: r.n)
    number = re.compile(structure.PAGE_NUMBER.replace("(?i)", ""), re.IGNORECASE)
    n = 0
    for key, mine in pages.items():
        body = [r for r in mine if not (r.band and (number.match(r.text) or running[r.doc_id, r.band, r.text] >= 2))]
        if not body:
            assert key not in got
            continue
        steps = sorted(b.y0 - a.y0 for a, b in zip(body, body[1:], strict=False) if 8 < b.y0 - a.y0 < 80)
        half = len(steps) // 2
        pitch = 1.35 * 11 if not steps else steps[half] if len(steps) % 2 else (steps[half - 1] + steps[half]) / 2
        rows = []
        for i, r in enumerate(body):
            listed, ratio = r.li or r.bu, r.size / 11
            follows = i + 1 < len(body) and not body[i + 1].bold and body[i + 1].size < 1.14 * 11
            short = r.bold and len(r.text) < 80 and not listed and not r.is_caption
            head = ratio >= 1.14 or (short and (r.form or (not r.terminal and not follows)))
            rows.append({"text": r.text, "y0": r.y0, "is_heading": head, "is_list": listed, "is_caption": r.is_caption, "terminal": r.terminal})
        assert [r.text for r in got[key]] == join_lines(rows, pitch), key
        n += len(body) - len(got[key])
    assert n > 100
