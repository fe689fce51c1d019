"""Laid-out documents to chapters, against a plain reading of all documents."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_layout import merge_table_boxes

from lectern import catalog
from lectern.functions import text as T
from lectern.operators import pages as P
from lectern.operators import structure as S
from lectern.plans import pages as plans
from lectern.sources import derive as D

SF = "/root/testdata/sf0.001"


class Facts:
    """What the rules on single texts say, asked of Spark for many texts at once."""

    RULES = {"listed": T.is_list_item, "kind": T.list_type, "caption": T.is_caption, "terminal": T.is_sentence_terminal, "heading": T.is_heading}

    def __init__(self, spark):
        self.spark, self.known = spark, {}

    def ask(self, texts):
        new = sorted(set(texts) - self.known.keys())
        if new:
            df = self.spark.createDataFrame([(t,) for t in new], "t string")
            for r in df.select("t", *(f(F.col("t")).alias(k) for k, f in self.RULES.items())).collect():
                self.known[r.t] = r

    def __getattr__(self, rule):
        return lambda t: self.known[t][rule]


def bare(t):
    return re.sub(r"[*_`\s]+$", "", t.strip())


def lines_of(spans):
    out = []
    for s in sorted((s for s in spans if s["text"]), key=lambda s: (s["y0"], s["x0"], s["x1"], s["text"].encode())):
        if not out or (s["y0"] + s["y1"]) / 2 >= max(x["y1"] for line in out for x in line):
            out.append([])
        out[-1].append(s)
    lines = []
    for line in out:
        line.sort(key=lambda s: (s["x0"], s["y0"], s["text"].encode()))
        solid = [(len(re.sub(r"\s", "", s["text"])), s["flags"] & 16 or "bold" in s["font"].lower()) for s in line]
        n = sum(k for k, _ in solid)
        lines.append({
            "text": "".join(s["text"] for s in line).strip(), "size": max(s["size"] for s in line), "bold": n > 0 and sum(k for k, b in solid if b) / n >= 0.85,
            "x0": min(s["x0"] for s in line), "y0": min(s["y0"] for s in line), "x1": max(s["x1"] for s in line), "y1": max(s["y1"] for s in line),
        })
    return [x for x in lines if x["text"]]


def covered(b, tables):
    for t in tables:
        w, h = min(b["x1"], t[2]) - max(b["x0"], t[0]), min(b["y1"], t[3]) - max(b["y0"], t[1])
        if w > 0 and h > 0 and w * h > 0.6 * (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]):
            return True
    return False


def median(xs):
    xs = sorted(xs)
    return None if not xs else xs[len(xs) // 2] if len(xs) % 2 else (xs[len(xs) // 2 - 1] + xs[len(xs) // 2]) / 2


def paragraphs_of(lines, body, facts):
    """(content, x0, y0, level, kind) of a page's lines."""
    pitch = median([b["y0"] - a["y0"] for a, b in zip(lines, lines[1:], strict=False) if 8 < b["y0"] - a["y0"] < 80]) or 1.35 * body
    for i, x in enumerate(lines):
        t, r = x["text"], x["size"] / body
        nxt = lines[i + 1] if i + 1 < len(lines) else None
        follows = nxt is not None and not nxt["bold"] and nxt["size"] < 1.14 * body and nxt["y0"] - x["y0"] <= 1.5 * pitch
        short = x["bold"] and r >= 0.95 and len(t) < 80 and not facts.listed(t) and not facts.caption(t)
        x["level"] = 1 if r >= 1.5 else 2 if r >= 1.25 else 3 if r >= 1.14 else 2 if short and facts.heading(t) else 3 if short and not facts.terminal(t) and not follows else 0
        x["kind"] = facts.kind(t) if facts.listed(t) and not x["level"] else ""
        x["listed"] = facts.listed(t) and not x["level"]
    groups = []
    for x in lines:
        joins = False
        if groups and not x["level"]:
            g, last = groups[-1], groups[-1][-1]
            text, gap = "".join(y["text"] for y in g), (x["y0"] - last["y0"]) / pitch
            if g[0]["level"]:
                joins = all(re.search(r"[-,(\[{—]$", bare(y["text"])) for y in g)
            elif not facts.caption(g[0]["text"]):
                opened = text.count("(") > text.count(")") or text.count("[") > text.count("]")
                joins = (
                    (opened and gap <= 2.5) or (not facts.terminal(last["text"]) and not x["listed"] and gap <= 2.2)
                    or (last["text"].endswith((":", "：")) and gap <= 1.4 and not facts.caption(x["text"])) or (gap <= 1.35 and not x["listed"] and not facts.caption(x["text"]))
                )
        if joins:
            groups[-1].append(x)
        else:
            groups.append([x])
    items = []
    for g in groups:
        content = g[0]["text"]
        for x in g[1:]:
            content = content[:-1] + x["text"] if content.endswith("-") else content + " " + x["text"]
        items.append([content, g[0]["x0"], g[-1]["y0"], g[0]["level"], g[0]["kind"], facts.caption(g[0]["text"]), g[0]["listed"]])
    out = []
    family = lambda k: "decimal" if k == "outline_decimal" else k
    last_kind = ""
    for it in items:
        if out and it[4] and family(it[4]) == family(last_kind):
            out[-1][0] += "\n" + it[0]
            out[-1][2] = it[2]
        else:
            out.append(it)
        last_kind = it[4]
    for it in out:
        if it[3]:
            it[0] = "#" * it[3] + " " + re.sub(r"^[#\s]+", "", it[0]).strip()
        elif it[5] and not (it[0].strip().startswith("**") and it[0].strip().endswith("**")):
            it[0] = f"**{it[0].strip()}**"
    return out


def stitched(items, facts):
    facts.ask([bare(x["content"]) for x in items])
    out, prev = [], None
    for x in items:
        body = x["type"] == "text" and not x["level"] and not x["listed"]
        item = x["listed"] and not x["level"]
        if prev and prev["page"] != x["page"]:
            was_body = prev["type"] == "text" and not prev["level"] and not prev["listed"]
            if was_body and not facts.terminal(bare(prev["content"])) and body:
                a, b = out[-1]["content"], x["content"].strip()
                end = bare(a)
                out[-1]["content"] = re.sub(r"-\s*$", "", a.strip()) + b if re.search(r"\w-\s*$", end) else a.strip() + b if re.search(T.CJK + "$", end) else a.strip() + " " + b
                prev = x
                continue
            if prev["listed"] and not prev["level"] and item and prev["kind"] == x["kind"]:
                out[-1]["content"] += "\n" + x["content"]
                prev = x
                continue
        out.append(dict(x))
        prev = x
    return out


def targets_of(toc, blocks, n_pages, facts):
    if toc:
        low = min(t["level"] for t in toc)
        below = [t["level"] for t in toc if t["level"] > low]
        if sum(t["level"] == low for t in toc) == 1 and below:
            low = min(below)
        used = [t for t in sorted(toc, key=lambda t: t["n"]) if t["level"] == low]
        return [(t["title"].strip(), 1 if not i else max(1, t["page"]), None) for i, t in enumerate(used)]
    found = []
    if n_pages >= 6:
        clean = [re.sub(r"^[#\s]+", "", b["content"].strip()).strip() for b in blocks]
        facts.ask(clean)
        for i, b in enumerate(blocks):
            if 1 <= b["level"] <= 2 and facts.heading(clean[i]) and (not found or (i - found[-1][2] >= 4 and b["page"] - found[-1][1] >= 1)):
                found.append((clean[i], b["page"], i))
    if len(found) >= 2:
        return [(found[0][0], 1, 0), *found[1:]]
    return [("Document Body", 1, 0)]


def plain(spark, tables):
    spans, pages, boxes, images, toc = tables
    facts = Facts(spark)
    by = lambda rows, *keys: {k: [r for r in v] for k, v in _grouped(rows, keys).items()}
    of_page = by(spans, "doc_id", "page")
    lines = {k: lines_of(v) for k, v in of_page.items()}
    facts.ask([x["text"] for v in lines.values() for x in v])
    merged = {k: merge_table_boxes([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in v]) for k, v in by(boxes, "doc_id", "page").items()}
    height = {(p["doc_id"], p["page"]): p["height"] for p in pages}
    running, kept = Counter(), defaultdict(list)
    for key, own in lines.items():
        for x in own:
            if not covered(x, merged.get(key, [])):
                h = height.get(key)
                x["band"] = None if h is None else "top" if x["y0"] < 0.11 * h else "bottom" if x["y1"] > 0.89 * h else None
                number = x["band"] and re.match(S.PAGE_NUMBER.replace("(?i)", ""), x["text"], re.IGNORECASE)
                kept[key].append((x, number))
                if x["band"] and key[1] <= 80 and len(x["text"]) <= 120:
                    running[key[0], x["band"], x["text"]] += 1
    sizes = {}
    for doc, own in by(spans, "doc_id").items():
        count, first = Counter(), {}
        for i, s in enumerate(sorted((s for s in own), key=lambda s: (s["page"], s["y0"], s["x0"], s["x1"], s["text"].encode()))):
            if s["page"] <= 25 and not s["flags"] & 16 and s["text"].strip():
                count[round(s["size"], 1)] += len(s["text"].strip())
                first.setdefault(round(s["size"], 1), i)
        sizes[doc[0]] = max(count, key=lambda k: (count[k], -first[k])) if count else None
    out = []
    docs = {d for d, _ in lines} | {i["doc_id"] for i in images} | {b["doc_id"] for b in boxes}
    pictures, tocs, of_images = Counter(), by(toc, "doc_id"), by(images, "doc_id", "page")
    for doc in docs:
        items = []
        for page in sorted({p for d, p in [*lines, *merged, *of_images] if d == doc}):
            key = (doc, page)
            body = [x for x, number in kept[key] if not number and not (x["band"] and running[doc, x["band"], x["text"]] >= 2)]
            here = [(t[1], 0, t[0], i, f"![Table {i}](images/tbl_p{page:03d}_{i:04d}.png)", "image", 0, False, "") for i, t in enumerate(merged.get(key, []), 1)]
            for im in sorted(of_images.get(key, []), key=lambda i: (i["y0"], i["x0"], i["src"])):
                if not covered(im, merged.get(key, [])):
                    pictures[doc] += 1
                    here.append((im["y0"], 1, im["x0"], pictures[doc], f"![Figure {pictures[doc]}]({im['src']})", "image", 0, False, ""))
            for n, (content, x0, y0, level, kind, _, listed) in enumerate(paragraphs_of(body, sizes[doc] or max((x["size"] for x in body), default=11), facts) if body else []):
                here.append((y0, 2, x0, n, content, "text", level, listed, kind))
            items += [{"page": page, "content": c, "type": t, "level": lv, "listed": li, "kind": k} for _, _, _, _, c, t, lv, li, k in sorted(here)]
        blocks = stitched(items, facts)
        if not blocks:
            continue
        targets = targets_of(tocs.get((doc,), []), blocks, sum(p["doc_id"] == doc for p in pages), facts)
        pairs = [(k, i, t[0], b["content"], b["level"] > 0, b["page"] == t[1]) for k, t in enumerate(targets) for i, b in enumerate(blocks) if len(targets) > 1 and abs(b["page"] - t[1]) <= 1]
        scores = {}
        if pairs:
            df = spark.createDataFrame(pairs, "k int, i int, t string, c string, h boolean, p boolean")
            scores = {(r.k, r.i): r.s for r in df.select("k", "i", T.heading_confidence(F.col("t"), F.col("c"), F.col("h"), F.col("p")).alias("s")).collect()}
        splits = S.choose_splits(len(blocks), targets, [b["page"] for b in blocks], lambda k, i, _, scores=scores: scores.get((k, i)) or 0.0)
        starts = dict(splits)
        no, title = 0, None
        for i, b in enumerate(blocks):
            if i in starts:
                no, title = no + 1, starts[i]
            out.append((doc, no, f"ch_{no:03d}", title, f"p_{no:03d}_{i + 1:04d}", b["page"], b["type"], b["content"]))
    return sorted(out)


def _grouped(rows, keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def test_all_documents(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    tables = [con.execute(f"select * from {D.duck(sql)} t").to_arrow_table().to_pylist() for sql in (plans.SPANS, plans.PAGES, plans.BOXES, plans.IMAGES, plans.TOC)]
    got = sorted(tuple(r) for r in catalog.queries()["laid_out_chapters"](spark, SF).collect())
    want = plain(spark, tables)
    assert len(got) > 1000 and max(r[1] for r in got) > 1
    assert [r for r in got if r not in set(want)][:3] == [r for r in want if r not in set(got)][:3] == []
    assert got == want


SCHEMAS = (
    "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int, font string", "doc_id int, page int, height double",
    "doc_id int, page int, x0 double, y0 double, x1 double, y1 double", "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, src string", "doc_id int, n int, level int, title string, page int",
)


def frames(spark, *tables):
    return [spark.createDataFrame(rows, s) for rows, s in zip(tables, SCHEMAS, strict=True)]


def test_order_of_items_and_strict_headings(spark):
    spans, pages = [], []
    for page in range(1, 8):
        pages.append((1, page, 1000.0))
        spans.append((1, page, 50.0, 200.0, 300.0, 212.0, f"Chapter {page} Title of it" if page % 2 else "plain start", 16.5 if page % 2 else 11.0, 0, "Serif"))
        spans += [(1, page, 50.0, 200.0 + 100 * i, 300.0, 212.0 + 100 * i, f"Sentence {i} of page {page}.", 11.0, 0, "Serif") for i in range(1, 5)]
    tables = frames(spark, spans, pages, [(1, 2, 50.0, 200.0, 60.0, 201.0)], [(1, 2, 40.0, 200.0, 45.0, 201.0, "a.png"), (1, 3, 10.0, 900.0, 20.0, 905.0, "b.png")], [])
    rows = P.document_chapters(*tables).orderBy("id").collect()
    chapters = {r.chapter_no: r.title for r in rows}
    assert chapters == {1: "Chapter 1 Title of it", 2: "Chapter 3 Title of it", 3: "Chapter 5 Title of it", 4: "Chapter 7 Title of it"}
    second = [r.content for r in rows if r.page == 2]
    assert second[:3] == ["![Table 1](images/tbl_p002_0001.png)", "![Figure 1](a.png)", "plain start"]
    assert [r.content for r in rows if r.page == 3][-1] == "![Figure 2](b.png)"
    assert sorted(tuple(r) for r in rows) == plain(spark, [[r.asDict() for r in t.collect()] for t in tables])


@pytest.mark.parametrize("rows", [[], [(1, 1, 0.0, 0.0, 1.0, 1.0, "", 1.0, 0, "f")], [(1, 1, 0.0, 5.0, 9.0, 9.0, "Alone", 11.0, 0, "f"), (1, 1, 0.0, 5.0, 9.0, 9.0, "Alone", 11.0, 0, "f")]])
def test_little_documents(spark, rows):
    got = P.document_chapters(*frames(spark, rows, [], [], [], [])).collect()
    assert [r.content for r in got] == (["AloneAlone"] if len(rows) == 2 else [])
