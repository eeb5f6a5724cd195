"""Queries of ids, images, tables, replies, boxes and the smaller store operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import numeric, text
from lodestone.operators import catalog, chunking, evaluation, filters, hybrid, index, response, store, traces
from lodestone.plans import tables as t
from lodestone.plans.measures import _traces
from lodestone.plans.retrieval import POSTINGS, _r
from lodestone.plans.texts import _SECTIONS, _sections

#: First bytes of files, as hexadecimal digits.
HEADS = ["89504E470D0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "524946460000000057415645", "424D0000", "", "00"]
FEED = "Wheat from   FRANCE, steel from\nGermany; and oil from the united  states."


def _text(column):
    return F.col(column).cast("string")


def _list(values, key: str):
    """One of the values, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def q_mime_types(spark, d):
    """Suppliers stand in for files: some with an extension, all with first bytes."""
    path = F.concat(F.lit("dir.x/f"), _list(["", ".PNG", ".jpeg", ".gif", ".bin", ".webp", ".bmp"], "s_suppkey"))
    return t.table(spark, d, "supplier").select("s_suppkey", numeric.mime_type(path, F.unhex(_list(HEADS, "s_suppkey"))).alias("mime"))


def q_scaled_sizes(spark, d):
    size = numeric.scaled_size(F.col("p_size").cast("double"), (F.col("p_partkey") % 97 + 1).cast("double"), 20)
    return t.table(spark, d, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


def q_boxes(spark, d):
    """Boxes from two balances: whether they are large enough, and measured from the other end of the page."""
    b = F.col("c_acctbal")
    box = F.struct(b.alias("x0"), (b / 4).alias("top"), (b * F.lit(1.01)).alias("x1"), (b / 4 + F.col("c_nationkey") * 4).alias("bottom"))
    flipped = numeric.flip_box(box, F.lit(10_000.0))
    return t.table(spark, d, "customer").select("c_custkey", numeric.box_size_ok(box).alias("large"), F.round(flipped["top"], 4).alias("top"), F.round(flipped["bottom"], 4).alias("bottom"))


def q_elapsed(spark, d):
    spans = t.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("string").alias("a"), F.max("ts").cast("string").alias("b"))
    return spans.select("user_id", traces.elapsed(F.col("a"), F.col("b")).alias("ms"))


def q_version_stamp(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", numeric.version_stamp(F.col("n_nationkey"), F.col("n_name")).alias("stamp"))


def q_ids(spark, d):
    c = F.col
    return t.table(spark, d, "documents").select(
        "doc_id", numeric.draft_chunk_id(_text("doc_id"), (c("doc_id") % 10_000).cast("int"), c("text")).alias("draft"),
        numeric.image_id(F.sha2("text", 256), c("doc_id") % 7, c("n_chars")).alias("image"))


def q_first_title(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.first_title(F.col("text")).alias("title"))


def q_document_title(spark, d):
    c = F.col
    stated = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("  "), "lang", F.lit(" title "))).otherwise("")
    body = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("intro\n# Head of "), "source", F.lit(" \nmore"))).otherwise(c("source"))
    return t.table(spark, d, "documents").select("doc_id", text.document_title(body, stated, F.concat(F.lit("a\\b/"), "source", F.lit("-x_y.md"))).alias("title"))


def q_grids(spark, d):
    grid = F.array(F.array(F.lit(" name"), F.lit("key")), F.array(F.col("n_name"), _text("n_nationkey")), F.array(F.lit(" x "), F.lit(None).cast("string"), F.lit("more")))
    return t.table(spark, d, "nation").select("n_nationkey", text.grid_html(grid).alias("html"), text.grid_plain(grid).alias("plain"))


def q_html_tables(spark, d):
    html = F.concat(F.lit(" <table><tr><th>Name</th><th class='k'>Key</th></tr><TR><td> <b>"), "n_name", F.lit("</b> | x</td></TR><tr><td>"), _text("n_nationkey"), F.lit("</td><td>y</td></tr></table>"))
    shown = text.table_snippet(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, html).otherwise(""))
    return t.table(spark, d, "nation").select("n_nationkey", text.html_table_markdown(html).alias("markdown"), shown.alias("shown"))


def q_image_placeholders(spark, d):
    body = F.concat(F.lit("A [IMAGE: "), _text("p_partkey"), F.lit("] b [IMAGE:x"), _text("p_size"), F.lit("] and [IMAGE: "), _text("p_partkey"), F.lit("]"))
    captions = F.create_map(_text("p_partkey"), F.col("p_name"))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(text.image_ids(body), "|").alias("ids"), text.stitch_captions(body, captions).alias("stitched"))


def q_table_summaries(spark, d):
    kind = F.when(F.length("text") % 5 == 0, "table").otherwise("text")
    summary = F.when(F.col("role") == "user", F.concat(F.lit("said in turn "), _text("turn"))).otherwise("")
    return t.table(spark, d, "conversations").select("conv_id", "turn", text.with_table_summary(F.col("text"), summary, kind).alias("text"))


def q_formulas(spark, d):
    n = F.col("p_name")
    wrapped = [F.concat(F.lit("$$ "), n, F.lit(" $$")), F.concat(F.lit(" \\[ "), n, F.lit("\\] ")), F.concat(F.lit("```latex\n"), n, F.lit("\n```")), F.concat(F.lit("$"), n, F.lit("$")), F.concat(F.lit("\\("), n, F.lit(" \\)")), n]
    return t.table(spark, d, "part").select("p_partkey", text.clean_latex(F.element_at(F.array(*wrapped), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("formula"))


def q_enrichment_replies(spark, d):
    reply = F.concat(F.lit("Title:  "), "p_name", F.lit(" \nsummary: about "), "p_type", F.lit("\nTAGS: a, ,"), "p_brand")
    found = text.parse_enrichment(F.when(F.col("p_partkey") % 4 > 0, reply).otherwise("no fields here"))
    return t.table(spark, d, "part").select("p_partkey", found["title"].alias("title"), found["summary"].alias("summary"), F.array_join(found["tags"], "|").alias("tags"))


def q_model_scores(spark, d):
    """A model's replies score the turns of a conversation; every seventh reply is no list, and some name unknown passages."""
    turns = t.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), _text("turn").alias("chunk_id"), F.col("turn").alias("rank"))
    score = ((F.col("rank") * 37 + F.col("query_id")) % 11).cast("double")
    listed = F.to_json(F.array_append(F.collect_list(F.struct(F.col("chunk_id").alias("passage_id"), score.alias("score"))), F.struct(F.lit("unknown").alias("passage_id"), F.lit(99.0).alias("score"))))
    fenced = F.when(F.col("query_id") % 2 == 0, listed).otherwise(F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
    replies = turns.groupBy("query_id").agg(F.when(F.col("query_id") % 7 == 0, "I cannot tell").otherwise(fenced).alias("reply"))
    found = hybrid.rerank(turns, hybrid.model_scores(replies), top_k=3)
    return found.select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


def q_list_items(spark, d):
    body = F.concat(F.lit("intro\n- "), "lang", F.lit("\n  2. "), "source", F.lit("\nmore of it\n* x 3.4"))
    return t.table(spark, d, "documents").select("doc_id", F.array_join(chunking.list_items(body), "¦").alias("items"))


def q_whole_sections(spark, d):
    """Sections so short for the size that each segment is one chunk."""
    rows = chunking.chunks(chunking.segments(_sections(spark, d)), size=1_000_000, overlap=0)
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "section_type", "text")


def q_layout_chunks(spark, d):
    headings = F.when(F.col("turn") % 2 == 0, F.array("role", F.lit("part"))).otherwise(F.lit(None).cast("array<string>"))
    labels = F.when(F.length("text") % 3 == 0, F.array(F.lit("table"))).when(F.length("text") % 3 == 1, F.array(F.lit("text"), F.lit("formula"))).otherwise(F.array(F.lit("picture"), F.lit("title")))
    pieces = t.table(spark, d, "conversations").select(_text("conv_id").alias("doc_id"), F.col("turn").alias("piece"), "text", headings.alias("headings"), labels.alias("labels"), F.lit(1).alias("page"))
    flags = [F.col(c) for c in ("contains_table", "contains_text", "contains_figure")]
    return chunking.layout_chunks(pieces).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", *flags)


def q_typed_sections(spark, d):
    """Line items stand in for a layout model's items: labels by part, boxes by quantity and supplier."""
    side = F.col("l_quantity").cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(100.0).alias("top"), (side * 2).alias("x1"), (F.lit(100.0) - F.col("l_suppkey") % 100).alias("bottom"))
    items = t.table(spark, d, "lineitem").select(
        _text("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), _list(["TITLE", "Paragraph", "table", "PICTURE", "caption", "Page_Header", "unheard"], "l_partkey").alias("label"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit(" ")).when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag")).alias("text"), F.lit(1).alias("page"), box.alias("bbox"))
    return chunking.typed_sections(items).select("doc_id", "pos", "type", "text", "html")


def q_lines_of_words(spark, d):
    """Line items stand in for words: an order is a page, a line has the items of one flag and status; items of one number stay in the table's order."""
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias("pos")
    rows = t.table(spark, d, "lineitem").select("*", at).filter("l_linenumber <= 7")
    line = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    words = rows.select(
        _text("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), _text("l_partkey").alias("text"), F.col("l_linenumber").cast("double").alias("x0"),
        (line * 20 + F.col("l_linenumber") % 3).cast("double").alias("top"), F.format_string("%s %012d", "pos.file_path", "pos.row_index").alias("pos"))
    return chunking.lines_of_words(words).select("doc_id", F.col("line").cast("long").alias("line"), "top", "text")


def q_inherit(spark, d):
    docs = t.table(spark, d, "nation").select(_text("n_nationkey").alias("doc_id"), "n_name", F.lit("x").alias("text"), F.lit("y").alias("sections"), F.lit(1).alias("chunk_index"))
    chunks = t.table(spark, d, "customer").select(_text("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("chunk_index"), F.col("c_name").alias("text"))
    return chunking.inherit(chunks, docs)


def q_table_health(spark, d):
    c = F.col
    wide = F.when(c("p_size") % 3 == 0, F.array(F.lit("a"), F.lit(" "), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    grid = F.array(F.array("p_name", "p_brand"), F.array(c("p_type"), F.when(c("p_size") % 2 == 0, c("p_type"))), wide)
    found = chunking.table_health(t.table(spark, d, "part").select(c("p_partkey").alias("table_id"), grid.alias("grid")))
    return found.select("table_id", c("rows").cast("long").alias("rows"), F.array_join("widths", ",").alias("widths"), "consistent", F.round("empty_rate", 9).alias("empty_rate"))


def q_image_stats(spark, d):
    images = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.concat(F.lit("f"), _text("s_nationkey")).alias("file_path"))
    files = t.table(spark, d, "nation").filter("n_regionkey > 0").select(F.concat(F.lit("f"), _text("n_nationkey")).alias("path"), (F.col("n_regionkey") * 10).cast("long").alias("length"))
    return store.image_stats(images, files)


def q_captioned(spark, d):
    images = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("caption"))
    new = t.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("caption"))
    return store.captioned(images, new)


def q_delete_by_metadata(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.filter(~F.coalesce(store.by_metadata({"lang": "de", "source": "src1"}), F.lit(False)))


def q_index_add(spark, d):
    """Labelled documents come again with a short text in place of theirs."""
    new = t.table(spark, d, "labels").join(t.table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("alpha beta "), "lang").alias("text"))
    held = index.build(t.chunks(spark, d), stem=False)
    return _r(index.add(held, index.build(new, stem=False)).term_stats(), "idf")


def q_final_entries(spark, d):
    rows = t.table(spark, d, "benchmark").select(F.col("text").alias("reference"), F.concat(F.lit("q"), _text("item_id")).alias("user_input"), F.lit("x").alias("unused"))
    return evaluation.final_entries(rows)


def q_contexts_in_feed(spark, d):
    return evaluation.contexts_in_feed(t.table(spark, d, "nation").select(F.col("n_nationkey").alias("context_id"), F.col("n_name").alias("text")), FEED)


def q_low_recall(spark, d):
    return evaluation.low_recall(t.table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("context_recall")))


def q_judged(spark, d):
    """One judge tells a text's length, and of every third nothing; one fails before it gives any value."""
    def broken(rows):
        raise RuntimeError("out of service")

    cases = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    length = lambda rows: rows.select("query_id", F.when(F.col("query_id") % 3 > 0, F.length("text")).alias("value"))
    return evaluation.judged(cases, {"length": length, "broken": broken})


def q_merged_filters(spark, d):
    parsed = F.create_map(F.lit("type"), "n_name", F.lit("source"), F.lit("a"))
    explicit = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("type"), F.lit("pdf"), F.lit("tag"), F.lit("t"))).otherwise(F.create_map(F.lit("source"), F.lit("b")))
    entries = F.array_sort(F.transform(F.map_entries(filters.merged(parsed, explicit)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return t.table(spark, d, "nation").select("n_nationkey", F.array_join(entries, ";").alias("filters"))


def q_result_images(spark, d):
    """Customers are results, each with two images; nations' files hold them, and those of a region hold the same."""
    body = F.concat(F.lit("x [IMAGE: i"), _text("c_nationkey"), F.lit("] y [IMAGE: i"), _text("rank"), F.lit("]"))
    results = t.table(spark, d, "customer").withColumn("rank", F.col("c_custkey") % 5).select((F.col("c_custkey") / 5).cast("long").alias("query_id"), F.col("c_custkey").alias("chunk_id"), "rank", body.alias("text"))
    nations = t.table(spark, d, "nation").filter("n_nationkey <> 3")
    images = nations.select(F.concat(F.lit("i"), _text("n_nationkey")).alias("image_id"), F.concat("n_name", F.lit(".gif")).alias("file_path"), F.col("n_name").alias("caption"))
    files = nations.select(F.concat("n_name", F.lit(".gif")).alias("path"), F.encode(F.concat(F.lit("region "), _text("n_regionkey")), "UTF-8").alias("content"))
    return response.result_images(results, images, files).select("query_id", "chunk_id", F.col("place").cast("long").alias("place"), "image_id", "mime", "data", "caption")


def q_image_counts(spark, d):
    body = F.concat(F.repeat(F.lit("[IMAGE: a]"), (F.col("p_size") % 3).cast("int")), F.when(F.col("p_size") % 2 == 0, "[IMAGE: b]").otherwise("none"))
    rows = t.table(spark, d, "part").select(F.lit(1).alias("query_id"), F.col("p_partkey").alias("chunk_id"), body.alias("text"))
    return response.image_counts(rows).select("chunk_id", F.col("n_images").cast("long").alias("n_images"), "has_images")


def q_cited(spark, d):
    page = F.when(F.col("turn") % 3 == 0, _text("turn")).when(F.col("turn") % 3 == 1, "iv")
    rows = t.table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("source_path"), (F.length("text") / 7).alias("score"), "text",
        page.alias("page"), _text("conv_id").alias("page_num"))
    return response.cited(rows).select("query_id", "index", "chunk_id", "source", "score", F.col("page").cast("long").alias("page"))


def q_chunks_of(spark, d):
    """One document by its reference, and one by its name inside chunk ids, as nothing refers to it."""
    rows = t.table(spark, d, "customer").select(F.concat(F.lit("doc"), _text("c_nationkey")).alias("source_ref"), F.col("c_name").alias("chunk_id"))
    return catalog.chunks_of(rows, "doc7").unionByName(catalog.chunks_of(rows, "#00000001"))


def q_trace_keyword(spark, d):
    return traces.recent(_traces(spark, d), keyword="PURCHASE", n=1_000_000).select("trace_id")


_STRIPPED = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_MARKS = r"regexp_extract_all(coalesce(text, ''), '\*\*.+?\*\*|\*.+?\*|__.+?__|_.+?_')[1:5]"

ORACLE_SQL = {
    "q_mime_types": """WITH s AS (SELECT s_suppkey, (['', '.PNG', '.jpeg', '.gif', '.bin', '.webp', '.bmp'])[s_suppkey % 7 + 1] AS e,
  (['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/png', 'image/bmp', 'image/png', 'image/png'])[s_suppkey % 8 + 1] AS by_bytes FROM supplier)
SELECT s_suppkey, CASE e WHEN '.PNG' THEN 'image/png' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' WHEN '.bmp' THEN 'image/bmp' ELSE by_bytes END AS mime FROM s""",
    "q_scaled_sizes": """SELECT p_partkey, trunc(p_size::DOUBLE * r)::INT AS width, trunc((p_partkey % 97 + 1)::DOUBLE * r)::INT AS height
FROM (SELECT *, least(1.0::DOUBLE, 20.0::DOUBLE / p_size::DOUBLE, 20.0::DOUBLE / (p_partkey % 97 + 1)::DOUBLE) AS r FROM part)""",
    "q_boxes": "SELECT c_custkey, abs(c_acctbal * 1.01::DOUBLE - c_acctbal) >= 50 AND abs(c_acctbal / 4 + c_nationkey * 4 - c_acctbal / 4) >= 50 AS large, round(10000.0 - c_acctbal / 4, 4) AS top, round(10000.0 - (c_acctbal / 4 + c_nationkey * 4), 4) AS bottom FROM customer",
    "q_elapsed": "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE, 2) AS ms FROM events GROUP BY 1",
    "q_version_stamp": """SELECT n_nationkey, left(sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}'), 16) AS stamp FROM nation""",
    "q_ids": "SELECT doc_id, doc_id || '_' || printf('%04d', (doc_id % 10000)::INT) || '_' || left(sha256(text), 8) AS draft, left(sha256(text), 8) || '_' || doc_id % 7 || '_' || n_chars AS image FROM documents",
    "q_first_title": f"""WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10))[1:20], lambda x: {_STRIPPED.format('x')}) AS ls FROM documents)
SELECT doc_id, coalesce({_STRIPPED.format("list_filter(ls, lambda x: starts_with(x, '# '))[1][3:]")}, list_filter(ls[1:10], lambda x: x <> '')[1]) AS title FROM l""",
    "q_document_title": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' title' WHEN doc_id % 2 = 0 THEN 'Head of ' || source ELSE upper(left(source, 1)) || lower(source[2:]) || ' X Y' END AS title FROM documents""",
    "q_grids": """SELECT n_nationkey, '<table><tr><th>name</th><th>key</th></tr><tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr><tr><td>x</td><td></td><td>more</td></tr></table>' AS html,
  'name: ' || n_name || ' | key: ' || n_nationkey || chr(10) || 'name: x | key:  | col2: more' AS plain FROM nation""",
    "q_html_tables": r"""WITH m AS (SELECT *, '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' \| x |  |' || chr(10) || '| ' || n_nationkey || ' | y |' AS markdown FROM nation)
SELECT n_nationkey, markdown, CASE WHEN n_nationkey % 2 = 0 THEN markdown ELSE n_name END AS shown FROM m""",
    "q_image_placeholders": """SELECT p_partkey, p_partkey || '|x' || p_size AS ids,
  replace('A [IMAGE: ' || p_partkey || '] b [IMAGE:x' || p_size || '] and [IMAGE: ' || p_partkey || ']', '[IMAGE: ' || p_partkey || ']', '[IMAGE: ' || p_partkey || ']' || chr(10) || '(Description: ' || p_name || ')') AS stitched FROM part""",
    "q_table_summaries": "SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 AND role = 'user' AND NOT starts_with(text, '(Table Summary: ') THEN '(Table Summary: said in turn ' || turn || ')' || chr(10) || chr(10) || text ELSE text END AS text FROM conversations",
    "q_formulas": "SELECT p_partkey, p_name AS formula FROM part",
    "q_enrichment_replies": "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE 'Untitled' END AS title, CASE WHEN p_partkey % 4 > 0 THEN 'about ' || p_type ELSE '' END AS summary, CASE WHEN p_partkey % 4 > 0 THEN 'a|' || p_brand ELSE '' END AS tags FROM part",
    "q_model_scores": """WITH s AS (SELECT conv_id AS query_id, turn, ((turn * 37 + conv_id) % 11)::DOUBLE AS rerank_score FROM conversations WHERE conv_id % 7 <> 0)
SELECT query_id, turn::VARCHAR AS chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, turn) AS rank FROM s QUALIFY rank <= 3""",
    "q_list_items": "SELECT doc_id, 'intro' || chr(10) || '- ' || lang || chr(10) || '¦  2. ' || source || chr(10) || 'more of it' || chr(10) || '¦* x 3.4' AS items FROM documents",
    "q_whole_sections": f"""WITH {_SECTIONS}, g AS (SELECT doc_id, segment, CASE WHEN arg_min(type, pos) = 'table' THEN 'table' ELSE 'text' END AS section_type,
  {_STRIPPED.format("coalesce(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (trim(coalesce(text, '')) <> ''), '')")} AS text FROM numbered GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1 AS chunk_index FROM g WHERE text <> '')
SELECT doc_id, chunk_index, doc_id || '_' || printf('%04d', chunk_index) || '_' || left(sha256(text), 8) AS chunk_id, section_type, text FROM n""",
    "q_layout_chunks": """WITH x AS (SELECT conv_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, CASE WHEN turn % 2 = 0 THEN role || chr(10) || 'part' || chr(10) || text ELSE text END AS whole, length(text) % 3 AS m FROM conversations)
SELECT doc_id, chunk_index, doc_id || '_' || printf('%04d', chunk_index) || '_' || left(sha256(whole), 8) AS chunk_id, m = 0 AS contains_table, m > 0 AS contains_text, m = 2 AS contains_figure FROM x""",
    "q_typed_sections": """WITH x AS (SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS pos, ['title', 'text', 'table', 'figure', 'figure_caption', 'header', 'text'][(l_partkey % 7 + 1)::INT] AS type,
  CASE WHEN l_partkey % 3 = 0 THEN ' ' WHEN l_partkey % 5 > 0 THEN l_returnflag ELSE '' END AS text, l_quantity::DOUBLE * 2 AS width, l_suppkey % 100 AS height FROM lineitem)
SELECT doc_id, pos, type, text, CASE WHEN type = 'table' THEN text END AS html FROM x WHERE trim(text) <> '' OR (type = 'figure' AND width >= 50 AND height >= 50)""",
    "q_lines_of_words": """WITH w AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS line, l_linenumber % 3 AS off FROM lineitem WHERE l_linenumber <= 7),
g AS (SELECT l_orderkey, line, min(off) AS off, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber) AS text FROM w GROUP BY 1, 2)
SELECT l_orderkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS line, (line * 20 + off)::DOUBLE AS top, text FROM g""",
    "q_inherit": "SELECT c_nationkey::VARCHAR AS doc_id, c_custkey AS chunk_index, c_name AS text, n_name, c_nationkey::VARCHAR AS source_ref FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "q_table_health": """SELECT p_partkey AS table_id, 3::BIGINT AS rows, CASE WHEN p_size % 3 = 0 THEN '2,3' ELSE '2' END AS widths, p_size % 3 <> 0 AS consistent,
  round(((p_size % 2 <> 0)::INT + (p_size % 3 = 0)::INT)::DOUBLE / CASE WHEN p_size % 3 = 0 THEN 7 ELSE 6 END, 9) AS empty_rate FROM part""",
    "q_image_stats": "SELECT count(*) AS images, coalesce(sum(CASE WHEN n_regionkey > 0 THEN n_regionkey * 10 END), 0)::BIGINT AS bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "q_captioned": "SELECT s_suppkey AS image_id, CASE WHEN s_suppkey % 3 = 0 AND c_name IS NOT NULL THEN c_name WHEN s_suppkey % 2 = 0 THEN s_name END AS caption FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey",
    "q_delete_by_metadata": "SELECT doc_id, lang, source FROM documents WHERE NOT (lang = 'de' AND source = 'src1')",
    "q_index_add": f"WITH held AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'alpha beta ' || lang ELSE text END AS text FROM documents), {POSTINGS.replace('FROM documents', 'FROM held')} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "q_final_entries": "SELECT 'q' || item_id AS user_input, text AS reference, NULL::VARCHAR AS reference_contexts, NULL::VARCHAR AS reference_context_ids, NULL::VARCHAR AS persona_name, NULL::VARCHAR AS query_style, NULL::VARCHAR AS query_length FROM benchmark",
    "q_contexts_in_feed": "SELECT n_nationkey AS context_id, contains('wheat from france, steel from germany; and oil from the united states.', lower(n_name)) AS in_feed FROM nation",
    "q_low_recall": "SELECT event_id, value / 100 AS context_recall FROM events WHERE value / 100 < 0.4",
    "q_judged": "SELECT item_id::VARCHAR AS query_id, 'length' AS metric, length(text)::DOUBLE AS value FROM benchmark WHERE item_id % 3 > 0 AND text IS NOT NULL",
    "q_merged_filters": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'source=a;tag=t;type=pdf' ELSE 'source=b;type=' || n_name END AS filters FROM nation",
    "q_result_images": """WITH r AS (SELECT (c_custkey / 5)::DOUBLE AS x, floor(c_custkey / 5)::BIGINT AS query_id, c_custkey AS chunk_id, c_custkey % 5 AS rank, c_nationkey FROM customer),
p AS (SELECT query_id, chunk_id, rank, 0 AS place, c_nationkey AS k FROM r UNION ALL SELECT query_id, chunk_id, rank, 1, rank FROM r WHERE rank <> c_nationkey)
SELECT query_id, chunk_id, place::BIGINT AS place, 'i' || k AS image_id, 'image/gif' AS mime, base64(('region ' || n_regionkey)::BLOB) AS data, n_name AS caption FROM p JOIN nation ON n_nationkey = k AND k <> 3
QUALIFY row_number() OVER (PARTITION BY query_id, n_regionkey ORDER BY rank, place) = 1""",
    "q_image_counts": "SELECT p_partkey AS chunk_id, ((p_size % 3 > 0)::INT + (p_size % 2 = 0)::INT)::BIGINT AS n_images, p_size % 3 > 0 OR p_size % 2 = 0 AS has_images FROM part",
    "q_cited": """SELECT conv_id AS query_id, turn AS index, conv_id || '_' || turn AS chunk_id, role AS source, round(length(text) / 7::DOUBLE, 4) AS score,
  CASE turn % 3 WHEN 0 THEN turn WHEN 1 THEN NULL ELSE conv_id END::BIGINT AS page FROM conversations""",
    "q_chunks_of": "SELECT 'doc' || c_nationkey AS source_ref, c_name AS chunk_id FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'doc' || c_nationkey, c_name FROM customer WHERE contains(c_name, '#00000001')",
    "q_trace_keyword": "SELECT printf('t%06d', user_id) AS trace_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase')",
    "q_summary": r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:3], ' '), '^\s+', ''), '\s+$', '') AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 500 THEN left(x, 497) || '...' ELSE x END AS summary FROM s""",
    "q_pack_rows": """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS ns FROM documents WHERE text IS NOT NULL),
r(doc_id, ns, i, n, pieces) AS (
  SELECT doc_id, ns, 1, ns[1], 1 FROM l UNION ALL
  SELECT doc_id, ns, i + 1, CASE WHEN n + 2 + ns[i + 1] > 400 THEN ns[i + 1] ELSE n + 1 + ns[i + 1] END, pieces + (n + 2 + ns[i + 1] > 400)::INT FROM r WHERE i < len(ns))
SELECT doc_id, max(pieces)::BIGINT AS pieces, TRUE AS whole FROM r GROUP BY 1""",
}

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_") and callable(value)}
