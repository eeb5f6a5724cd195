"""Queries of query syntax, text functions, segments and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import numeric, text
from lodestone.operators import chunking, evaluation, filters
from lodestone.plans import tables as t
from lodestone.plans.retrieval import ASKED

#: Queries as a user may write them.
WRITTEN = [
    "plain words only", "type:pdf tag:a,b  neural   nets", "Collection:papers src:docs/x.pdf what is BM25", "http://x.org type:en", "tags:a tags:b,c",
    "foo:type:en bar", "(type:md", "c++ and C# source:a source:b", "", "Zoë's type:", "doc_type:html TAG:x",
]
LINES = [
    "Doe, J., Roe, R.K.: Notes on sorting shelves of books (1987)", "[12] Some numbered entry", "In 2010 we measured it.", "Poe, A.B.: Counting what is left over. In: Annals of Leftovers 1991, pp. 17",
    "A plain sentence of body text.", "Springer, IEEE and ACM are publishers", "References", "Low, P.: Very long tables (2011)", "High, Q.R.: Tables of medium length. In: Shelves (2012)", "",
]


def _documents(spark, d):
    return t.table(spark, d, "documents")


def q_parse_filters(spark, d):
    rows = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(WRITTEN)], "id long, query string").unionByName(
        t.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("type:"), "role", F.lit(" "), "text").alias("query")))
    return rows.select("id", filters.parse(F.col("query")).alias("p")).select("id", "p.text", "p.collection", "p.doc_type", "p.source_path", F.array_join("p.tags", "|").alias("tags"))


def q_keywords(spark, d):
    return t.asked_terms(spark, d).select("query_id", F.array_join("terms", " ").alias("terms"))


def q_post_filter(spark, d):
    c, rows = F.col, t.chunks(spark, d)
    wanted = filters.matches(
        doc_type=c("doc_type"), source_path=c("source_path"), tags=F.concat(c("tags"), F.lit(", all")), want_type=F.lit("de"), want_source=F.lit("rc1"), want_tags=F.array(F.lit("de"), F.lit("x")))
    return rows.filter(wanted).select("chunk_id", "doc_type", "source_path")


def q_reference_lines(spark, d):
    rows = spark.createDataFrame(list(enumerate(LINES)), "id long, line string")
    return rows.select("id", text.entry_like(F.col("line")).alias("entry"))


def q_reference_docs(spark, d):
    made = spark.createDataFrame([(-1, "\n".join(LINES[:4])), (-2, "\n".join(LINES[4:])), (-3, "\n".join(LINES))], "doc_id long, text string")
    rows = made.unionByName(_documents(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", text.is_reference_section(F.col("text")).alias("is_reference"))


def q_clean_text(spark, d):
    return _documents(spark, d).select("doc_id", text.clean(F.col("text")).alias("text"))


def q_clean_html(spark, d):
    return t.table(spark, d, "pages").select("page_id", text.clean(F.col("html")).alias("text"))


def q_title(spark, d):
    return _documents(spark, d).select("doc_id", text.chunk_title(F.col("text")).alias("title"))


def q_summary(spark, d):
    return _documents(spark, d).select("doc_id", text.chunk_summary(F.col("text")).alias("summary"))


def q_tags(spark, d):
    return _documents(spark, d).select("doc_id", text.chunk_tags(F.col("text")).alias("tags"))


def q_snippet(spark, d):
    return _documents(spark, d).select("doc_id", text.snippet(F.col("text"), 200).alias("snippet"))


def q_basename(spark, d):
    return t.table(spark, d, "pages").select("page_id", text.basename(F.col("url")).alias("name"))


def q_normal_words(spark, d):
    return _documents(spark, d).select("doc_id", F.size(text.normal_words(F.col("text"))).cast("long").alias("n_words"), F.sha2(F.array_join(text.normal_words(F.col("text")), " "), 256).alias("words"))


def q_chunk_ids(spark, d):
    return _documents(spark, d).select("doc_id", numeric.chunk_id(F.col("source"), F.col("doc_id").cast("int"), F.col("text")).alias("chunk_id"), numeric.document_id(F.col("text")).alias("document_id"))


def q_summary_key(spark, d):
    return _documents(spark, d).select("doc_id", text.summary_key(F.col("lang"), F.col("text")).alias("cache_key"))


def _sections(spark, d):
    kind = F.when(F.col("role") == "system", "title").when((F.col("role") == "user") & (F.length("text") % 5 == 0), "table").when(F.length("text") % 7 == 0, "header").otherwise("text")
    return t.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("pos"), kind.alias("type"), "text", (F.col("turn") + 1).cast("int").alias("page"),
        F.lit(None).cast("struct<x0:double,top:double,x1:double,bottom:double>").alias("bbox"), F.lit(None).cast("string").alias("html"))


def q_segments(spark, d):
    """Conversations stand in for documents with typed sections."""
    return chunking.segments(_sections(spark, d)).select("doc_id", F.col("segment").cast("long").alias("segment"), "type", "text", F.col("page").cast("long").alias("page"))


def q_section_chunks(spark, d):
    return chunking.chunks(chunking.segments(_sections(spark, d)), size=300, overlap=60).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "section_type", "text")


def q_plain_chunks(spark, d):
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return chunking.plain_chunks(docs).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.length("text").cast("long").alias("n"))


def q_pack_rows(spark, d):
    """Lines packed greedily up to 400 characters."""
    pieces = chunking.packed(F.split("text", "\n"), 400, "\n")
    return _documents(spark, d).select("doc_id", F.size(pieces).cast("long").alias("pieces"), (F.array_join(pieces, "\n") == F.col("text")).alias("whole"))


def q_context_assembly(spark, d):
    rows = t.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return evaluation.assembled(rows)


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+[+#]+|[\\p{L}\\p{N}_]+')"
_KEY = "lower(regexp_extract(p, '([\\p{L}\\p{N}_]+):(\\S+)', 1))"
_KIND = f"CASE WHEN {_KEY} IN ('collection', 'col') THEN 'collection' WHEN {_KEY} IN ('type', 'doc_type') THEN 'doc_type' WHEN {_KEY} IN ('source', 'src') THEN 'source_path' WHEN {_KEY} IN ('tag', 'tags') THEN 'tags' END"
_VALUES = ", ".join("({}, '{}')".format(-1 - i, q.replace("'", "''")) for i, q in enumerate(WRITTEN))
_LINE_VALUES = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(LINES))
_ENTRY = r"""(CASE WHEN regexp_matches({0}, '[A-Z][A-Za-z''’\-]+,\s*(?:[A-Z]\.\s*){{1,3}}') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches({0}, '\((?:19|20)\d{{2}}[a-z]?\)\s*$|\b(?:19|20)\d{{2}}\b') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches({0}, '^\s*\[\d{{1,3}}\]') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches({0}, '\bIn:|\bSpringer\b|\bIEEE\b|\bACM\b|\bePrint\b|\bCryptology\b|\bProceedings\b|\bLNCS\b|\bvol\.|\bpp\.\s*\d') THEN 1 ELSE 0 END >= 2)"""
_MADE = "SELECT -1 AS doc_id, '{}' AS text UNION ALL SELECT -2, '{}' UNION ALL SELECT -3, '{}' UNION ALL SELECT doc_id, text FROM documents".format(
    *["\n".join(x).replace("'", "''") for x in (LINES[:4], LINES[4:], LINES)])
_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def _clean(column: str) -> str:
    x = column
    for pattern, to, flags in (
        (r"─{10,}.*?(?:Page \d+|Footer|Section \d+|©|Confidential).*?─{10,}", "''", "gis"), (r"─{10,}", "''", "g"), (r"<!--.*?-->", "''", "gs"), (r"<[^>]+>", "''", "g"),
        (r" {2,}", "' '", "g"), (r"\n{3,}", "chr(10) || chr(10)", "g"), (r"[^\S\n]+\n", "chr(10)", "g"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {to}, '{flags}')"
    return _STRIP.format(x)


_FIRST = r"string_split_regex(text, '[.!?]\s+')[1]"
_SENTENCE = r"regexp_replace(trim(" + _FIRST + r", E' \n\t\r'), '[.!?]+$', '')"
_LINE1 = "trim(split_part(text, chr(10), 1))"
_NORMAL = r"list_filter(string_split(regexp_replace(lower(regexp_replace(text, '-\s*\n\s*', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SECTIONS = """sections AS (SELECT conv_id::VARCHAR AS doc_id, turn AS pos, CASE WHEN role = 'system' THEN 'title' WHEN role = 'user' AND length(text) % 5 = 0 THEN 'table' WHEN length(text) % 7 = 0 THEN 'header' ELSE 'text' END AS type, text, turn + 1 AS page FROM conversations),
kept AS (SELECT *, (type = 'table' OR type = 'title' OR coalesce(lag(type) OVER w = 'table', TRUE))::INT AS starts FROM sections WHERE type <> 'header' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS segment FROM kept)"""

ORACLE_SQL = {
    "q_parse_filters": f"""WITH q AS (SELECT * FROM (VALUES {_VALUES}) v(id, query) UNION ALL SELECT conv_id * 1000 + turn, 'type:' || role || ' ' || text FROM conversations),
s AS (SELECT id, string_split(trim(regexp_replace(query, '\\s+', ' ', 'g')), ' ') AS ps FROM q),
u AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM s),
k AS (SELECT id, i, p, {_KIND} AS kind, regexp_extract(p, '([\\p{{L}}\\p{{N}}_]+):(\\S+)', 2) AS value, CASE WHEN {_KIND} IS NULL THEN p ELSE regexp_extract(p, '^(.*?)([\\p{{L}}\\p{{N}}_]+):(\\S+)$', 1) END AS rest FROM u)
SELECT id, trim(regexp_replace(string_agg(rest, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS text, max_by(value, i) FILTER (kind = 'collection') AS collection, max_by(value, i) FILTER (kind = 'doc_type') AS doc_type,
  max_by(value, i) FILTER (kind = 'source_path') AS source_path, coalesce(replace(string_agg(value, ',' ORDER BY i) FILTER (kind = 'tags'), ',', '|'), '') AS tags FROM k GROUP BY id""",
    "q_post_filter": "SELECT doc_id AS chunk_id, lang AS doc_type, source AS source_path FROM documents WHERE lang = 'de' AND contains(source, 'rc1')",
    "q_reference_lines": f"SELECT id::BIGINT AS id, {_ENTRY.format('line')} AS entry FROM (VALUES {_LINE_VALUES}) v(id, line)",
    "q_reference_docs": f"""WITH d AS ({_MADE}), l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM d)
SELECT doc_id, count(*) FILTER (line <> '') >= 3 AND count(*) FILTER (line <> '' AND {_ENTRY.format('line')}) * 2 >= count(*) FILTER (line <> '') AS is_reference FROM l GROUP BY 1""",
    "q_clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "q_clean_html": f"SELECT page_id, {_clean('html')} AS text FROM pages",
    "q_title": f"""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'Untitled' WHEN regexp_matches(text, '\\A#{{1,6}}\\s+.') THEN trim(regexp_extract(text, '\\A#{{1,6}}\\s+(.+)', 1))
  WHEN {_LINE1} <> '' AND length({_LINE1}) <= 100 AND NOT regexp_matches({_LINE1}, '[.,;]$') THEN {_LINE1}
  WHEN {_FIRST} <> '' AND length({_SENTENCE}) <= 150 THEN {_SENTENCE} WHEN {_FIRST} <> '' THEN left({_SENTENCE}, 147) || '...'
  ELSE trim(left(text, 100)) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END END AS title FROM documents""",
    "q_snippet": r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 200 THEN flat ELSE regexp_replace(left(flat, 200), ' [^ ]*$', '') || '...' END AS snippet FROM s""",
    "q_basename": r"SELECT page_id, string_split(replace(url, '\', '/'), '/')[-1] AS name FROM pages",
    "q_normal_words": f"SELECT doc_id, len({_NORMAL}) AS n_words, sha256(array_to_string({_NORMAL}, ' ')) AS words FROM documents",
    "q_chunk_ids": "SELECT doc_id, left(sha256(source), 8) || '_' || printf('%04d', doc_id) || '_' || left(sha256(text), 8) AS chunk_id, 'doc_' || left(sha256(text), 16) AS document_id FROM documents",
    "q_summary_key": "SELECT doc_id, sha256(lang || chr(0) || text || chr(0)) AS cache_key FROM documents",
    "q_segments": f"""WITH {_SECTIONS}
SELECT doc_id, segment::BIGINT AS segment, CASE WHEN min_by(type, pos) = 'table' THEN 'table' ELSE 'text' END AS type, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (trim(coalesce(text, '')) <> '') AS text,
  coalesce(max(page) FILTER (type = 'title'), min_by(page, pos)) AS page FROM numbered GROUP BY doc_id, segment HAVING string_agg(text, '') FILTER (trim(coalesce(text, '')) <> '') <> ''""",
    "q_context_assembly": "SELECT conv_id AS query_id, string_agg('[' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1",
}
ORACLE_SQL["q_keywords"] = f"WITH {ASKED} SELECT a.query_id, string_agg(a.term, ' ' ORDER BY f.pos) AS terms FROM asked a JOIN firsts f ON a.query_id = f.query_id AND a.term = f.term GROUP BY 1"

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_") and callable(value)}
