"""Text functions on columns; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.stopwords import DEFAULT, ENGLISH

WORD = r"[a-z]+[+#]+|[\p{L}\p{N}_]+"
#: Fixed value: `key:value` in a query.
FILTER = r"([\p{L}\p{N}_]+):(\S+)"


def blank(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    return F.lower(blank(text))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normal_words(text: Column) -> Column:
    """Words of a page: line breaks behind hyphens closed, small letters and digits only."""
    joined = F.lower(F.regexp_replace(text, r"-\s*\n\s*", ""))
    return F.filter(F.split(F.regexp_replace(joined, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Small-letter words of any script; names like c++ and c# stay whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def terms(text: Column, *, stopwords=ENGLISH, least: int = 2, dedupe: bool = False) -> Column:
    """Tokens without stop-words and short ones, before stemming."""
    kept = F.filter(tokens(text), lambda w: ~w.isin(*sorted(stopwords)) & (F.length(w) >= least))
    return F.array_distinct(kept) if dedupe else kept


def keywords(text: Column, *, most: int = 20) -> Column:
    """A query's first distinct terms."""
    return F.slice(terms(text, stopwords=DEFAULT, dedupe=True), 1, most)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


#: What cleaning takes out, in order, and what it leaves in its place.
CLEANING = (
    (r"(?is)─{10,}.*?(?:Page \d+|Footer|Section \d+|©|Confidential).*?─{10,}", ""), (r"─{10,}", ""), (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", ""), (" {2,}", " "), (r"\n{3,}", "\n\n"),
    (r"(?U)[^\S\n]+(?=\n|\z)", ""),
)


def clean(text: Column) -> Column:
    """Rule cleaning of a chunk; code fences are set aside and put back."""
    fence = r"(?s)```.*?```"
    fences = F.regexp_extract_all(text, F.lit(fence), F.lit(0))
    mark = lambda i: F.concat(F.lit("__CODE_BLOCK_"), i.cast("string"), F.lit("__"))
    pieces = F.split(text, fence, -1)
    x = F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size(fences), F.concat(p, mark(i))).otherwise(p)), "")
    for pattern, to in CLEANING:
        x = F.regexp_replace(x, pattern, to)
    numbers = F.when(F.size(fences) > 0, F.sequence(F.lit(0), F.size(fences) - 1)).otherwise(F.array().cast("array<int>"))
    return strip(F.aggregate(numbers, x, lambda kept, i: F.replace(kept, mark(i), F.get(fences, i))))


def chunk_title(text: Column) -> Column:
    """Heading at the start, else a short first line, else the first sentence, else the beginning."""
    heading = F.regexp_extract(text, r"(?m)\A#{1,6}\s+(.+)$", 1)
    line = strip(F.split_part(text, F.lit("\n"), F.lit(1)))
    sentence = F.regexp_replace(strip(F.get(F.split(text, r"[.!?]\s+"), F.lit(0))), r"[.!?]+$", "")
    return (
        F.when(text.isNull() | (text == ""), "Untitled").when(heading != "", strip(heading))
        .when((line != "") & (F.length(line) <= 100) & ~line.rlike(r"[.,;]$"), line)
        .when((F.get(F.split(text, r"[.!?]\s+"), F.lit(0)) != "") & (F.length(sentence) <= 150), sentence)
        .when(F.get(F.split(text, r"[.!?]\s+"), F.lit(0)) != "", F.concat(F.substring(sentence, 1, 147), F.lit("...")))
        .otherwise(F.concat(strip(F.substring(text, 1, 100)), F.when(F.length(text) > 100, "...").otherwise("")))
    )


def chunk_summary(text: Column, *, sentences: int = 3, most: int = 500) -> Column:
    """The first sentences."""
    first = strip(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), 1, sentences), " "))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def chunk_tags(text: Column, *, most: int = 10) -> Column:
    """Sorted set of capitalised phrases, code identifiers and emphasised words, five of each kind."""
    some = lambda pattern, group: F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), 1, 5)
    marked = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\*\*.+?\*\*|\*.+?\*|__.+?__|_.+?_"), F.lit(0)), 1, 5)
    marked = F.filter(F.transform(marked, lambda m: F.trim(F.regexp_replace(m, r"^(\*\*|\*|__|_)|(\*\*|\*|__|_)$", ""))), lambda m: m != "")
    found = F.array_union(F.array_union(some(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 0), some(r"\b[a-z]+(?:[A-Z][a-z]*)+\b|\b[a-z]+_[a-z_]+\b", 0)), marked)
    return F.slice(F.array_sort(found), 1, most)


def parse_enrichment(reply: Column) -> Column:
    """title, summary and tags of a model's `Title: / Summary: / Tags:` reply, with defaults."""
    field = lambda name: strip(F.regexp_extract(F.coalesce(reply, F.lit("")), rf"(?im)^\s*{name}:[ \t]*(.*)$", 1))
    tags = F.filter(F.transform(F.split(field("Tags"), ","), strip), lambda t: t != "")
    return F.struct(
        F.when(field("Title") == "", "Untitled").otherwise(field("Title")).alias("title"), field("Summary").alias("summary"), tags.alias("tags"),
    )


def snippet(text: Column, most: int = 200) -> Column:
    """White space collapsed, cut at the last space before ``most``."""
    flat = blank(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.substring(flat, 1, most), " [^ ]*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("...")))


def html_table_markdown(html: Column) -> Column:
    """Rows and cells of an HTML table as a pipe table; short rows are filled, the first row is the head."""
    cells = lambda row: F.transform(
        F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)),
        lambda c: F.replace(blank(F.regexp_replace(c, "<[^>]+>", "")), F.lit("|"), F.lit("\\|")),
    )
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000)), "\n")).otherwise(F.lit(""))


def table_snippet(text: Column, html: Column, most: int = 300) -> Column:
    """A table is shown as a pipe table if there is HTML, else as it is."""
    return F.when(strip(html).startswith("<"), html_table_markdown(html)).otherwise(snippet(text, most))


def grid_html(grid: Column) -> Column:
    """A grid (first row is the head) as HTML; cells trimmed, null as empty."""
    cell = lambda c: strip(F.coalesce(c, F.lit("")))
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), cell(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    lines = F.transform(grid, lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td")))
    return F.concat(F.lit("<table>"), F.array_join(lines, ""), F.lit("</table>"))


def grid_plain(grid: Column) -> Column:
    """A line `column: value | ...` for each row below the head; cells beyond the head are col1, col2, ..."""
    cell = lambda c: strip(F.coalesce(c, F.lit("")))
    head = F.transform(F.get(grid, F.lit(0)), cell)
    name = lambda i: F.coalesce(F.get(head, i), F.concat(F.lit("col"), i.cast("string")))
    line = lambda r: F.array_join(F.transform(r, lambda c, i: F.concat(name(i), F.lit(": "), cell(c))), " | ")
    return F.array_join(F.transform(F.slice(grid, 2, 1_000_000), line), "\n")


def document_title(text: Column, stated: Column, path: Column) -> Column:
    """Stated title, else a first-level heading in ten lines, else the file's name made readable."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 10)
    heading = strip(F.substring(F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0)), 3, 1_000_000))
    name = F.initcap(F.regexp_replace(F.regexp_replace(basename(path), r"\.[^.]*$", ""), "[_-]", " "))
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(strip(stated)), some(heading), some(name), F.lit("Untitled Document"))


def first_title(text: Column) -> Column:
    """A first-level heading in twenty lines, else the first line of ten that isn't blank."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), strip)
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0))
    return F.coalesce(strip(F.substring(heading, 3, 1_000_000)), F.get(F.filter(F.slice(lines, 1, 10), lambda x: x != ""), F.lit(0)))


def document_tags(tags: Column, doc_type: Column) -> Column:
    """Tags of a comma list, and the type in capitals."""
    listed = F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), strip), lambda t: t != "")
    return F.array_union(listed, F.when(doc_type.isNotNull() & (doc_type != ""), F.array(F.upper(doc_type))).otherwise(F.array().cast("array<string>")))


def image_ids(text: Column) -> Column:
    """Ids of `[IMAGE: id]` placeholders, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[IMAGE:\s*([^\]]+)\]"), F.lit(1)), strip))


def stitch_captions(text: Column, captions: Column) -> Column:
    """A description behind each placeholder whose id has a caption in the map."""
    def one(kept: Column, image: Column) -> Column:
        mark = F.concat(F.lit("[IMAGE: "), image, F.lit("]"))
        told = F.concat(mark, F.lit("\n(Description: "), captions[image], F.lit(")"))
        return F.when(F.map_contains_key(captions, image), F.replace(kept, mark, told)).otherwise(kept)

    return F.aggregate(image_ids(text), text, one)


def summary_key(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\0")) for p in parts]), 256)


def with_table_summary(text: Column, summary: Column, section_type: Column) -> Column:
    """Tables get their summary in front, once."""
    due = (section_type == "table") & (summary != "") & ~text.startswith("(Table Summary: ")
    return F.when(due, F.concat(F.lit("(Table Summary: "), summary, F.lit(")\n\n"), text)).otherwise(text)


def clean_latex(text: Column) -> Column:
    """A formula without code fences and the delimiters of mathematics around it."""
    bare = F.regexp_replace(strip(text), r"(?s)^```[a-z]*\s*|\s*```$", "")
    return strip(F.regexp_replace(strip(bare), r"(?s)^(\$\$|\\\[|\\\(|\$)\s*|\s*(\$\$|\\\]|\\\)|\$)$", ""))


def parse_scores(reply: Column) -> Column:
    """A model's list of {passage_id, score}, without code fences; null if it isn't one."""
    bare = F.regexp_replace(strip(reply), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, "array<struct<passage_id:string,score:double>>", {"mode": "PERMISSIVE"})


#: What speaks for a bibliography entry (an author's initials, a year, a number in brackets, a venue), and how much.
ENTRY_SIGNALS = (
    (r"[A-Z][A-Za-z'’\-]+,\s*(?:[A-Z]\.\s*){1,3}", 1),
    (r"\((?:19|20)\d{2}[a-z]?\)\s*$|\b(?:19|20)\d{2}\b", 1),
    (r"^\s*\[\d{1,3}\]", 2),
    (r"\bIn:|\bSpringer\b|\bIEEE\b|\bACM\b|\bePrint\b|\bCryptology\b|\bProceedings\b|\bLNCS\b|\bvol\.|\bpp\.\s*\d", 1),
)


def entry_like(line: Column) -> Column:
    """Whether a line looks like a bibliography entry: two signals, a leading [n] counting as both."""
    total = sum((F.when(line.rlike(pattern), weight).otherwise(0) for pattern, weight in ENTRY_SIGNALS), F.lit(0))
    return total >= 2


def is_reference_section(text: Column) -> Column:
    """Whether at least three lines aren't blank and half of those look like entries."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    entries = F.size(F.filter(lines, entry_like))
    return (F.size(lines) >= 3) & (entries * 2 >= F.size(lines))
