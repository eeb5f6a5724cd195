"""Documents to sections, segments and chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestone.functions.numeric import draft_chunk_id

#: Section types that end a run of text, and those that are left out.
HARD = ("table", "list", "equation")
LEFT_OUT = ("header", "footer")
#: Labels of layout models' items and the section types they stand for; other labels are text.
LABELS = {
    "title": "title", "section_header": "title", "text": "text", "paragraph": "text", "table": "table", "picture": "figure", "figure": "figure",
    "formula": "text", "caption": "figure_caption", "footnote": "text", "list_item": "text", "page_header": "header", "page_footer": "footer",
}
#: The least width and height of a figure, in points.
LEAST_FIGURE = 50
#: Up to so many centres of a page are compared one by one; more are searched in leaves, in blocks of so many.
FEW, LEAF, BLOCK = 256, 32, 65_536
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")


def typed_sections(items: DataFrame) -> DataFrame:
    """doc_id, pos, type, text, page, bbox and html of a layout model's items (doc_id, pos, label, text, page, bbox), for ``segments``.

    Items without text are left out, but for figures, which stay if their box is large enough; a table's text is its html as well.
    """
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    rows = items.withColumns({"type": F.coalesce(F.try_element_at(known, F.lower("label")), F.lit("text")), "text": F.coalesce("text", F.lit(""))})
    box = F.col("bbox")
    large = (box["x1"] - box["x0"] >= LEAST_FIGURE) & (F.abs(box["bottom"] - box["top"]) >= LEAST_FIGURE)
    kept = rows.filter((F.trim("text") != "") | ((F.col("type") == "figure") & F.coalesce(large, F.lit(False))))
    return kept.select("doc_id", "pos", "type", "text", "page", "bbox", F.when(F.col("type") == "table", F.col("text")).alias("html"))


def segments(sections: DataFrame) -> DataFrame:
    """doc_id, segment, type, text, page, bbox, table_html: runs of text, and tables, lists and equations alone.

    A title begins a run; figures, captions and unknown types are text.  Gaps and islands by a running
    sum within a document.
    """
    kind = F.trim(F.coalesce("type", F.lit("text")))
    rows = sections.withColumn("type", F.when(kind == "", "text").otherwise(kind)).filter(~F.col("type").isin(*LEFT_OUT))
    along = W.partitionBy("doc_id").orderBy("pos")
    hard = F.col("type").isin(*HARD)
    starts = hard | (F.col("type") == "title") | F.coalesce(F.lag(hard).over(along), F.lit(True))
    rows = rows.withColumn("segment", F.sum(starts.cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "pos")
    shown = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("pos", "text"))
    title = F.max(F.when(F.col("type") == "title", F.struct(F.lit(1).alias("has"), F.col("page").alias("page"))))
    run_page = F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos")))
    out = rows.groupBy("doc_id", "segment").agg(
        F.when(first("type").isin(*HARD), first("type")).otherwise("text").alias("type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]), "\n\n").alias("text"),
        F.coalesce(title["page"], run_page).alias("page"), first("bbox").alias("bbox"),
        F.when(first("type") == "table", F.coalesce(first("html"), first("text"))).alias("table_html"),
    )
    return out.filter("text <> ''").withColumn("bbox", F.when(F.col("type") != "text", F.col("bbox")))


def packed(pieces: Column, most: int, joint: str) -> Column:
    """Neighbouring strings packed greedily, up to ``most`` characters with what joins them."""
    extra = len(joint)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def one(held: Column, piece: Column) -> Column:
        full = held["now"].isNotNull() & (F.length(held["now"]) + 2 * extra + F.length(piece) > most)
        return F.struct(
            F.when(full, F.concat(held["done"], F.array(held["now"]))).otherwise(held["done"]).alias("done"),
            F.when(full | held["now"].isNull(), piece).otherwise(F.concat(held["now"], F.lit(joint), piece)).alias("now"),
        )

    end = F.aggregate(pieces, start, one)
    return F.concat(end["done"], F.when(end["now"].isNotNull(), F.array(end["now"])).otherwise(F.array().cast("array<string>")))


def list_items(text: Column) -> Column:
    """A list cut before each bullet or number; what stands before the first belongs to it."""
    cut = F.split(text, r"(?m)(?=^[ \t]*(?:[-*+]|\d+\.)[ \t]+)")
    head = F.get(cut, F.lit(0))
    plain = ~head.rlike(r"^[ \t]*(?:[-*+]|\d+\.)[ \t]+") & (F.size(cut) > 1)
    return F.when(plain, F.concat(F.array(F.concat(head, F.get(cut, F.lit(1)))), F.slice(cut, 3, 1_000_000))).otherwise(cut)


def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters cut at the coarsest separators that do, each with the end of the one before."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if s in text)
    mark, finer = separators[at], separators[at + 1 :]
    cut = [p + (mark if mark and i < text.count(mark) else "") for i, p in enumerate(text.split(mark))] if mark else list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        whole = "".join(held).strip()
        if whole:
            out.append(whole)

    for piece in cut:
        if len(piece) > size and finer:
            flush()
            held.clear()
            out.extend(split_recursive(piece, size, overlap, finer))
            continue
        if held and sum(map(len, held)) + len(piece) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    flush()
    return out


def text_splitter(size: int, overlap: int):
    """A pandas UDF of the recursive splitter."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield some.map(lambda t: split_recursive(t or "", size, overlap))

    return split


def chunks(segments_: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, section_type, page_num, bbox and table_html.

    Tables stay whole up to twice the size and else part at rows, lists up to the size and else part at
    items, equations always stay whole; text is split recursively.
    """
    text, kind = F.col("text"), F.col("type")
    whole = (kind == "equation") | ((kind == "table") & (F.length(text) <= 2 * size)) | ((kind == "list") & (F.length(text) <= size))
    simple = segments_.filter(kind != "text").withColumn(
        "pieces", F.when(whole, F.array(text)).when(kind == "table", packed(F.split(text, "\n"), size, "\n")).otherwise(packed(list_items(text), size, "")))
    split = segments_.filter(kind == "text").withColumn("pieces", text_splitter(size, overlap)(text))
    rows = simple.unionByName(split).select("*", F.posexplode("pieces").alias("piece", "chunk")).filter(F.trim("chunk") != "")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("segment", "piece")) - 1
    return rows.select(
        "doc_id", index.alias("chunk_index"), F.col("chunk").alias("text"), F.col("type").alias("section_type"), F.col("page").alias("page_num"), "bbox",
        F.when(F.col("piece") == 0, F.col("table_html")).alias("table_html"),
    ).withColumn("chunk_id", draft_chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))


def plain_chunks(documents: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of documents without sections."""
    rows = documents.select("doc_id", F.posexplode(text_splitter(size, overlap)(F.col("text"))).alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", draft_chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))


def split_documents(documents: DataFrame, sections: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks by sections where a document has usable ones, else of its plain text."""
    typed = chunks(segments(sections), size=size, overlap=overlap)
    rest = documents.join(typed.select("doc_id").distinct(), "doc_id", "left_anti")
    return typed.unionByName(plain_chunks(rest, size=size, overlap=overlap), allowMissingColumns=True)


def inherit(chunks_: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's columns, but for texts and the parser's working data."""
    own = {"text", "images", "image_captions", "image_refs", "sections", "doc_id", *chunks_.columns}
    kept = [c for c in documents.columns if c not in own]
    return chunks_.join(documents.select("doc_id", *kept), "doc_id").withColumn("source_ref", F.col("doc_id"))


def lines_of_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, line, top and text: words clustered into lines around each line's first word.

    The anchor is the line's first word, so a page is one group; a page's words are few.  Words at one place
    stay in the order of ``pos``, if there is such a column; without it their order is open.
    """
    order = ["top", "x0", *(c for c in ("pos",) if c in words.columns)]

    def cluster(page: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for word in page.sort_values(order, kind="stable").itertuples():
            if not rows or abs(word.top - rows[-1][0].top) > tolerance:
                rows.append([])
            rows[-1].append(word)
        key = (page["doc_id"].iloc[0], page["page"].iloc[0])
        made = [(*key, i, r[0].top, " ".join(w.text for w in sorted(r, key=lambda w: w.x0))) for i, r in enumerate(rows)]
        return pd.DataFrame(made, columns=["doc_id", "page", "line", "top", "text"])

    return words.groupBy("doc_id", "page").applyInPandas(cluster, "doc_id string, page int, line int, top double, text string")


def nearest(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest point of each query and its squared distance, exactly; ties go to the first point.

    Points lie in leaves of 32 (strips by x, then by y); a query looks into the leaves whose box is no farther
    than the best point of the nearest leaf.  Values that aren't finite are compared with every point: a
    distance that is not a number comes behind the others, a point that is ``lost`` (null) behind all.
    """
    at, best = np.zeros(len(qx), dtype=np.int64), np.full(len(qx), np.nan)
    good = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    tree = np.isfinite(qx) & np.isfinite(qy) if len(good) else np.zeros(len(qx), dtype=bool)
    if tree.any():
        leaves = -(-len(good) // LEAF)
        strip = LEAF * math.ceil(math.sqrt(leaves))
        by_x = good[np.argsort(px[good], kind="stable")]
        held = by_x[np.lexsort((py[by_x], np.arange(len(by_x)) // strip))]
        held = np.append(held, np.full(leaves * LEAF - len(held), held[-1])).reshape(leaves, LEAF)
        lx, ly = px[held], py[held]
        box = lx.min(1), lx.max(1), ly.min(1), ly.max(1)
        asked = np.flatnonzero(tree)
        for some in (asked[i : i + 1024] for i in range(0, len(asked), 1024)):
            x, y = qx[some, None], qy[some, None]
            dx, dy = np.maximum(np.maximum(box[0] - x, x - box[1]), 0), np.maximum(np.maximum(box[2] - y, y - box[3]), 0)
            least = dx * dx + dy * dy
            first = least.argmin(1)
            most = ((lx[first] - x) ** 2 + (ly[first] - y) ** 2).min(1)
            who, leaf = np.nonzero(least <= most[:, None])
            d, position = np.full(len(some), np.inf), np.full(len(some), len(px))
            for i in range(0, len(who), 65_536):
                w, f = who[i : i + 65_536], leaf[i : i + 65_536]
                far = (lx[f] - x[w]) ** 2 + (ly[f] - y[w]) ** 2
                near = far.min(1)
                place = np.where(far == near[:, None], held[f], len(px)).min(1)
                order = np.lexsort((place, near, w))
                order = order[np.append(True, np.diff(w[order]) > 0)]
                w, near, place = w[order], near[order], place[order]
                better = (near < d[w]) | ((near == d[w]) & (place < position[w]))
                d[w[better]], position[w[better]] = near[better], place[better]
            at[some], best[some] = position, d
    rest = np.flatnonzero(~(tree & np.isfinite(best)))
    if len(rest):
        centres, back = np.unique(np.stack([qx[rest], qy[rest]]), axis=1, return_inverse=True)
        for n, (x, y) in enumerate(centres.T):
            far = (px - x) ** 2 + (py - y) ** 2
            found = int(np.lexsort((far, lost))[0])
            of = rest[back.ravel() == n]
            at[of], best[of] = found, far[found]
    return at, best


def nearest_chunk(images: DataFrame, chunks_: DataFrame) -> DataFrame:
    """image_id and chunk_id: the chunk at the same page and box, else the one of least page distance and then centre distance.

    Both sides have doc_id, page and bbox.  Chunks of one centre count once, by the least chunk_index.  An image meets the
    centres of the pages nearest to its own (all pages, if it has none): up to ``FEW`` of a page as one list,
    more in blocks of ``BLOCK`` in which a tree finds the nearest, so that no step grows with images times chunks.
    """
    c = F.col
    mid = lambda box, lo, hi: (c(box)[lo] + c(box)[hi]) / 2
    centred = lambda df, box: df.withColumns({"x": mid(box, "x0", "x1"), "y": mid(box, "top", "bottom")}).withColumns(
        {a: F.when(c("x").isNotNull() & c("y").isNotNull(), c(a)) for a in ("x", "y")})
    i = images.select(c("doc_id").alias("image_doc"), "image_id", c("page").alias("image_page"), c("bbox").alias("image_box"))
    held = chunks_.select("doc_id", "chunk_id", "chunk_index", c("page_num").alias("page"), "bbox").filter("doc_id is not null")
    first = F.min(F.struct("chunk_index", "chunk_id")).alias("first")
    here = (c("image_doc") == c("doc_id")) & c("wanted").eqNullSafe(c("page"))

    same = held.groupBy("doc_id", "page", "bbox").agg(first)
    exact = i.join(same, (c("image_doc") == c("doc_id")) & c("image_page").eqNullSafe(c("page")) & c("image_box").eqNullSafe(c("bbox")))
    exact = exact.select("image_doc", "image_id", F.lit(1).alias("exact"), F.abs(c("image_page") - c("page")).alias("pages"), F.lit(0.0).alias("distance"), "first")

    points = centred(held, "bbox").groupBy("doc_id", "page", "x", "y").agg(first)
    pages = points.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    near = W.partitionBy("image_doc", "image_page").orderBy(F.asc_nulls_last("pages"))
    met = i.select("image_doc", "image_page").distinct().join(pages, c("image_doc") == c("doc_id")).withColumn("pages", F.abs(c("image_page") - c("page")))
    met = met.withColumn("__n", F.rank().over(near)).filter("__n = 1").select(c("image_doc").alias("met_doc"), c("image_page").alias("met_page"), c("page").alias("wanted"), "pages", "n")
    asked = centred(i, "image_box").join(met, (c("image_doc") == c("met_doc")) & c("image_page").eqNullSafe(c("met_page")))
    asked = asked.select("image_doc", "image_id", "wanted", "pages", "n", c("x").alias("image_x"), c("y").alias("image_y"))

    size = pages.select(c("doc_id").alias("image_doc"), c("page").alias("wanted"), c("n").alias("of"))
    sized = points.join(size, here).drop("image_doc", "wanted")
    lists = sized.filter(c("of") <= FEW).groupBy("doc_id", "page").agg(F.collect_list(F.struct("x", "y", "first")).alias("points"))
    away = lambda p: F.pow(c("image_x") - p["x"], F.lit(2)) + F.pow(c("image_y") - p["y"], F.lit(2))
    listed = asked.filter(c("n") <= FEW).join(lists, here).withColumn("best", F.array_min(F.transform("points", lambda p: F.struct(away(p).isNull(), away(p).alias("d"), p["first"].alias("first")))))
    listed = listed.select("image_doc", "image_id", F.lit(0).alias("exact"), "pages", c("best.d").alias("distance"), c("best.first").alias("first"))

    blocks = lambda n: F.ceil(c(n) / BLOCK).cast("int")
    dealt = lambda n, *key: F.pmod(F.xxhash64(*key), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    many = asked.filter(c("n") > FEW)
    crowd = many.groupBy("image_doc", "wanted").agg(F.count(F.lit(1)).alias("images"))
    crowd = crowd.select(c("image_doc").alias("doc_id"), c("wanted").alias("page"), "images")
    left = many.join(crowd, here).drop("doc_id", "page").withColumns({"mine": dealt("images", "image_id"), "other": every("n")})
    right = sized.filter(c("of") > FEW).join(crowd.select(c("doc_id").alias("image_doc"), c("page").alias("wanted"), "images"), here)
    right = right.select("doc_id", "page", "x", "y", c("first.chunk_index").alias("chunk_index"), c("first.chunk_id").alias("chunk_id"), dealt("of", "x", "y").alias("other"), every("images").alias("mine"))
    kept = ["image_doc", "image_id", "pages"]

    def search(some: pa.Table, of: pa.Table) -> pa.Table:
        if not some.num_rows or not of.num_rows:
            return some.select(kept).slice(0, 0).append_column("distance", pa.array([], pa.float64())).append_column("chunk_index", of["chunk_index"].slice(0, 0)).append_column("chunk_id", of["chunk_id"].slice(0, 0))
        of = of.take(pc.sort_indices(of, sort_keys=[("chunk_index", "ascending"), ("chunk_id", "ascending")], null_placement="at_start"))
        none, lost = some["image_x"].is_null().to_numpy(), of["x"].is_null().to_numpy()
        at, far = nearest(*(t[k].to_numpy().astype(float) for t, k in ((some, "image_x"), (some, "image_y"), (of, "x"), (of, "y"))), lost)
        at[none] = 0
        return pa.table([*some.select(kept).columns, pa.array(far, mask=none | lost[at]), *of.select(["chunk_index", "chunk_id"]).take(at).columns], names=[*kept, "distance", "chunk_index", "chunk_id"])

    kinds = {f.name: f.dataType for f in left.schema.fields + right.schema.fields}
    made = T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in (*kept, "distance", "chunk_index", "chunk_id")])
    treed = left.groupBy("image_doc", "wanted", "other", "mine").cogroup(right.groupBy("doc_id", "page", "other", "mine")).applyInArrow(search, made)
    treed = treed.select("image_doc", "image_id", F.lit(0).alias("exact"), "pages", "distance", F.struct("chunk_index", "chunk_id").alias("first"))
    order = W.partitionBy("image_doc", "image_id").orderBy(F.desc("exact"), F.asc_nulls_last("pages"), F.asc_nulls_last("distance"), "first")
    best = exact.unionByName(listed).unionByName(treed).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return best.select(c("image_doc").alias("doc_id"), "image_id", c("first.chunk_id").alias("chunk_id"))


def table_health(tables: DataFrame, grid: str = "grid") -> DataFrame:
    """Rows, whether all have one width, and the share of empty cells of each table."""
    cells = F.flatten(grid)
    widths = F.array_distinct(F.transform(F.col(grid), F.size))
    empty = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""))
    return tables.select("table_id", F.size(grid).alias("rows"), F.array_sort(widths).alias("widths"), (F.size(widths) == 1).alias("consistent"), F.try_divide(empty, F.size(cells)).alias("empty_rate"))


def layout_chunks(pieces: DataFrame) -> DataFrame:
    """Chunks of a layout chunker's pieces (doc_id, piece, text, headings, labels, page): headings in front, a flag for each kind of content."""
    head = F.array_join(F.coalesce("headings", F.array().cast("array<string>")), "\n")
    has = lambda *kinds: F.exists("labels", lambda x: x.isin(*kinds))
    text = F.when(head != "", F.concat(head, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    rows = pieces.select(
        "doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("piece")) - 1).alias("chunk_index"), text.alias("text"), "headings", F.col("page").alias("page_num"),
        has("table").alias("contains_table"), has("text", "paragraph", "list_item", "title", "section_header").alias("contains_text"), has("picture", "figure").alias("contains_figure"), has("formula", "equation").alias("contains_equation"),
    )
    return rows.withColumn("chunk_id", draft_chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))
