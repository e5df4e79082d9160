"""Main text of web pages: markup is read into lines, and pages are compared with their neighbours.

1. Each page's HTML is read once into lines, one per block, with what its elements say of
   them: inside an article, or inside a menu, header, footer, sidebar, notice, advert,
   form or comment.
2. Pages of a host stand in order of URL path. Each is paired with the neighbour, before or
   behind it, whose path has the longest beginning in common with its own.
3. The lines of a pair are aligned by a longest common subsequence. Lines they share belong to
   the template and go; all others stay, inside an article element or not. Inside one, a line goes only if
   the neighbour on the other side shares it too, since two pages may carry the same sentence;
   a neighbour with wholly the same article, under another address, says nothing of its lines.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import discard, rows, written
from eventloom.llm.url_rules import host_of, path_of

# Elements by what HTML says they are, and words that name parts of a page.
RAW = set("script style textarea title noscript template iframe svg math object canvas xmp noframes noembed".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
SPACES = {"br", "td", "th"}
OUTSIDE = set("nav footer aside form menu dialog button select datalist fieldset head".split())
PARTS = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice alert popup modal overlay newsletter "
    "subscribe signup social share sharing related recommended comment comments respond disqus widget pagination pager "
    "toolbar login search banner copyright".split()
)
# Of these, words that name the layout of a whole page as often as a part of it.
LAYOUT = set(
    "sidebar aside nav navbar navigation menu social share sharing search masthead banner notice alert login toolbar widget "
    "cookie cookies consent header".split()
)
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
WRAPPERS = {"html", "body", "article", "main"}

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


#: How sure an element is a part: not at all; by a word that may name the layout, or as a form; beyond doubt.
NO_PART, MAYBE, SURELY = 0, 1, 2


def is_part(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds a part of the page other than its article.

    ``MAYBE`` holds until an article or main element begins inside, as in a form or a column layout
    around the whole page.
    """
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return MAYBE if tag == "form" else SURELY
    if not attributes or attributes.isspace():
        return NO_PART
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return SURELY
    if re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("role", "").lower() in ROLES:
        return SURELY
    if tag in WRAPPERS - {"article"}:
        return NO_PART
    sure = NO_PART
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in NAME_PARTS.findall(name)}
        if {"has", "with", "no", "without"} & words:
            continue
        if (PARTS - LAYOUT) & words:
            return SURELY
        # An article is not called after the layout, but after what it is about.
        if tag != "article" and (PARTS & words or "header" in words and not in_article):
            sure = MAYBE
    return sure


def lines_of(page: str | None) -> list[tuple[str, bool]]:
    """(text, inside an article) of each block that is no other part of the page.

    Character references are decoded; white space, line breaks and cell borders count as
    one space. Elements left open end with the one around them.
    """
    source = page or ""
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    at = 0
    article, part = False, NO_PART

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and not part:
            lines.append((text, article))

    while True:
        found = TOKEN.search(source, at)
        parts.append(source[at : found.start() if found else len(source)])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in SPACES:
            parts.append(" ")
        if tag in BLOCKS:
            close()
        if found[1]:
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if opened is not None:
                _, article, part = stack[opened]
                del stack[opened:]
        elif tag in RAW:
            if not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
        elif tag not in VOID:
            if tag == "p":
                opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
                if opened is not None and stack[opened][0] == "p":
                    _, article, part = stack[opened]
                    del stack[opened:]
            stack.append((tag, article, part))
            if tag in ("article", "main") and part == MAYBE:
                part = NO_PART
            part = max(part, is_part(tag, found[3], article))
            article = article or tag in ("article", "main")
    close()
    return lines


#: Bits of the table that an alignment keeps; a larger one is halved first.
MOST_BITS = 1 << 30


def bit_vectors(left: Sequence[str], right: Sequence[str]) -> Iterator[int]:
    """After each line of ``right``: a 0 bit at each line of ``left`` where the common length grows."""
    where: dict[str, int] = {}
    for i, line in enumerate(left):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(left)) - 1
    vector = full
    for line in right:
        matched = vector & where.get(line, 0)
        vector = ((vector + matched) | (vector - matched)) & full
        yield vector


def common_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Length of a longest common subsequence of ``right`` with each beginning of ``left``."""
    last = (1 << len(left)) - 1
    for last in bit_vectors(left, right):
        pass
    data = np.frombuffer(last.to_bytes(len(left) // 8 + 1, "little"), np.uint8)
    bits = np.unpackbits(data, bitorder="little")[: len(left)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def aligned(left: Sequence[str], right: Sequence[str]) -> list[int]:
    """Places in ``left`` of a longest common subsequence with ``right``."""
    if len(left) * len(right) > MOST_BITS and len(right) > 1:
        half = len(right) // 2
        before = common_lengths(left, right[:half])
        behind = common_lengths(left[::-1], right[half:][::-1])[::-1]
        cut = int((before + behind).argmax())
        return aligned(left[:cut], right[:half]) + [cut + i for i in aligned(left[cut:], right[half:])]
    vectors = [(1 << len(left)) - 1, *bit_vectors(left, right)]
    i, j, places = len(left), len(right), []
    while i and j:
        if vectors[j] >> (i - 1) & 1:
            i -= 1
        elif not vectors[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            places.append(i)
    return places[::-1]


def shared_lines(left: Sequence[str], right: Sequence[str]) -> list[int]:
    """Places in ``left`` of a longest common subsequence, by bit vectors of lines."""
    first = 0
    while first < min(len(left), len(right)) and left[first] == right[first]:
        first += 1
    last = 0
    while last < min(len(left), len(right)) - first and left[-1 - last] == right[-1 - last]:
        last += 1
    ends = [*range(first), *range(len(left) - last, len(left))]
    a, b = left[first : len(left) - last], right[first : len(right) - last]
    common = set(a) & set(b)
    kept = [(i, line) for i, line in enumerate(a) if line in common]
    b = [line for line in b if line in common]
    middle = [kept[i][0] + first for i in aligned([line for _, line in kept], b)]
    return sorted(ends + middle)


def template_lines(lines: list[dict], neighbour: list[dict] | None, second: list[dict] | None) -> set[int]:
    """Places of the lines that the neighbour shares; in an article, of those that both neighbours share."""
    texts = [line["text"] for line in lines]
    inside = {i for i, line in enumerate(lines) if line["article"]}
    template = set(shared_lines(texts, [line["text"] for line in neighbour or []]))
    if repeated := template & inside:
        own = [texts[i] for i in sorted(inside)]
        told = [n for n in (neighbour, second) if n and [line["text"] for line in n if line["article"]] != own]
        both = set(shared_lines(texts, [line["text"] for line in second])) if len(told) == 2 else set()
        template -= repeated - both
    return template


def main_text(lines: list[dict], neighbour: list[dict] | None, second: list[dict] | None = None) -> str:
    """The lines that do not belong to the template."""
    template = template_lines(lines, neighbour, second)
    return "\n\n".join(line["text"] for i, line in enumerate(lines) if i not in template)


PRINTS = "array<struct<text:bigint,article:boolean>>"


def line_hash(text: str) -> int:
    """A signed 64-bit number that stands for a line where pages are compared."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def neighbours(pages: DataFrame) -> DataFrame:
    """key, near and far: each page's key, that of the page with the nearest path on its host, and the other side's.

    ``pages`` has key, host and path, a row per key. Pages are dealt out in ranges of the
    order, so a large host is spread over many tasks; the first and last row of each range find
    their neighbours across the border among those rows alone. The path behind a pair
    with equally long beginnings in common goes to the row before. A host of one page has none;
    far is null for the first and last page of a host.
    """
    order = ["host", "path", "key"]
    ranged = written(
        pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    here = F.struct("host", "path", "key")
    inside = Window.partitionBy("part").orderBy(*order)
    found = ranged.select(
        "part", *order, F.lag(here).over(inside).alias("before"), F.lead(here).over(inside).alias("behind")
    )
    at_border = F.col("before").isNull() | F.col("behind").isNull()
    across = Window.orderBy("part", *order)
    border = found.where(at_border).select(
        *order,
        F.coalesce("before", F.lag(here).over(across)).alias("before"),
        F.coalesce("behind", F.lead(here).over(across)).alias("behind"),
    )
    both = found.where(~at_border).select(*border.columns).unionByName(border)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = [], []
            for host, path, before, behind in rows([batch], "host", "path", "before", "behind"):
                candidates = [
                    (-len(os.path.commonprefix([path, n["path"]])), i, n["key"])
                    for i, n in enumerate((before, behind)) if n and n["host"] == host
                ]
                near.append(min(candidates)[2] if candidates else None)
                far.append(max(candidates)[2] if len(candidates) > 1 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(near, pa.int64()), pa.array(far, pa.int64())], ["key", "near", "far"]
            )

    return both.mapInArrow(choose, "key bigint, near bigint, far bigint").where("near IS NOT NULL")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null html is empty. A null URL, or one without ``://``, belongs to the host "". Repeated
    rows are one page to the comparison and each get its text.
    """
    keyed = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)).alias("key"),
    )

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.int64()), ("article", pa.bool_())]))
        for batch in batches:
            found = [[{"text": line_hash(t), "article": a} for t, a in lines_of(h)] for (h,) in rows([batch], "html")]
            columns = [batch.column("key"), batch.column("url"), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "url", "prints"])

    # Pages are compared by hashes of their lines; their texts are read again at the end and not kept until then.
    hashed = keyed.select("key", "url", "html").mapInArrow(prints_of, f"key bigint, url string, prints {PRINTS}")
    once = written(hashed.dropDuplicates(["key"]), "page-prints")
    near = neighbours(once.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    own = once.select("key", "prints")
    other = once.select(F.col("key").alias("near"), F.col("prints").alias("other"))
    second = once.select(F.col("key").alias("asked"), F.col("prints").alias("second"))
    told = near.join(other, "near", "left").join(second, F.col("far") == F.col("asked"), "left").select("key", "other", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(template_lines(*of)) for of in rows([batch], "prints", "other", "second")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int32()))], ["key", "template"])

    compared = own.join(told, "key").select("key", "prints", "other", "second")
    template = written(compared.mapInArrow(compare, "key bigint, template array<int>").where("size(template) > 0"), "templates")
    discard(once)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t for t, _ in lines_of(h)] for (h,) in rows([batch], "html")]
            kept = batch.drop_columns(["html"])
            lines = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*kept.columns, lines], [*kept.schema.names, "lines"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lines, places in rows([batch], "lines", "template"):
                gone = set(places or ())
                texts.append("\n\n".join(line for i, line in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    id_type = keyed.schema["page_id"].dataType.simpleString()
    lines = keyed.mapInArrow(read, f"page_id {id_type}, url string, key bigint, lines array<string>")
    schema = f"page_id {id_type}, url string, text string, n_chars bigint"
    return lines.join(template, "key", "left").select("page_id", "url", "lines", "template").mapInArrow(joined, schema)
