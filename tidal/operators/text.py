"""Text jobs: HTML to lines, sentence split, greedy chunk packing, truncation, validation.

Every document is processed whole inside one row with higher-order array
functions (``split``/``filter``/``transform``/``aggregate``), so the work is
spread over Spark tasks by document and never leaves the JVM.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidal.functions.scalar import clean_text

# Chunk size bounds (characters) and line-length filters.
MIN_CHUNK_CHARS = 150
MAX_CHUNK_CHARS = 800
MIN_LINE_CHARS = 40          # lines kept when longer than this (main page variant)
MIN_LINE_CHARS_STRICT = 50   # lines kept when longer than this (truncated variant)
MIN_SENTENCE_CHARS = 30
TRUNCATE_LINES = 50
TRUNCATE_CHARS = 3000

# Line breaks recognised when splitting text into lines (Python ``splitlines``).
LINE_BREAKS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _code_point(code: Column) -> Column:
    """The character of a numeric reference: windows-1252 for 128 to 159, U+FFFD for what is no character."""
    old = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}
    table = F.from_json(F.lit(json.dumps(old)), "map<string,string>")
    none = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    # UTF-8 bytes from the bits of the code point
    def byte(mark, shift, keep):
        return F.lpad(F.hex(F.lit(mark).bitwiseOR(F.shiftright(code, shift).bitwiseAND(keep))), 2, "0")
    tail = [byte(0x80, s, 0x3F) for s in (0, 6, 12)]
    utf8 = (F.when(code < 0x80, byte(0, 0, 0x7F))
            .when(code < 0x800, F.concat(byte(0xC0, 6, 0x1F), tail[0]))
            .when(code < 0x10000, F.concat(byte(0xE0, 12, 0x0F), tail[1], tail[0]))
            .otherwise(F.concat(byte(0xF0, 18, 0x07), tail[2], tail[1], tail[0])))
    return F.when(none, "\ufffd").otherwise(
        F.coalesce(F.try_element_at(table, code.cast("string")), F.decode(F.unhex(utf8), "UTF-8")))


def decode_references(text: Column, unended: bool = False) -> Column:
    """Every character reference decoded once: all HTML 5 names and decimal or hexadecimal numbers.

    References end with a semicolon; with ``unended``, numbers and the old names (``&amp``, ``&copy``) need none: without
    a full name, the longest old name that the text begins with counts, as in HTML 5.  Unknown names stay as they are.
    """
    first = ("amp", "nbsp", "quot", "lt", "gt", "apos", "copy", "middot")  # the most frequent ones are found first
    names = {n: html5[f"{n};"] for n in first} | {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    old = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))  # longest first

    def number(ref: Column) -> Column:
        base = F.when(F.substring(ref, 2, 1).isin("x", "X"), 16).otherwise(10)
        digits = F.when(base == 16, F.substring(ref, 3, 12)).otherwise(F.substring(ref, 2, 12))
        code = F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return _once(code, _code_point)

    def char(ref: Column) -> Column:
        return F.when(ref == "", None).when(ref.startswith("#"), number(ref)).otherwise(F.try_element_at(table, ref))

    def without_semicolon(s: Column) -> Column:
        def use(name):
            return F.when(name != "", F.concat(F.try_element_at(table, name), F.substring(s, F.length(name) + 1, F.length(s))))
        return _once(F.regexp_extract(s, f"^(?:{'|'.join(old)})", 0), use)

    end = ";?" if unended else ";"
    ref_number = rf"#[0-9]{{1,12}}{end}|#[xX][0-9a-fA-F]{{1,8}}{end}"

    def piece(s: Column) -> Column:
        def use(ref):
            return F.concat(char(F.rtrim(ref, F.lit(";"))), F.substring(s, F.length(ref) + 1, F.length(s)))
        found = _once(F.regexp_extract(s, rf"^(?:{ref_number}|[A-Za-z][A-Za-z0-9]*;)", 0), use)
        old_name = [without_semicolon(s)] if unended else []
        return F.coalesce(found, *old_name, F.concat(F.lit("&"), s))

    def joined(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))

    return _once(F.split(text, "&"), joined)


# The rest of a tag after its name: an equals sign may be followed by a quoted value, in which ``>`` is text.
# Possessive throughout: the matcher loops over attributes instead of recursing, and never tries a tag twice.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
_TAG = r"""</?[a-z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_OPEN = rf"</?[a-z]{_ATTRIBUTES}"  # a tag that the page ends in is no text
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))|<[!?][^>]*+(?:>|\z)|</[^a-z][^>]*+(?:>|\z)"


def html_text(html: Column, drop_tags=("script", "style"), open_body: bool = False) -> Column:
    """Body text with the given elements and comments removed, tags turned into line breaks.

    One pass from left to right reads comments, elements whose content is no markup (``drop_tags``), declarations and
    tags with quoted attributes; a ``<`` that opens none of them is text.  What is not closed runs to the end of the page; a
    quote without its partner ends with the tag.  A page without a body counts whole; so does one whose body has no
    end tag, unless ``open_body`` lets it run to the end of the page.
    """
    raw = rf"<({'|'.join(drop_tags)})(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1(?=[\s/>]){_ATTRIBUTES}|\z)"
    # U+0000 keeps what stood apart from growing together to a new tag
    marked = F.regexp_replace(F.translate(html, "\0", ""), rf"(?is){raw}|{_COMMENT}|({_TAG})|{_OPEN}", "$2\0")
    end = r"</body[\s/>]|\z" if open_body else r"</body[\s/>]"
    body = F.regexp_extract(marked, rf"(?is)<body(?=[\s/>]){_ATTRIBUTES}.*?(?={end})", 0)
    marked = F.coalesce(F.nullif(body, F.lit("")), marked)
    return decode_references(F.translate(F.regexp_replace(marked, rf"(?is){_TAG}\x00", "\n"), "\0", ""), unended=True)


def text_lines(text: Column, min_chars: int) -> Column:
    """Cleaned non-empty lines longer than ``min_chars`` (array, in order)."""
    lines = F.transform(F.split(text, LINE_BREAKS), lambda s: clean_text(s))
    return F.filter(lines, lambda s: F.length(s) > min_chars)


def html_to_lines(pages: DataFrame, html: str = "html", min_chars: int = MIN_LINE_CHARS,
                  drop_tags=("script", "style")) -> DataFrame:
    """One row per kept line: page columns + ``line_no`` + ``line``."""
    arr = text_lines(html_text(F.col(html), drop_tags), min_chars)
    # the outer form plus a filter on its result: a plain explode would compute the array once more in a filter of its own
    lines = pages.select(*[c for c in pages.columns if c != html], F.posexplode_outer(arr).alias("line_no", "line"))
    return lines.filter(F.col("line").isNotNull())


def sentences(text: Column) -> Column:
    """Split cleaned text at whitespace that follows a period; keep pieces longer than 30."""
    parts = F.split(clean_text(F.regexp_replace(text, "\n", " ")), r"(?<=[.])\s+")
    parts = F.transform(parts, lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > MIN_SENTENCE_CHARS)


def chunk_starts(segments: Column, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Start index of every greedy chunk (one ``aggregate`` folding only integers).

    A new chunk starts at the first piece and whenever
    ``cur_len + len(piece) + 1 > max_chars`` (``cur_len`` counts one
    separator per piece), so a packed chunk is at most ``max_chars - 1``
    characters unless a single piece is longer.
    """
    init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("cur_len"),
                    F.lit(0).alias("i"))

    def step(acc, s):
        n = F.length(s)
        new = (acc["cur_len"] == 0) | (acc["cur_len"] + n + 1 > max_chars)
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(new, n + 1).otherwise(acc["cur_len"] + n + 1).alias("cur_len"),
            (acc["i"] + 1).alias("i"))

    return F.aggregate(segments, init, step, lambda acc: acc["starts"])


def chunks_from_starts(segments: Column, starts: Column, min_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Chunk texts (pieces joined by one space), dropping chunks shorter than ``min_chars``.

    ``starts`` must be a column computed in an earlier projection: it is
    referenced inside the lambda, and a lambda re-evaluates any expression it
    references for every element.
    """
    def build(st, j):
        end = F.when(j + 1 < F.size(starts), F.element_at(starts, j + 2)).otherwise(F.size(segments))
        return F.array_join(F.slice(segments, st + 1, end - st), " ")

    return F.filter(F.transform(starts, build), lambda c: F.length(c) >= min_chars)


def pack_chunks(df: DataFrame, segments: Column, keep_cols: list[str],
                min_chars: int = MIN_CHUNK_CHARS, max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Greedy in-order packing: one row per chunk with ``keep_cols`` + ``chunk_no`` + ``content``."""
    s = df.select(*keep_cols, segments.alias("_segs"))
    s = s.select(*keep_cols, "_segs", chunk_starts(F.col("_segs"), max_chars).alias("_starts"))
    chunks = chunks_from_starts(F.col("_segs"), F.col("_starts"), min_chars)
    return s.select(*keep_cols, F.posexplode(chunks).alias("chunk_no", "content"))


def truncate_doc(html: Column) -> Column:
    """First 50 long lines (> 50 chars, nav/footer removed) joined by a space; NULL if < 150; cut at 3000."""
    lines = text_lines(html_text(html, ("script", "style", "nav", "footer")), MIN_LINE_CHARS_STRICT)
    content = F.array_join(F.slice(lines, 1, TRUNCATE_LINES), " ")
    return F.when(F.length(content) >= MIN_CHUNK_CHARS, F.substring(content, 1, TRUNCATE_CHARS))


def validate_chunks(chunks: DataFrame, allowed_sources: list[str], by: str = "source") -> DataFrame:
    """Per source: chunk count and counts of each failed check, plus an all-valid flag."""
    blank = F.col("content").isNull() | (F.length(F.trim(F.col("content"))) == 0)
    bad_src = ~F.coalesce(F.col("source").isin(*allowed_sources), F.lit(False))
    bad_url = ~F.coalesce(F.col("url").startswith("http"), F.lit(False))
    missing = F.col("topic").isNull()
    out = chunks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(blank.cast("int")).alias("n_blank"),
        F.sum(bad_src.cast("int")).alias("n_bad_source"),
        F.sum(bad_url.cast("int")).alias("n_bad_url"),
        F.sum(missing.cast("int")).alias("n_missing_topic"))
    ok = (F.col("n_blank") + F.col("n_bad_source") + F.col("n_bad_url") + F.col("n_missing_topic")) == 0
    return out.withColumn("valid", ok)


def range_bucket(df: DataFrame, column: str, out: str = "_range", buckets: int = 1024) -> DataFrame:
    """``df`` with the number (0 to ``buckets``) of the range of about equally many rows that ``column`` falls into.

    ``column`` must be numeric.  The bounds, at most ``buckets`` numbers, come
    from a sketch of fixed size and cover all rows, however the values lie.
    """
    from pyspark.ml.feature import Bucketizer
    at = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(F.col(column).cast("double"), at, 10 * buckets)).first()[0] or []
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    cut = Bucketizer(splits=splits, inputCol=f"{out}_of", outputCol=out, handleInvalid="keep")
    return cut.transform(df.withColumn(f"{out}_of", F.col(column).cast("double"))).drop(f"{out}_of")


def global_index(df: DataFrame, order: list[str], bucket: Column, out: str = "idx",
                 partition_by: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of each row in ``order`` (within ``partition_by``), without a global sort.

    ``bucket`` must be monotone in the order and of a bounded number of values
    (``range_bucket``, or a hash prefix when ordering by that hash).  Rows are
    ranked inside their bucket; bucket offsets come from a per-bucket count
    table (one row per partition value and bucket) whose running sum is
    broadcast back.  No task ever sees more than one bucket of the rows.
    """
    parts = list(partition_by)
    b = df.withColumn("_bucket", bucket)
    local = F.row_number().over(Window.partitionBy(*parts, "_bucket").orderBy(*order)) - 1
    counts = b.groupBy(*parts, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*parts).orderBy("_bucket") if parts else Window.orderBy("_bucket")
    offsets = counts.select(*parts, "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(*parts)).alias(f"{out}_total")
                            if parts else F.sum("_n").over(Window.partitionBy()).alias(f"{out}_total"))
    return (b.withColumn("_local", local).join(F.broadcast(offsets), [*parts, "_bucket"])
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_bucket", "_local", "_off"))
