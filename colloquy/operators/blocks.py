"""Finding embedded code, schema and markup blocks, and safe views of the text.

Detection moves offsets only: candidates and line marks are a few integers each,
put in order per text. Texts themselves meet them once, in the final join, and only
texts that have a block. Every per-text group is bounded by one stored text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import text as tx

# Block patterns, kinds and size limits.
FENCE = r"(?msdU)^(`{3,}|~{3,})[^\n]*\n(.*?)^\1\s*$"
JSON_SCHEMA = (
    r'(?sU)(\{[^{}]{0,200}"type"\s*:\s*"object".*?\}'
    r'|\{[^{}]{0,200}"properties"\s*:\s*\{.*?\}\s*\})'
)
XML_TAG = r"(?U)</?[\w:-]+[\s>]"
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85  ])"
CANDIDATE = r'(?mU)^(?:```|~~~)|"type"|"properties"|</?[\w:-]'
MIN_CHARS = 400
MIN_LINES = 6
MIN_SCHEMA_LINES = 8
MIN_XML_LINES = 4
KINDS = ("fenced_code", "json_schema_like", "xml_like")
PLACEHOLDER = r"\[ARCHIVED_BLOCK_\d+\]"
MESSAGE_MARK = r"(?imdU)^(user|assistant)\s*:"


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _pattern_spans(texts: DataFrame, key: str, text: str, pattern: str, kind: str) -> DataFrame:
    """Offsets of every match of ``pattern``.

    The pieces between matches and the matches alternate, so running lengths give
    the offsets; only texts with a match produce rows.
    """
    found = (
        texts.select(
            key,
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_hits"),
            F.split(F.col(text), pattern, -1).alias("_gaps"),
        )
        .where(F.size("_hits") > 0)
        .select(key, F.posexplode(F.arrays_zip("_hits", "_gaps")).alias("_n", "_pair"))
        .select(
            key,
            "_n",
            F.length("_pair._gaps").alias("_gap"),
            F.length("_pair._hits").alias("_hit"),
            line_count(F.col("_pair._hits")).alias("line_count"),
        )
    )
    before = Window.partitionBy(key).orderBy("_n")
    end = F.sum(F.coalesce("_gap", F.lit(0)) + F.coalesce("_hit", F.lit(0))).over(before)
    return (
        found.withColumn("end_at", end)
        .where(F.col("_hit").isNotNull())
        .select(
            key,
            F.lit(kind).alias("block_kind"),
            (F.col("end_at") - F.col("_hit")).alias("start_at"),
            "end_at",
            F.col("line_count").cast("bigint").alias("line_count"),
        )
    )


def fenced_blocks(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Blocks between equal fences of three or more backticks or tildes."""
    return _pattern_spans(texts, key, text, FENCE, KINDS[0])


def json_schema_blocks(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Schema-shaped JSON of at least eight lines."""
    return _pattern_spans(texts, key, text, JSON_SCHEMA, KINDS[1]).where(
        F.col("line_count") >= MIN_SCHEMA_LINES
    )


def text_lines(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One narrow row per line: offsets, tag flag and speaker marker, but no text."""
    line = F.col("_line")
    begins = F.lower(tx.strip(line))
    marker = F.when(begins.startswith("user:"), "user").when(
        begins.startswith("assistant:"), "assistant"
    )
    lines = texts.select(
        key, F.posexplode(F.split(F.col(text), LINE_END, -1)).alias("line_no", "_line")
    ).select(
        key,
        "line_no",
        F.length(line).alias("_length"),
        line.rlike(XML_TAG).alias("is_tag"),
        line.endswith("\n").alias("_breaks"),
        marker.alias("marker"),
    )
    order = Window.partitionBy(key).orderBy("line_no")
    return lines.where(F.col("_length") > 0).withColumn(
        "end_at", F.sum("_length").over(order)
    ).withColumn("start_at", F.col("end_at") - F.col("_length"))


def xml_blocks(lines: DataFrame, key: str = "id") -> DataFrame:
    """Runs of four or more lines in a row that hold a tag; input as ``text_lines``."""
    order = Window.partitionBy(key).orderBy("line_no")
    return (
        lines.where("is_tag")
        .withColumn("_run", F.col("line_no") - F.row_number().over(order))
        .groupBy(key, "_run")
        .agg(
            F.count("*").alias("_lines"),
            F.min("start_at").alias("start_at"),
            F.max("end_at").alias("end_at"),
            (F.count_if("_breaks") + 1).alias("line_count"),
        )
        .where(F.col("_lines") >= MIN_XML_LINES)
        .select(key, F.lit(KINDS[2]).alias("block_kind"), "start_at", "end_at", "line_count")
    )


def _drop_overlapping(accepted: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Add the spans of ``later`` that overlap no accepted span.

    Accepted spans do not overlap one another, so the last one that starts before
    a span ends decides; a running maximum finds its end without a self-join.
    """
    tagged = accepted.select("*", F.lit(True).alias("_old"), F.col("start_at").alias("_at"))
    tagged = tagged.unionByName(
        later.select("*", F.lit(False).alias("_old"), F.col("end_at").alias("_at"))
    )
    so_far = (
        Window.partitionBy(key)
        .orderBy("_at", "_old")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach = F.max(F.when(F.col("_old"), F.col("end_at"))).over(so_far)
    return (
        tagged.withColumn("_reach", reach)
        .where(F.col("_old") | F.col("_reach").isNull() | (F.col("_reach") <= F.col("start_at")))
        .select(*accepted.columns)
    )


def block_spans(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Accepted, numbered blocks with speaker; offsets and counts only.

    Fences win over schemas and schemas over markup; a block must have 400
    characters or six lines.
    """

    def large(spans: DataFrame) -> DataFrame:
        return spans.where(
            (F.col("end_at") - F.col("start_at") >= MIN_CHARS) | (F.col("line_count") >= MIN_LINES)
        )

    # Texts that cannot hold a block are told apart in their row.
    texts = texts.select(key, text).where(F.col(text).rlike(CANDIDATE))
    lines = text_lines(texts, key, text)
    accepted = large(fenced_blocks(texts, key, text))
    accepted = _drop_overlapping(accepted, large(json_schema_blocks(texts, key, text)), key)
    accepted = _drop_overlapping(accepted, large(xml_blocks(lines, key)), key)

    marks = lines.where(F.col("marker").isNotNull()).select(key, "start_at", "marker")
    both = accepted.withColumn("marker", F.lit(None).cast("string")).unionByName(
        marks, allowMissingColumns=True
    )
    # At equal offsets the block sorts first: its own first line is not above it.
    above = (
        Window.partitionBy(key)
        .orderBy("start_at", F.col("block_kind").isNull())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = Window.partitionBy(key).orderBy("start_at")
    return (
        both.withColumn("speaker", F.last("marker", ignorenulls=True).over(above))
        .where(F.col("block_kind").isNotNull())
        .withColumn("block_no", F.row_number().over(numbered).cast("bigint"))
        .select(
            key,
            "block_no",
            F.format_string("ARCHIVED_BLOCK_%d", "block_no").alias("block_id"),
            "block_kind",
            "speaker",
            "start_at",
            "end_at",
            "line_count",
            (F.col("end_at") - F.col("start_at")).alias("char_count"),
        )
    )


def archive_blocks(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``block_spans`` with the raw text of every block."""
    body = texts.select(key, F.col(text).alias("_text"))
    return (
        block_spans(texts, key, text)
        .join(body, key)
        .withColumn(
            "raw_text",
            F.col("_text").substr(F.col("start_at").cast("int") + 1, F.col("char_count").cast("int")),
        )
        .drop("_text")
    )


def inventory_line(speaker: Column) -> Column:
    return F.concat(
        F.lit("["), F.col("block_id"), F.lit("] kind="), F.col("block_kind"),
        F.lit(" speaker="), F.coalesce(speaker, F.lit("unknown")),
        F.lit(" lines="), F.col("line_count").cast("string"),
        F.lit(" chars="), F.col("char_count").cast("string"),
    )


def description_lines(description: Column) -> Column:
    """Extra inventory lines of a described block; empty parts are left out."""

    def listing(name: str) -> Column:
        items = description.getField(name)
        return F.when(
            F.size(items) > 0, F.concat(F.lit(f"  {name}="), F.array_join(items, ", "))
        )

    head = F.concat(
        F.lit("  block_kind="), F.coalesce(description.getField("block_kind"), F.lit("")),
        F.lit(" is_instruction_like="),
        F.coalesce(F.initcap(description.getField("is_instruction_like").cast("string")), F.lit("")),
        F.lit(" brief_description="),
        F.coalesce(description.getField("brief_description"), F.lit("")),
    )
    lines = F.array_compact(F.array(head, listing("mentions"), listing("commands"), listing("paths")))
    return F.when(description.isNotNull(), F.array_join(lines, "\n"))


def working_view(
    texts: DataFrame, blocks: DataFrame, key: str = "id", text: str = "text", mode: str = "inventory"
) -> DataFrame:
    """Replace blocks by ``[ARCHIVED_BLOCK_n]`` and list them below the text.

    ``mode`` "archival" adds the lines of ``archival_description``; "placeholder"
    leaves the list out. Texts without blocks come back as they are.
    """
    order = Window.partitionBy(key).orderBy("start_at")
    line = inventory_line(F.col("speaker"))
    if mode == "archival":
        line = F.concat_ws("\n", line, description_lines(F.col("archival_description")))
    per_text = (
        blocks.withColumn("_from", F.coalesce(F.lag("end_at").over(order), F.lit(0)))
        .withColumn("_line", line)
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.struct("block_no", "_from", "start_at", "block_id", "_line"))).alias("_blocks"),
            F.max("end_at").alias("_rest"),
        )
    )
    body = F.col(text)

    def kept(b: Column) -> Column:
        gap = body.substr((b["_from"] + 1).cast("int"), (b["start_at"] - b["_from"]).cast("int"))
        return F.concat(gap, F.lit("["), b["block_id"], F.lit("]"))

    spliced = F.concat(
        F.array_join(F.transform("_blocks", kept), ""),
        body.substr((F.col("_rest") + 1).cast("int"), F.length(body)),
    )
    if mode != "placeholder":
        listing = F.array_join(F.transform("_blocks", lambda b: b["_line"]), "\n")
        spliced = F.concat(spliced, F.lit("\n---ARCHIVED BLOCKS---\n"), listing)
    return texts.join(per_text, key, "left").select(
        *texts.columns,
        F.when(F.col("_blocks").isNull(), body).otherwise(spliced).alias("working_view"),
    )


def message_array(text: Column) -> Column:
    """ARRAY<STRUCT<speaker, body>> of the turns inside a rendered transcript."""
    marks = F.regexp_extract_all(text, F.lit(MESSAGE_MARK), F.lit(1))
    # The piece before the first mark belongs to nobody.
    bodies = F.transform(F.split(text, MESSAGE_MARK, -1), tx.strip)
    pairs = F.zip_with(
        F.concat(F.array(F.lit("")), marks),
        bodies,
        lambda m, b: F.struct(F.lower(m).alias("speaker"), b.alias("body")),
    )
    return F.filter(pairs, lambda p: (p["speaker"] != "") & (p["body"] != ""))


def split_by_message(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per turn of a transcript; none for a text without markers."""
    return texts.select(
        key, F.posexplode(message_array(F.col(text))).alias("turn_index", "_m")
    ).select(key, "turn_index", F.col("_m.speaker").alias("speaker"), F.col("_m.body").alias("body"))


# List and length limits of a block description.
DESCRIPTION_ITEMS = 8
DESCRIPTION_CHARS = 120


def describe_blocks(blocks: DataFrame) -> DataFrame:
    """Model-free description of each block: its counts, names, commands and paths."""
    raw = F.col("raw_text")

    def found(pattern: str, group: int = 0) -> Column:
        hits = F.regexp_extract_all(raw, F.lit(pattern), F.lit(group))
        return F.slice(F.array_distinct(hits), 1, DESCRIPTION_ITEMS)

    kind = (
        F.when(F.col("block_kind") == "xml_like", "xml")
        .when(F.col("block_kind") == "json_schema_like", "json_schema")
        .otherwise("code")
    )
    brief = F.concat(
        kind, F.lit(" block of "), F.col("line_count").cast("string"), F.lit(" lines and "),
        F.col("char_count").cast("string"), F.lit(" characters"),
    )
    return blocks.withColumn(
        "archival_description",
        F.struct(
            kind.alias("block_kind"),
            raw.rlike(r"(?im)^\s*(you are|you must|do not|never|always|ignore)\b").alias("is_instruction_like"),
            F.substring(brief, 1, DESCRIPTION_CHARS).alias("brief_description"),
            found(r"\b[A-Z][A-Za-z0-9]{2,}\b").alias("mentions"),
            found(r"(?m)^\s*\$\s+([^\n]+)", 1).alias("commands"),
            found(r"https?://[^\s\"'<>)]+|(?:[\w.-]+)?/[\w.-]+(?:/[\w.-]+)+").alias("paths"),
        ),
    )


def expand_placeholders(
    rows: DataFrame, blocks: DataFrame, row_key: list[str], extract_key: str, text: str = "text"
) -> DataFrame:
    """Replace placeholder tokens in statements by what the block is about.

    Only rows that hold a token are taken apart; an unknown token stays.
    """
    meaning = blocks.select(
        extract_key,
        F.concat(F.lit("["), F.col("block_id"), F.lit("]")).alias("_token"),
        F.coalesce(
            tx.null_if_empty(F.col("archival_description.brief_description")),
            F.format_string("%s (%d lines)", "block_kind", "line_count"),
        ).alias("_meaning"),
    )
    body = F.col(text)
    parts = (
        rows.where(body.rlike(PLACEHOLDER))
        .select(
            *row_key,
            F.posexplode(
                F.arrays_zip(
                    F.split(body, PLACEHOLDER, -1).alias("gap"),
                    F.regexp_extract_all(body, F.lit(PLACEHOLDER), F.lit(0)).alias("token"),
                )
            ).alias("_n", "_p"),
        )
        .select(*row_key, "_n", F.col("_p.gap").alias("_gap"), F.col("_p.token").alias("_token"))
        .join(meaning, [extract_key, "_token"], "left")
    )
    filled = F.coalesce("_meaning", "_token", F.lit(""))
    expanded = parts.groupBy(*row_key).agg(
        F.array_sort(F.collect_list(F.struct("_n", F.concat("_gap", filled).alias("_piece")))).alias("_pieces"),
        F.array_sort(
            F.collect_set(F.when(F.col("_meaning").isNotNull(), F.struct("_token", "_meaning")))
        ).alias("_notes"),
    )
    joined = F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "")
    notes = F.transform("_notes", lambda n: F.concat(F.lit("[Archived: "), n["_meaning"], F.lit("]")))
    return rows.join(expanded, row_key, "left").select(
        *[c for c in rows.columns if c != text],
        F.coalesce(joined, body).alias(text),
        F.coalesce(notes, F.array().cast("array<string>")).alias("notes"),
    )
