"""Operators 1 to 5 on source code: documentation pairs, file origin, syntax, credentials, splitting.

Null or empty texts, unknown languages, repeated rows, empty tables and extra columns never fail: an operator takes
the columns it names and ignores others; a null or blank text is valid, hand-written, free of credentials and
undocumented; repeated rows add nothing to results that are sets.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import map_rows
from . import docs, origin, secrets, splitter, syntax
from .lexer import language_of

_LONG = 5  # words of prose that make documentation real


# --- 1 -------------------------------------------------------------------------------------------------------------
def comment_blocks(files: DataFrame, max_gap: int = 0) -> DataFrame:
    """Comment and docstring spans of files that hold at least five words of prose: (file_id, first_line, last_line, from_line,
    to_line, kind, comment); what begins on a line from from_line to to_line may be what they document."""

    def row(file_id, path, language, content):
        spoken = language_of(path, language)
        if not spoken or not content:
            return
        for span in docs.comment_spans(content, spoken, max_gap):
            if docs.says_something(span[-1], None):
                yield file_id, *span

    return map_rows(
        files.select("file_id", "file_path", "language", "content"), row,
        "file_id bigint, first_line int, last_line int, from_line int, to_line int, kind string, comment string",
    )


def functions(symbols: DataFrame) -> DataFrame:
    """Functions and methods; 50-line windows that stand in where extraction failed are left out."""
    return symbols.filter(F.col("symbol_type").isin("function", "method") & ~F.col("name").rlike(r"^chunk_\d+$"))


_STRETCH = 64  # lines; the join key is a file and a stretch of its lines


def documented(symbols: DataFrame, files: DataFrame, max_gap: int = 0, *more: str) -> DataFrame:
    """As-of interval join of functions with the nearest eligible comment.

    Comment spans and function spans are extracted independently. A comment is eligible for a function that begins within the
    comment's interval, which ends at the first statement below it; so a statement between rejects the pair. Of the
    eligible ones the nearest above is taken, of comments and docstrings each. The equi-key is (file, stretch of 64 lines),
    which spreads over all tasks even if one file holds a third of the functions; an interval that crosses stretches is sent to
    each. Taking the nearest needs no further exchange. Result: symbol_id, comment, kind and `more` columns of symbols for
    functions whose documentation is real, one row for each of comment and docstring; repeated rows count once, functions
    without any are left out.
    """
    at = lambda c: F.floor(F.col(c) / _STRETCH)
    spans = comment_blocks(files, max_gap).withColumn("_stretch", F.explode(F.sequence(at("from_line"), at("to_line"))))
    kept = functions(symbols).select("symbol_id", F.col("file_id").alias("_file"), F.col("start_line").alias("_line"), F.col("name").alias("_name"), F.col("params").alias("_params"), *more)
    heads = kept.withColumn("_at", at("_line"))
    near = heads.join(spans, (F.col("_file") == F.col("file_id")) & (F.col("_at") == F.col("_stretch")) & F.col("_line").between(F.col("from_line"), F.col("to_line")))
    best = near.groupBy("file_id", "_stretch", "symbol_id", "kind").agg(
        F.max_by(F.struct("_name", "_params", "first_line", "comment", *more), F.struct("last_line", "first_line")).alias("b")
    )

    def row(symbol_id, name, params, kind, first, comment, *rest):
        if docs.says_something(comment, name, params, _LONG):
            yield (symbol_id, kind, first, comment, *rest)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[5:]]
    return map_rows(
        best.select("symbol_id", "b._name", "b._params", "kind", "b.first_line", "b.comment", *[F.col("b")[c].alias(c) for c in more]), row,
        ", ".join(["symbol_id bigint", "kind string", "first_line int", "comment string", *kinds]),
    )


def documented_pairs(symbols: DataFrame, files: DataFrame, max_gap: int = 0) -> DataFrame:
    """Code-description pairs: symbol_id, qualified_name, kind, description (cleaned prose), body; one row a function."""
    found = documented(symbols, files, max_gap, "qualified_name", "body")
    best = found.groupBy("symbol_id").agg(
        F.min_by(F.struct("qualified_name", "kind", "comment", "body"), F.struct(F.col("kind") != "docstring", -F.col("first_line"))).alias("b")
    )

    def row(symbol_id, qualified_name, kind, comment, body):
        yield symbol_id, qualified_name, kind, docs.prose(comment), body

    return map_rows(best.select("symbol_id", "b.qualified_name", "b.kind", "b.comment", "b.body"), row,
                    "symbol_id bigint, qualified_name string, kind string, description string, body string")


# --- 2 -------------------------------------------------------------------------------------------------------------
def file_origin(files: DataFrame) -> DataFrame:
    """(file_id, origin, shown_by, expansion, uniformity, literals) of files that aren't hand-written: generated, minified, vendored or
    data; shown by their layout, a notice or the path. The measures are null for blank texts."""

    def row(file_id, path, language, content):
        found = origin.judge(path, language, content)
        if found:
            f = found[2]
            yield file_id, found[0], found[1], f.get("expansion"), f.get("uniformity"), f.get("literals")

    return map_rows(files.select("file_id", "file_path", "language", "content"), row, "file_id bigint, origin string, shown_by string, expansion double, uniformity double, literals double").distinct()


def handwritten(files: DataFrame) -> DataFrame:
    """The files that remain once machine-made, minified, third-party and data-only files are gone."""
    return files.join(file_origin(files).select("file_id").distinct(), "file_id", "left_anti")


# --- 3 -------------------------------------------------------------------------------------------------------------
def _checked(files: DataFrame) -> DataFrame:
    def row(file_id, project_id, path, content):
        spoken = language_of(path)
        if spoken:
            yield file_id, project_id, spoken, syntax.problem(content, spoken, path.lower().endswith(".kts"))

    return map_rows(files.select("file_id", "project_id", "file_path", "content"), row, "file_id bigint, project_id string, language string, problem string")


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id, language, problem) of files whose content isn't valid in the language their extension tells."""
    return _checked(files).filter("problem IS NOT NULL").select("file_id", "language", "problem").distinct()


def unparsable_rates(files: DataFrame) -> DataFrame:
    """Per project and language: files judged, files that aren't valid, their share. Repeated deliveries count once."""
    one = _checked(files).groupBy("file_id").agg(F.first("project_id").alias("project_id"), F.first("language").alias("language"), F.max("problem").alias("problem"))
    return one.groupBy("project_id", "language").agg(
        F.count("*").alias("files"), F.count("problem").alias("broken"), (F.count("problem") / F.count("*")).alias("share")
    )


# --- 4 -------------------------------------------------------------------------------------------------------------
def _is_config(path: Column, language: Column) -> Column:
    return (language.isNull() | (language == "unknown")) & ~F.coalesce(path.rlike(r"(?i)\.(pyi?|[mc]?jsx?|tsx?|java|go|[ch](pp|c|xx)?|cc|hpp|cs|kts?|php)$"), F.lit(False))


def secret_lines(records: DataFrame) -> DataFrame:
    """records(record_kind, record_id, text, config) -> (record_kind, record_id, line_no), a row for each line on which a credential begins."""

    def row(kind, record_id, text, config):
        for n in secrets.lines(text, bool(config)):
            yield kind, record_id, n

    return map_rows(records.select("record_kind", "record_id", "text", "config"), row, "record_kind string, record_id string, line_no int").distinct()


def masked(records: DataFrame) -> DataFrame:
    """The records whose text holds credentials, with these masked: (record_kind, record_id, masked_text)."""

    def row(kind, record_id, text, config):
        out = secrets.mask(text, bool(config))
        if out != text:
            yield kind, record_id, out

    return map_rows(records.select("record_kind", "record_id", "text", "config"), row, "record_kind string, record_id string, masked_text string")


def masked_shape(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, lines, characters) of every record's text with its credentials masked: what masking must not change."""

    def row(kind, record_id, text, config):
        if text is not None:
            out = secrets.mask(text, bool(config))
            yield kind, record_id, out.count("\n") + 1, len(out)

    return map_rows(records.select("record_kind", "record_id", "text", "config"), row, "record_kind string, record_id string, lines int, characters int").distinct()


def text_records(code_repo: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks and symbol bodies as records for secret_lines and masked."""
    chunks = code_repo.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("content").alias("text"), _is_config(F.col("file_path"), F.col("language")).alias("config"))
    bodies = symbols.select(F.lit("symbol").alias("record_kind"), F.col("symbol_id").cast("string").alias("record_id"), F.col("body").alias("text"), _is_config(F.col("file_path"), F.col("language")).alias("config"))
    return chunks.unionByName(bodies)


# --- 5 -------------------------------------------------------------------------------------------------------------
def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the chunks above their language's limit: (chunk_id, piece_no, start_line, end_line, overlap, content).

    limits: (language, max_size, overlap_size), one row a language, in characters. Only oversized texts reach Python.
    Chunks at or under the limit, with null content or without a limit give no row; copies of a chunk give its pieces once.
    """
    limit = limits.select(F.col("language").alias("_language"), "max_size", "overlap_size")
    over = (
        chunks.select("chunk_id", "language", "content", "start_line", "end_line")
        .join(limit, F.col("language") == F.col("_language"))
        .filter(F.char_length("content") > F.col("max_size"))
        .select("chunk_id", "content", "start_line", "end_line", "max_size", "overlap_size")
        .dropDuplicates(["chunk_id"])
    )

    def row(chunk_id, content, start_line, end_line, max_size, overlap_size):
        for n, p in enumerate(splitter.pieces(content, max_size, overlap_size, start_line, end_line)):
            yield (chunk_id, n, p.start_line, p.end_line, p.overlap, p.content)

    return map_rows(over, row, "chunk_id string, piece_no int, start_line int, end_line int, overlap int, content string")


