"""Drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import once
from ..session import stored
from .rows import others, quoted

# The white space that is stripped, and the letters that are lowered.
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, with A-Z lowered."""
    return F.translate(F.trim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove lines whose key occurs in ``min_docs`` documents or more, everywhere.

    Returns the columns of ``docs`` with the remaining lines in ``text``, and
    ``n_lines`` (before) and ``n_dropped``; columns of these two names are replaced.

    Lines are exploded once, as 128 bits of hash with their position; the hashes, not
    the texts, are shuffled and counted. Only positions of dropped lines go back to
    the documents. A line that a third of the corpus shares is counted from one row
    per document; the join that finds its rows is one that AQE splits.

    A missing or empty text has one empty line. Keys shorter than ``min_chars`` code
    points stay. Rows with one id are one document when documents are counted, and
    each keeps its own lines; rows without an id are told apart by their text. An
    empty table stays empty. Texts of any length are split whole, in time that grows
    with their lines; the lines of one text must fit in a task.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    doc, tag = F.col(quoted(id_col)), F.xxhash64(text)
    lines = F.split(text, "\n", -1)
    key = line_key(F.col("line"))
    each = (
        docs.select(doc.alias("doc"), tag.alias("tag"), lines.alias("lines"))
        # The text's hash has a column below the generator: above, it would be taken again for every line.
        .select("doc", "tag", F.posexplode("lines").alias("pos", "line"))
        .select("doc", "tag", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    each = stored(each, "lines")
    unnamed = F.when(F.col("doc").isNull(), F.col("tag"))
    common = (
        each.select("h1", "h2", "doc", unnamed.alias("unnamed"))
        .distinct()
        .groupBy("h1", "h2")
        .count()
        .where(F.col("count") >= min_docs)
        .select("h1", "h2")
    )
    # Kept as a table: AQE splits a hot line only where both sides of the join are shuffled for it.
    common = stored(common, "common-lines")
    dropped = each.join(common, ["h1", "h2"], "left_semi").groupBy("doc", "tag").agg(F.collect_set("pos").alias("_gone"))
    dropped = stored(dropped, "dropped-lines").withColumnsRenamed({"doc": "_doc", "tag": "_tag"})

    added = ["n_lines", "n_dropped"]
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), doc.alias("_id"), tag.alias("_text"))
    joined = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_tag")), "left")
    original = F.col("_row").getField(text_col)
    lines = F.split(F.coalesce(original, F.lit("")), "\n", -1)

    def remaining(lines: Column) -> Column:
        kept_at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.concat_ws("\n", F.transform(kept_at, lambda i: F.get(lines, i)))

    # Split once, not once more for each line that stays.
    kept = once(lines, remaining)
    return joined.select(
        *[
            (F.when(F.col("_gone").isNull(), original).otherwise(kept) if c == text_col else F.col("_row").getField(c)).alias(c)
            for c in others(docs, added)
        ],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
