"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title_join(title: Column, body: Column) -> Column:
    """Title and body with a space between, without white space around."""
    both = F.concat_ws(" ", F.nullif(F.coalesce(title, F.lit("")), F.lit("")), F.coalesce(body, F.lit("")))
    return F.regexp_replace(both, r"^\s+|\s+$", "")


def query_text(text: Column, instruction: Column) -> Column:
    """A query under its instruction, if it has one."""
    return F.when(F.coalesce(instruction, F.lit("")) == "", text).otherwise(F.concat(F.lit("Task: "), instruction, F.lit("\nQuery: "), text))


def xml_escaped(text: Column) -> Column:
    out = F.trim(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def window_text(docs: Column) -> Column:
    """The documents of a window, each in a numbered block."""
    block = lambda d, i: F.concat(F.lit('<doc id="doc_'), (i + 1).cast("string"), F.lit('">\n'), xml_escaped(d), F.lit("\n</doc>"))
    return F.array_join(F.transform(docs, block), "\n")


def document_number(key: Column) -> Column:
    """The number that an answer's document key names: doc_3, Document 3, 3; else null."""
    n = F.regexp_extract(F.lower(F.trim(key)), r"^(?:doc(?:ument)?[\s_-]*)?0*([1-9][0-9]*)$", 1)
    return F.nullif(n, F.lit("")).cast("long")


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_id, start, n_words, text): overlapping chunks of ``size`` words; a text without words gives none."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    step = size - overlap
    rows = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int"), F.lit(1)) - 1
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("c"))
    part = F.slice("w", F.col("c") * step + 1, size)
    return rows.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("c").cast("string")).alias("chunk_id"),
        (F.col("c") * step).cast("long").alias("start"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text"),
    )


def token_estimate(value: Column) -> Column:
    """About how many tokens a text takes: half its characters, rounded up."""
    return F.ceil(F.length(F.coalesce(value, F.lit(""))) / 2).cast("long")


def prefix(value: Column, most: int) -> Column:
    """The longest verbatim prefix of at most ``most`` words; ``\\s`` parts words."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), rf"^\s*(?:\S+\s+){{0,{most - 1}}}\S*", 0)


def policy(value: Column, most: int, how: str) -> Column:
    """A text over ``most`` words is kept, cut to a prefix, or refused, as ``how`` says: keep, truncate, fail."""
    if how not in ("keep", "truncate", "fail"):
        raise ValueError(f"unknown policy {how!r}")
    over = F.regexp_count(F.coalesce(value, F.lit("")), F.lit(r"\S+")) > most
    other = {"keep": value, "truncate": prefix(value, most), "fail": F.raise_error(F.lit(f"a text of more than {most} words"))}[how]
    return F.when(over, other).otherwise(value)
