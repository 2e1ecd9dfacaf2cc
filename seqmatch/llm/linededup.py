"""Line dedup: drop long lines that many documents share, but for the largest document that holds each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, free_names, hash128, materialize, may_be_in, without

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ADDED = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; ``lower`` does that for ASCII without a map of characters."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, UPPER.lower()))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Drop the lines whose key has ``min_chars`` code points and occurs in ``min_docs`` documents.

    Texts are exploded once into lines with their positions, and the keys that are long enough hashed to 128 bits; the
    table of (document, text, position, hash) is written to the shared folder, so nothing is split or hashed again.
    Distinct documents are counted for each hash with map-side combination, and the hashes over the threshold meet the
    positions again (a broadcast below Spark's limit, else a shuffle join whose hot keys adaptive execution can split).
    A text is put together again by position: from the slices of its lines between the positions that it loses, which
    takes time in proportion to its lines.  Only hashes travel, and once the texts that lose lines, to meet their
    positions; a bitmap of bounded size tells them from the others, which stay where they are.

    Returns the columns of ``docs`` with ``text`` rewritten, and ``n_lines`` (before dropping) and ``n_dropped``.
    * null or empty text: one empty line; the text stays as it is.
    * rows with one ``doc_id`` count as one document, those with a null ``doc_id`` not at all; all rows that hold the
      largest ``doc_id`` keep the line.  A null ``doc_id`` is smaller than any other.
    * a text that loses no line is returned unchanged; one that loses all of them becomes ''.
    * a very long text is one row of many lines, whose positions meet in one row again; lines are never cut.
    * input columns named n_lines or n_dropped are replaced; all others, however named, pass through.
    """
    docs = without(docs, *ADDED)
    t1, t2, doc, u1, u2, lost, all_lines, kept, may = free_names(docs, "__t1", "__t2", "__doc", "__u1", "__u2", "__lost", "__lines", "__kept", "__may")
    of_text = hash128(F.coalesce("text", F.lit("")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    texts = docs.select(F.col("doc_id").alias("doc"), of_text[0].alias("t1"), of_text[1].alias("t2"), lines.alias("lines"))
    keyed = texts.select("doc", "t1", "t2", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    of_key = hash128("key")
    keyed = materialize(keyed.select("doc", "t1", "t2", "pos", of_key[0].alias("h1"), of_key[1].alias("h2")), "line-keys")
    held = keyed.select("doc", "h1", "h2").distinct()
    hits = held.groupBy("h1", "h2").agg(F.count("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    hits = materialize(hits.select("h1", "h2", "keeper"), "line-hits")
    gone = keyed.join(hits, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(F.col("doc").alias(doc), F.col("t1").alias(u1), F.col("t2").alias(u2)).agg(F.array_sort(F.collect_set("pos")).alias(lost))
    gone = materialize(gone, "lost-lines")
    rows = may_be_in(docs.withColumns({t1: of_text[0], t2: of_text[1]}), t1, bitmap(gone.select(F.col(u1).alias("h"))), may)
    cut = rows.where(F.col(may)).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(t1) == F.col(u1)) & (F.col(t2) == F.col(u2)), "left").withColumn(all_lines, lines)
    between = f"transform(arrays_zip(concat(array(0), transform({lost}, p -> p + 1)), concat({lost}, array(size({all_lines})))), s -> slice({all_lines}, s['0'] + 1, s['1'] - s['0']))"
    cut = cut.withColumn(kept, F.when(F.col(lost).isNotNull(), F.array_join(F.flatten(F.expr(between)), "\n")).otherwise(F.col("text")))
    names = [c for c in docs.columns if c.lower() != "text"]
    order = [F.col(f"`{c}`") for c in docs.columns] + [F.col(c) for c in ADDED]
    cut = cut.select(*[F.col(f"`{c}`") for c in names], F.col(kept).alias("text"), F.size(all_lines).cast("long").alias("n_lines"), F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long").alias("n_dropped"))
    whole = rows.where(~F.col(may)).select(*[F.col(f"`{c}`") for c in names], "text", F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return cut.unionByName(whole).select(*order)


ORACLE = """
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents) u
), hits AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN hits h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
