"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: words, symbols, repeated lines, words in repeated
eight-word windows. The cross-document rule hashes every normalised line
together with its host (the document's source), counts the distinct documents
of the host that hold it, removes lines that more than ``max_docs`` of them
hold, and rejects documents that this depletes.

One scan computes the base figures and an array of (line key, words) per row,
which are written once. Line keys are counted with map-side aggregation; only
keys above the limit are joined back (a small side becomes a broadcast, a hot
key of a large one is split by the adaptive skew join), and what is exploded
is 12 bytes a line, never text.

Normalised: A-Z lower-cased, digits 1-9 as 0, tab, VT, FF and CR as spaces,
outer spaces cut. A line without a word doesn't count.

Defined results: null text is empty (0 words, base_failed); null source is one
host; rows without a doc_id are one document for the line counts if their texts
are equal; repeated rows are one document for the counts and keep rows of their
own in the result; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, saved

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_FROM = string.ascii_uppercase + "123456789" + "\t\x0b\x0c\r"
_TO = string.ascii_lowercase + "0" * 9 + " " * 4


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, SEPARATORS, "")) > 0


def base_features(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; text null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [c for c in docs.columns]
    out = docs.select(*own, text.alias("__text")).withColumns(
        {
            "__words": F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)),
            "word_chars": F.char_length(F.translate("__text", SEPARATORS, "")).cast("long"),
            "n_symbols": (F.char_length("__text") - F.char_length(F.translate("__text", SYMBOLS, ""))).cast("long"),
            "__lines": F.filter(F.split("__text", "\n"), _has_word),
        }
    )
    starts = F.sequence(F.lit(0), F.size("__words") - window)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("__words"), i + j) for j in range(window)]))
    out = out.withColumns({"n_words": F.size("__words").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__hashes": F.when(F.size("__words") > window, hashed)})
    # Few texts have a repeated window; only those are sorted.
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    pairs = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__pairs", F.when(repeats, pairs))
    same = lambda x, i, j: F.coalesce(F.get(F.col("__pairs"), i + j)["h"] == x["h"], F.lit(False))
    twice = F.filter("__pairs", lambda x, i: same(x, i, -1) | same(x, i, 1))
    out = out.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("__at", lambda p, j: F.least(F.lit(window), F.coalesce(F.get(F.col("__at"), j + 1) - p, F.lit(window))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__words", "__hashes", "__pairs", "__at", "__lines")


def line_keys(text: Column, host: Column) -> Column:
    """array<struct<k, w>>: a hash of host and normalised line, and the line's words."""
    lines = F.transform(F.split(F.translate(text, _FROM, _TO), "\n"), F.trim)
    return F.transform(F.filter(lines, _has_word), lambda x: F.struct(F.xxhash64(host, x).alias("k"), F.regexp_count(x, F.lit(WORD)).alias("w")))


def judge(docs: DataFrame, max_docs: int = 10, least_words: int = 20, least_share: float = 0.5) -> DataFrame:
    """A row per row of docs: doc_id, the base figures, base_failed, n_removed_words, kept.

    kept is false where the base rules fail, or where without the lines that
    more than max_docs documents of the host hold fewer than least_words words
    or less than least_share of the words are left.
    """
    rows = base_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    rows = rows.withColumns({"lines": line_keys(F.col("__text"), F.col("source")), "row": F.monotonically_increasing_id(), "who": F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("__text")))})
    rows = saved(rows.drop("text", "__text", "source"))
    keys = rows.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k"))
    often = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).select("k")
    lines = rows.select("row", "who", F.inline("lines"))
    hits = saved(lines.join(often, "k").groupBy("row", "who", "k").agg(F.sum("w").alias("w")))
    # The first count took repeated rows as documents of their own; count them once.
    common = hits.groupBy("k").agg(F.count_distinct("who").alias("n")).filter(F.col("n") > max_docs).select("k")
    removed = hits.join(common, "k").groupBy("row").agg(F.sum("w").alias("n_removed_words"))
    out = rows.drop("lines").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~failed & (left >= least_words) & (left >= least_share * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (select rid, i, array_to_string(ws[i:i+7], ' ') as win from w, unnest(range(1, len(ws) - 6)) as u(i)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as c from g) where c > 1),
rep as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from r) group by rid),
raw as (select rid, unnest(string_split(t, chr(10))) as line from d),
dup as (select rid, sum(c - 1) as n from (select rid, line, count(*) as c from raw where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid, line) group by rid),
norm as (select rid, coalesce(doc_id::varchar, 'text ' || t) as who, source, trim(unnest(string_split(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789' || chr(9) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz000000000    '), chr(10)))) as line from d),
kept_lines as (select rid, who, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from norm where regexp_matches(line, '[^\x20\x09-\x0D]')),
common as (select source, line from kept_lines group by source, line having count(distinct who) > 10),
gone as (select k.rid, sum(k.n) as n from kept_lines k join common c on k.line = c.line and k.source is not distinct from c.source group by k.rid),
f as (
  select d.doc_id, len(w.ws)::bigint as n_words,
    length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed_words
  from d join w using (rid) left join dup using (rid) left join rep using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed, n_removed_words,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_removed_words >= 20 and n_words - n_removed_words >= 0.5 * n_words as kept
from f
"""
