"""Line dedup: later copies of repeated line runs go, found on a suffix array of line ids.

Lines with words become ids; those that occur once end a run, so only stretches of repeated lines go on.
Suffixes of the stretches are sorted by distributed prefix doubling: a suffix's rank by its first 2h
lines is its rank by the first h plus the number of suffixes that share those and are followed by a
smaller rank. Ranks are places in the suffix array, so suffixes with a common prefix stand together.

A run counts from MIN_WORDS words on. The windows that just reach that, from a line on or back from a
line, have at most MIN_WORDS lines, so doubling ends there: two ranks by 2^k lines, from its first line
on and up to its last, name a window, and the suffixes of one name are the interval of the suffix array
whose common prefixes reach over it. In each interval the first copy in (doc_id, line) order stays; from
the others all lines of the window go. A line of a longer run is in the window from it on, or, where less
than MIN_WORDS words of the run are left, in the window back from the run's end. So what goes is each
later copy of each maximal repeated run of at least MIN_WORDS words, and nothing else.

Nothing is collected: intervals are grouped minima, joins on hot ranks can be split. White lines count
for nothing and go only inside a cut run.

Defined results: null texts stay null and uncut; rows of one doc_id and text are one document and are
cut alike, also those of a null doc_id; texts of any length are split whole; empty tables give empty results. Other columns are kept by ``drop_repeats`` as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtok.llm.common import batch_map, documents, fresh, slices, small, whole_text, write_shared

MIN_WORDS = 50
#: Buckets of the first ranking, by the top bits of line ids.
BUCKET_BITS = 14
#: Bytes of texts whose lines a worker holds at a time.
LINES_BYTES = 512 << 10
#: Cut ranges are broadcast up to so many.
SMALL_CUTS = 500_000


def text_key(text: str) -> Column:
    return F.xxhash64(whole_text(text))


def line_rows(df: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text_key, seq, line, h1, h2, words): the lines with words of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, LINES_BYTES):
                yield lines_of(part)

    def lines_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        of, seq, at, hashes, words = [], [], [], [], []
        for n, value in enumerate(batch.column(2)):
            k = 0
            for line, content in enumerate(value.as_py().split(b"\n")):
                if count := len(content.split()):
                    of.append(n)
                    seq.append(k)
                    at.append(line)
                    hashes.append(xxhash.xxh3_128_digest(content))
                    words.append(count)
                    k += 1
        pairs = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
        columns = [
            pa.array(ids[of], pa.int64()), pa.array(keys[of], pa.int64()), pa.array(seq, pa.int32()), pa.array(at, pa.int32()),
            pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(words, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "seq", "line", "h1", "h2", "words"])

    body = df.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        text_key(text).alias("text_key"),
        F.col(text).cast("binary").alias("text"),
    )
    return batch_map(body, run, "doc_id long, text_key long, seq int, line int, h1 long, h2 long, words long")


def first_ranks(lines: DataFrame) -> DataFrame:
    """(h1, h2, r) of the lines that occur twice or more; r is the number of lines with smaller ids."""
    classes = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = classes.withColumn("bucket", F.shiftright("h1", 64 - BUCKET_BITS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # at most 2 ** BUCKET_BITS rows meet in one window partition
    bases = (
        classes.groupBy("bucket")
        .agg(F.sum("n").alias("total"))
        .select("bucket", F.coalesce(F.sum("total").over(before.orderBy("bucket")), F.lit(0)).alias("base"))
    )
    inside = F.coalesce(F.sum("n").over(before.partitionBy("bucket").orderBy("h1", "h2")), F.lit(0))
    return (
        classes.withColumn("inside", inside)
        .join(F.broadcast(bases), "bucket")
        .select("h1", "h2", (F.col("base") + F.col("inside")).alias("r"))
    )


def doubled(state: DataFrame, level: int, width: int) -> DataFrame:
    """Ranks r{level + 1} by twice as many lines, from r{level}; -1 stands for the end of a stretch.

    What follows a common line is summed in ranges of ``width`` ranks, and the ranges' totals by
    themselves: with the root of the largest rank as width, no window partition holds more rows than that.
    """
    this, reach = f"r{level}", 1 << level
    inside = Window.partitionBy("doc_id", "text_key", "stretch").orderBy("seq")
    state = state.withColumn("after", F.coalesce(F.lead(this, reach).over(inside), F.lit(-1).cast("long")))
    pairs = state.groupBy(this, "after").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.withColumn("part", F.floor(F.col("after") / width))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("total").over(before.partitionBy(this).orderBy("part")), F.lit(0))
    bases = pairs.groupBy(this, "part").agg(F.sum("n").alias("total")).select(this, "part", base.alias("base"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy(this, "part").orderBy("after")), F.lit(0))
    pairs = pairs.withColumn("inside", inside).join(bases, [this, "part"])
    pairs = pairs.select(this, "after", (F.col(this) + F.col("base") + F.col("inside")).alias(f"r{level + 1}"))
    return state.join(pairs, [this, "after"]).drop("after")


def repeated_runs(
    df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS
) -> DataFrame:
    """(doc_id, text_key, first, last): lines first to last of a text are a later copy of a run."""
    lines = write_shared(line_rows(df, text, key), "lines")
    state = lines.join(first_ranks(lines), ["h1", "h2"]).drop("h1", "h2").distinct()
    place = Window.partitionBy("doc_id", "text_key").orderBy("seq")
    state = state.withColumn("stretch", F.col("seq") - F.row_number().over(place)).withColumnRenamed("r", "r0")
    # a run of min_words words has at most as many lines
    levels = max(0, (min_words - 1).bit_length() - 1) + 1
    inside = Window.partitionBy("doc_id", "text_key", "stretch").orderBy("seq")
    total = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    state = state.withColumn("total", total)
    # the shortest window from here on ends where the sum of words first reaches min_words
    ahead = inside.rowsBetween(Window.currentRow, min_words - 1)
    enough = F.filter(
        F.collect_list(F.struct("total", "line")).over(ahead),
        lambda x: x["total"] >= F.col("total") - F.col("words") + min_words,
    )
    state = state.withColumn("enough", enough).withColumn(
        "run_lines",
        F.when(F.size("enough") > 0, F.size(F.collect_list("line").over(ahead)) - F.size("enough") + 1),
    )
    # windows back start here as long as the next line's own window doesn't fit
    following = F.lead("run_lines").over(inside)
    fits = F.greatest(F.lit(1), following - F.col("run_lines") + 1)
    state = state.withColumn("n_ends", F.when(following.isNull(), F.size("enough")).otherwise(fits))
    ends = F.transform(F.slice("enough", 1, F.col("n_ends")), lambda x: x["line"])
    state = write_shared(
        state.select(
            "doc_id", "text_key", "stretch", "seq", "line", "r0", "run_lines",
            F.when(F.col("run_lines").isNotNull(), ends).alias("ends"),
        ),
        "suffixes",
    )
    # levels beyond the longest run that is needed would not be read
    longest, top = state.agg(F.max(F.col("run_lines") + F.size("ends") - 1), F.max("r0")).first()
    longest, width = longest or 0, math.isqrt(top or 0) + 1
    ranked = state
    for level in range(min(levels, max(0, longest.bit_length() - 1))):
        ranked = write_shared(doubled(ranked, level, width), f"rank-{level + 1}")
    # ranks from the window's first line on and up to its last name it
    named = ranked
    for level in range(longest.bit_length()):
        reach = inside.rowsBetween(Window.currentRow, (1 << level) - 1)
        named = named.withColumn(f"ranks{level}", F.collect_list(f"r{level}").over(reach))
    named = named.where("run_lines is not null").select("*", F.posexplode("ends").alias("more", "last"))
    n = F.col("run_lines") + F.col("more")
    first, second = F.lit(None).cast("long"), F.lit(None).cast("long")
    for level in range(longest.bit_length()):
        size = 1 << level
        here = (n >= size) & (n < 2 * size)
        second = F.when(here, F.get(f"ranks{level}", n - size)).otherwise(second)
        first = F.when(here, F.col(f"r{level}")).otherwise(first)
    name = [n.alias("n"), first.alias("first_rank"), second.alias("last_rank")]
    named = write_shared(named.select("doc_id", "text_key", "line", "last", *name), "runs")
    intervals = named.groupBy("n", "first_rank", "last_rank").agg(
        F.min(F.struct("doc_id", "text_key", "line")).alias("origin"), F.count(F.lit(1)).alias("copies")
    )
    # written first, so that a hot interval's side of the join can be split or meets a broadcast
    intervals = write_shared(intervals.where("copies > 1"), "intervals")
    later = F.struct("doc_id", "text_key", "line") != F.col("origin")
    return (
        named.join(small(intervals), ["n", "first_rank", "last_rank"])
        .where(later)
        .select("doc_id", "text_key", F.col("line").alias("first"), "last")
    )


def cuts(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, cuts): for each text with later copies the line ranges that go, merged and in order.

    One sweep over a text's ranges: a range that begins beyond all lines before it begins a new cut.
    """
    ranges = repeated_runs(df, text, key, min_words).distinct()
    along = Window.partitionBy("doc_id", "text_key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("first") > F.max("last").over(along) + 1, F.lit(True))
    merged = (
        ranges.withColumn("begins", begins.cast("int"))
        .withColumn("cut", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("doc_id", "text_key", "cut")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    return merged.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def without(lines: Column, cuts: Column) -> Column:
    """``lines`` less the ranges of ``cuts``: the slices between them, each copied once."""
    size = F.size(lines)
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["last"] + 1))
    ends = F.concat(F.transform(cuts, lambda c: c["first"]), F.array(size))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def with_cuts(
    df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, out: str = "_cuts"
) -> DataFrame:
    """``df`` with a column ``out``, null where nothing goes, and its text without those lines."""
    found = write_shared(cuts(df, text, key, min_words), "cuts")
    n = found.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    doc, own = fresh(df, "_doc"), fresh(df, "_key")
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(own), F.col("cuts").alias(out))
    side = F.broadcast(found) if n <= SMALL_CUTS else found
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))
    joined = df.join(side, (at == F.col(doc)) & (text_key(text) == F.col(own)) & F.col(text).isNotNull(), "left")
    # the lines are a lambda's own, so that they are split once and not for each cut
    left = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: without(lines, F.col(out)))
    cleaned = F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(F.get(left, F.lit(0)), "\n"))
    return joined.select(*(cleaned.alias(c) if c == text else F.col(c) for c in df.columns), out)


def drop_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` without later copies of repeated runs; documents of which only white space is left go."""
    mark = fresh(df, "_cuts")
    gone = F.col(mark).isNotNull() & ~F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    return with_cuts(df, text, key, min_words, mark).where(~gone).drop(mark)


def op4_suffix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("_cuts", F.lit(0).cast("long"), lambda n, c: n + c["last"] - c["first"] + 1)
    listed = F.array_join(
        F.transform("_cuts", lambda c: F.concat_ws("-", c["first"].cast("string"), c["last"].cast("string"))), ","
    )
    return with_cuts(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        F.coalesce(size, F.lit(0).cast("long")).alias("n_cut_lines"),
        F.coalesce(listed, F.lit("")).alias("cut_lines"),
        F.md5(whole_text("text").cast("binary")).alias("text_md5"),
    )


#: Runs by their text instead of ranks: what first reaches 50 words from each line on, and back from each line.
OP4_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS line, s[i] AS body,
           length(regexp_replace(trim(regexp_replace(s[i], '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]', '', 'g')) + 1 AS words
    FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL) d,
         unnest(range(1, len(s) + 1)) AS u(i)
    WHERE regexp_matches(s[i], '[^\x20\x09-\x0D]')
), placed AS (
    SELECT *, row_number() OVER w AS seq, sum(words) OVER w AS total
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), ends AS (
    SELECT a.doc_id, a.seq, min(b.seq) AS last_seq
    FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49
         AND b.total >= a.total - a.words + 50
    GROUP BY ALL
), backs AS (
    SELECT b.doc_id, max(a.seq) AS seq, b.seq AS last_seq
    FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.seq BETWEEN b.seq - 49 AND b.seq
         AND b.total >= a.total - a.words + 50
    GROUP BY ALL
), stretches AS (
    SELECT doc_id, seq, last_seq FROM ends UNION SELECT doc_id, seq, last_seq FROM backs
), runs AS (
    SELECT e.doc_id, min(p.line) AS line, max(p.line) AS last, string_agg(p.body, chr(10) ORDER BY p.seq) AS body
    FROM stretches e JOIN placed p ON p.doc_id = e.doc_id AND p.seq BETWEEN e.seq AND e.last_seq
    GROUP BY e.doc_id, e.seq, e.last_seq
), later AS (
    SELECT doc_id, line, last FROM (
        SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS copy FROM runs) WHERE copy > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(line, last + 1)) AS line FROM later
), islands AS (
    SELECT doc_id, min(line) AS a, max(line) AS b
    FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM gone)
    GROUP BY doc_id, g
), cuts AS (
    SELECT doc_id, sum(b - a + 1) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS listed FROM islands GROUP BY doc_id
), cleaned AS (
    SELECT d.doc_id, string_agg(d.body, chr(10) ORDER BY d.line) AS text
    FROM (SELECT doc_id, i - 1 AS line, s[i] AS body
          FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents SEMI JOIN cuts USING (doc_id)),
               unnest(range(1, len(s) + 1)) AS u(i)) d
    ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.line = g.line
    GROUP BY d.doc_id
)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_cut_lines, coalesce(c.listed, '') AS cut_lines,
       md5(CASE WHEN c.doc_id IS NULL THEN coalesce(d.text, '') ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d LEFT JOIN cuts c USING (doc_id) LEFT JOIN cleaned k USING (doc_id)
"""
