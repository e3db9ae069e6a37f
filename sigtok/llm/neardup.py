"""Near-duplicates: b-bit MinHash signatures, band candidates, links confirmed on whole shingle sets.

1. Each text's shingles become a set of 64-bit hashes. Texts of equal sets form a class, and only its
   smallest doc_id goes on. Of 128 minima the low 4 bits are kept, packed into 64 bytes; all bits go into
   band keys of as many minima each as leave a pair at the threshold without a shared band with a chance of
   at most MISSED: 4 at 80 percent (5e-8), fewer below.
2. In each band bucket every class is paired with one hub, so a bucket of n gives n - 1 pairs. Pairs
   whose similarity, estimated from equal signature digits by bit counts and corrected for chance
   collisions, is within reach of the threshold are confirmed on the whole sets.
3. In buckets that still hold more than one component, the members outside the largest one are compared with
   all others of different components: estimates in blocks of bounded size, inside a task; classes with a
   pair within reach get their sets, and pairs still apart are confirmed. A bucket of n members, m of them
   outside its largest component, gives n rows for each BLOCK of those m and m rows for each BLOCK of n.
4. Components of the links are found by stars over the table of links.

Nothing is capped: an estimate discards a pair only when it is more than 5 standard deviations below
the threshold. What grows with the data stays in tables; a side is broadcast only if counted small.

Defined results: null, empty and white texts have no shingles and are linked with nothing; a text of
fewer words than a shingle has is one shingle; rows of one doc_id are one document, rows without one are
linked with nothing and stay; the shingles of a text of any length are one set in a task; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import arrow_map, batch_map, documents, fresh, small, whole_text, write_shared
from sigtok.llm.components import connected
from sigtok.llm.wordcache import Cache, loaded

HASHES = 128
BITS = 4
#: The chance of a pair at the threshold to share no band.
MISSED = 1e-6
#: Members of a bucket that a task compares with as many others.
BLOCK = 512

_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(Cache):
    """A word's hash."""

    budget = 12 << 20

    def _make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: ``size`` words each, A-Z as a-z."""
    words = text.lower().split()  # of bytes: ASCII capitals and white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(loaded(_Words).__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out * _STEP + h[k : k + n])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 4096):  # stays in the processor's cache
        np.minimum(out, ((low[at : at + 4096] ^ _XOR) * _MUL).min(axis=1), out=out)
    return out


def band_rows(percent: int) -> int:
    """Minima in a band: as many as keep the chance to miss a pair at the threshold under MISSED."""
    for rows in (8, 4, 2, 1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) <= MISSED:
            return rows
    raise ValueError(f"{HASHES} minima don't find pairs of {percent} percent")


def signature(least: np.ndarray, rows: int) -> tuple[bytes, np.ndarray]:
    """The packed low bits and the band keys."""
    mixed = _mixed(least.astype(np.uint64))
    digits = (mixed & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    key = np.arange(1, HASHES // rows + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mixed(key * _STEP + mixed[k::rows])
    return (digits[::2] | (digits[1::2] << 4)).tobytes(), key.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from signatures, uint64 words in the last axis."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def reach(threshold: float) -> float:
    """Five standard deviations below the threshold."""
    hit = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - 5 * math.sqrt(hit * (1 - hit) / HASHES) / (1 - 2.0**-BITS)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(df: DataFrame, size: int, rows: int, text: str, key: str) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, bands) with ``rows`` minima in a band."""
    n_bands = HASHES // rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, sigs, bands = [], [], [], []
        for value in batch.column(1):
            s = shingles(value.as_py(), size)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig, keys = signature(minima(s), rows)
            sigs.append(sig)
            bands.append(keys)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, n_bands * (len(n) + 1), n_bands, dtype=np.int32)), pa.array(np.concatenate(bands))
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digests), pa.array(sigs), lists],
            ["doc_id", "n_shingles", "digest", "sig", "bands"],
        )

    return arrow_map(_bytes_of(df, text, key), run, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def _bytes_of(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))


def _sets(df: DataFrame, ids: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(id, set) of the documents in ``ids``: sorted shingle hashes as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py(), size).tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    wanted = _bytes_of(df, text, key).join(small(ids), F.col("doc_id") == F.col("id"), "left_semi")
    return arrow_map(wanted, run, "id long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked, by their whole sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [
            linked(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent)
            for a, b in zip(batch.column(2), batch.column(3), strict=True)
        ]
        return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
    both = both.join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    return arrow_map(both.select("u", "v", "a", "b"), run, "u long, v long")


def _near(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs with signatures a, b whose estimate is at least ``least``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, HASHES * BITS // 64) for c in batch.columns[2:4])
        return batch.select(["u", "v"]).filter(pa.array(estimates(a, b) >= least))

    return arrow_map(pairs.select("u", "v", "a", "b"), run, "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of sorted batches by equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield held


def _dealt(members: DataFrame) -> DataFrame:
    """Members (bucket, id, comp, ...) dealt to tasks (bucket, i, j): block i of all, block j of the outliers.

    Outliers stand outside the largest component of their bucket. ``outlier`` marks the rows of block j.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    others = F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("others")
    plan = small(write_shared(plan.select("bucket", F.col("main.comp").alias("main"), blocks, others), "bucket-blocks"))
    placed = members.join(plan, "bucket")

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    row = [*members.columns]
    whole = placed.select(*row, block("blocks").alias("i"), every("others").alias("j"), F.lit(False).alias("outlier"))
    apart = placed.where("comp != main")
    apart = apart.select(*row, every("blocks").alias("i"), block("others").alias("j"), F.lit(True).alias("outlier"))
    return whole.union(apart)


def _apart(group: pa.Table, least: float, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a task that are of different components and within reach: rows and estimates."""
    comp, out, ids = group.column("comp").to_numpy(), group.column("outlier").to_numpy(), group.column("id").to_numpy()
    size = group.column("n_shingles").to_numpy()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint64).reshape(len(comp), -1)
    all_rows, outliers = np.flatnonzero(~out), np.flatnonzero(out)
    of_outliers = np.isin(ids[all_rows], ids[outliers])
    found = []
    for a in outliers:
        # a pair of outliers is met from both sides where their blocks meet; one side is enough there
        b = all_rows[(comp[all_rows] != comp[a]) & (~of_outliers | (ids[all_rows] < ids[a]))]
        if len(b):
            e = estimates(sig[b], sig[a])
            ok = (e >= least) & (100 * np.minimum(size[b], size[a]) >= percent * np.maximum(size[b], size[a]))
            found.append((np.full(int(ok.sum()), a), b[ok], e[ok]))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _by_task(dealt: DataFrame, *more: str) -> DataFrame:
    ordered = dealt.select("bucket", "i", "j", "outlier", "id", "comp", "n_shingles", "sig", *more)
    return ordered.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _crossing(members: DataFrame, least: float, percent: int) -> DataFrame:
    """(bucket, id, comp) of members with a pair of different components within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 3):
            group = pa.Table.from_batches(held)
            a, b, _ = _apart(group, least, percent)
            if len(a):
                yield group.select(["bucket", "id", "comp"]).take(np.unique(np.concatenate([a, b]))).combine_chunks().to_batches()[0]

    return batch_map(_by_task(_dealt(members)), run, "bucket long, id long, comp long").distinct()


def _new_links(members: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (u, v) that join components of a bucket, confirmed on the members' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 3):
            group = pa.Table.from_batches(held)
            a, b, e = _apart(group, least, percent)
            ids = group.column("id").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
            comp = group.column("comp").to_pylist()
            root = {c: c for c in comp}

            def top(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            u, v = [], []
            for k in np.argsort(-e, kind="stable"):
                x, y = int(a[k]), int(b[k])
                if top(comp[x]) != top(comp[y]) and linked(sets[x], sets[y], percent):
                    root[top(comp[x])] = top(comp[y])
                    u.append(ids[x])
                    v.append(ids[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return batch_map(_by_task(_dealt(members).join(sets, "id"), "set"), run, "u long, v long")


def _remaining_links(
    df: DataFrame, classes: DataFrame, labelled: DataFrame, mixed: DataFrame, sets: DataFrame, size: int, percent: int, text: str, key: str
) -> DataFrame:
    """Links between components of the buckets in ``mixed``."""
    least = reach(percent / 100)
    open_members = labelled.drop("n_members").join(small(mixed.select("bucket")), "bucket", "left_semi")
    open_members = open_members.join(classes.select("id", "n_shingles", "sig"), "id")
    crossing = write_shared(_crossing(open_members, least, percent), "crossing")
    # buckets of the same members need one look
    looks = (
        crossing.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
        .groupBy("who", "n")
        .agg(F.min("bucket").alias("bucket"))
    )
    more_ids = crossing.select("id").distinct().join(sets.select("id"), "id", "left_anti")
    more_ids = write_shared(more_ids, "more-ids")
    more_sets = _sets(df, more_ids, size, text, key).dropDuplicates(["id"])
    all_sets = write_shared(sets.union(more_sets), "all-sets")
    look = crossing.join(looks.select("bucket"), "bucket", "left_semi").join(classes.select("id", "n_shingles", "sig"), "id")
    return _new_links(look, all_sets, least, percent)


def near_duplicates(
    df: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of each row of ``df``."""
    least = reach(percent / 100)
    rows = write_shared(signatures(df, size, band_rows(percent), text, key), "signatures")
    with_words = rows.where("n_shingles > 0 and doc_id is not null")
    classes = write_shared(
        with_words.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("r"))
        .select("digest", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.sig", "r.bands"),
        "classes",
    )
    # buckets of two and more classes, with the hub of each
    in_bands = classes.select("id", F.explode("bands").alias("bucket"))
    hub = F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("hub"))).alias("r")
    buckets = (
        in_bands.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n_members"), hub)
        .where("n_members > 1")
        .select("bucket", "n_members", "r.hub")
    )
    buckets = write_shared(buckets, "buckets")
    members = write_shared(in_bands.join(small(buckets), "bucket").select("bucket", "n_members", "hub", "id"), "members")
    pairs = (
        members.where("id != hub").select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct()
    )
    sig = classes.select("id", "sig")
    pairs = pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("a")), "u")
    pairs = pairs.join(sig.select(F.col("id").alias("v"), F.col("sig").alias("b")), "v")
    near = write_shared(_near(pairs, least), "near-pairs")
    ids = near.select(F.col("u").alias("id")).union(near.select("v")).distinct()
    ids = write_shared(ids, "near-ids")
    sets = write_shared(_sets(df, ids, size, text, key).dropDuplicates(["id"]), "sets")
    links = write_shared(_confirmed(near, sets, percent), "links-hub")
    found = write_shared(connected(links), "components-hub")

    # buckets that still hold several components
    comp = F.coalesce("component", "id").alias("comp")
    labelled = members.join(small(found), F.col("id") == F.col("node"), "left").select("bucket", "n_members", "id", comp)
    mixed = (
        labelled.groupBy("bucket")
        .agg(
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
            F.first("n_members").alias("n_members"),
            # buckets of the same members need one look
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"),
        )
        .where("lo < hi")
        .groupBy("who", "n_members")
        .agg(F.min("bucket").alias("bucket"))
    )
    mixed = write_shared(mixed, "mixed-buckets")
    final = found
    if mixed.head(1):
        new = write_shared(_remaining_links(df, classes, labelled, mixed, sets, size, percent, text, key), "links-more")
        if new.head(1):
            final = write_shared(connected(links.union(new)), "components")
    # one id for each class, then one for each component
    by_digest = classes.select("digest", F.col("id").alias("class_id"))
    by_digest = by_digest.join(small(final), F.col("class_id") == F.col("node"), "left")
    by_digest = by_digest.select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    together = with_words.select("doc_id", "n_shingles", "digest").join(by_digest, "digest")
    out = together.select("doc_id", "n_shingles", "class_id", "component_id").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(
    df: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``df`` with one document of each component, that of the smallest id."""
    found = near_duplicates(df, size, percent, text, key)
    doc = fresh(df, "_doc")
    gone = write_shared(found.where(~F.col("kept")).select(F.col("doc_id").alias(doc)).distinct(), "near-gone")
    return df.join(small(gone), F.col(key) == F.col(doc), "left_anti")


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and all that each document reaches: for small tables.
OP2_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM worded WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS u, b.doc_id AS v
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
         JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reached AS (
    SELECT doc_id AS start, doc_id AS node FROM sizes
    UNION
    SELECT r.start, l.v FROM reached r JOIN links l ON l.u = r.node
), smallest AS (
    SELECT start, min(node) AS component FROM reached GROUP BY start
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
       coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN smallest c ON c.start = d.doc_id
"""
