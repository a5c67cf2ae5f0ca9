"""Exact Jaccard self-join of texts on word shingles, by a token-group matrix.

Texts with equal shingle sets form a class, and only classes are compared. The join goes in two steps.

*Groups.* Classes that share a band of minimum hashes meet at the least class of the band and are compared with it
alone (a star, never all pairs of a band). What is linked so, transitively, is a group: similar texts that are in one
component already. This step may miss links; it only decides how well the groups are made.

*Matrix.* Tokens (shingles) x groups. A link that is still missing joins two groups. Two sets with Jaccard similarity
>= t share at least one token among the first n - ceil(t n) + 1 tokens of each, in any common order of all tokens; in
such prefixes, rare tokens come first. A token that lies in the prefixes of one group only is dropped at once, so the
tokens of a large family of copies count as those of one group. For each query q and each other group G that shares a
prefix token with q, the overlap of q with the union of G's tokens bounds its overlap with every member; only groups
that reach ceil(t |q|) are opened, and the members are compared exactly. The union is stored as a bitmap of 2 to 4
bits a token: a token of q whose bit is missing is in no member. Large groups have their union stored in blocks of
bounded size, each with its own bound.

No link is lost: every pair of classes in different groups with similarity >= t passes all these filters.

The order of tokens comes from counts over all texts in a fixed table of 2^18 buckets (a sketch; a function of the
token alone, so any error only costs time). Tokens are 64-bit hashes. Token sets are made from the texts again where
they are compared, for the classes concerned; a fixed-size bitmap tells which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom import staging
from metaloom.llm.components import components
from metaloom.llm.text import buffers, list_array, mix, sets, shingles, slices, tidy, words

SIZE = 5
#: similarity in percent: 100 * intersection >= PERCENT * union
PERCENT = 80
#: bands of the grouping step, and minimum hashes in each
BANDS, ROWS = 8, 3
#: buckets of the token counts, and bits of the bitmap of classes; both fixed sizes
BUCKETS = 1 << 18
BITS = 1 << 23
#: classes in a block of a group's token union
BLOCK = 32
#: up to so many rows (id, group) are sent to every executor; more are joined by a shuffle
BROADCAST_ROWS = 500_000

_seeds = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def token_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, row, token): the distinct tokens of rows i to j, sorted."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        rows, _, hashed = words(data, offsets[i : j + 1])
        rows, tokens = sets(*shingles(rows, hashed, SIZE))
        yield i, j, rows, tokens


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - 18)).astype(np.int64)


def token_levels(docs: DataFrame) -> np.ndarray:
    """For each bucket 0 (as usual) to 15: the binary logarithm of its count over the mean. Covers all texts."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for _, _, _, tokens in token_sets(frame.column(0)):
                total += np.bincount(bucket(tokens), minlength=BUCKETS)
        parts = 64  # rows of 64 neighbouring buckets would be many; 64 long rows are few
        for k in range(parts):
            run = total[k * BUCKETS // parts : (k + 1) * BUCKETS // parts]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([run.astype(np.uint64).tobytes()], pa.binary())], ["part", "counts"])

    sums = docs.select("text").mapInArrow(tidy(batches), "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    counts = np.ones(BUCKETS)
    for r in sums:
        run = np.frombuffer(r["counts"], np.uint64)
        counts[r["part"] * len(run) : (r["part"] + 1) * len(run)] += run
    return np.clip(np.floor(np.log2(counts / counts.mean())), 0, 15).astype(np.uint64)


def _summed(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("counts").to_pylist():
        total = total + np.frombuffer(x, np.uint64)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of n tokens with any set that it is linked with: ceil(t n)."""
    return -(-n * PERCENT // 100)


def signature(tokens: np.ndarray) -> bytes:
    """A bit for each value of the tokens' last bits: 2 to 4 bits a token, a power of two in all."""
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _sized(sign: bytes, size: int) -> np.ndarray:
    """A signature brought to ``size`` bytes: folded, or repeated (which only adds bits)."""
    own = np.frombuffer(sign, np.uint8)
    return np.bitwise_or.reduce(own.reshape(-1, size)) if len(own) >= size else np.tile(own, size // len(own))


def overlap_bound(n: int, sign: bytes, others: bytes) -> int:
    """At most so many of the ``n`` tokens with signature ``sign`` are in a set with signature ``others``: each bit that is missing there is a token less."""
    own = np.frombuffer(sign, np.uint8)
    return n - int(np.bitwise_count(own & ~_sized(others, len(own))).sum())


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose signatures allow similarity >= t."""
    kinds = dict(pairs.dtypes)
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb"))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep = [
                (100 + PERCENT) * min(overlap_bound(na, sa, sb), overlap_bound(nb, sb, sa)) >= PERCENT * (na + nb)
                for na, sa, nb, sb in zip(*(frame.column(k).to_pylist() for k in range(2, 6)))
            ]
            yield frame.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(tidy(batches), f"a {kinds['a']}, b {kinds['b']}")


def _united(frame: pa.Table) -> pa.Table:
    """The signature of a block's token union."""
    signs = frame.column("sign").to_pylist()
    size = max(map(len, signs))
    union = np.zeros(size, np.uint8)
    for sign in signs:
        union |= _sized(sign, size)
    n = frame.column("n").to_pylist()
    return pa.table({"grp": frame.column("grp")[:1], "block": frame.column("block")[:1], "least": pa.array([min(n)], pa.int64()), "most": pa.array([max(n)], pa.int64()), "sign": pa.array([union.tobytes()], pa.binary())})


def profiles(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), bands, prefix, sign of every row."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i, j, rows, tokens in token_sets(frame.column(1)):
                m = j - i
                n = np.bincount(rows, minlength=m)
                some = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n[some])])[:-1].astype(np.int64)
                d1, d2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                bands = np.zeros((m, BANDS), np.uint64)
                if len(some):
                    d1[some] = np.add.reduceat(mix(tokens ^ _seeds[-1]), first)
                    d2[some] = np.bitwise_xor.reduceat(mix(tokens * _seeds[-2]), first)
                    for b in range(BANDS):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(ROWS):
                            key = mix(key ^ np.minimum.reduceat(mix(tokens * _seeds[b * ROWS + r]), first))
                        bands[some, b] = key
                # rare buckets first, then by the token itself
                order = np.lexsort((tokens, levels[bucket(tokens)], rows))
                at = np.arange(len(tokens)) - np.repeat(first, n[some])
                length = n - needed(n) + 1
                kept = order[at < np.repeat(length[some], n[some])]
                signs = [signature(tokens[f : f + k]) for f, k in zip(first, n[some])]
                whole = np.full(m, None, object)
                whole[some] = signs
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(i, m), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                        list_array(bands[some].reshape(-1).view(np.int64), np.where(n > 0, BANDS, 0)), list_array(tokens[kept].view(np.int64), np.where(n > 0, length, 0)), pa.array(whole.tolist(), pa.binary()),
                    ],
                    ["doc_id", "n", "d1", "d2", "bands", "prefix", "sign"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(batches), f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>, prefix array<long>, sign binary")


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("bit"), F.col(column)), F.lit(BITS))


def _bitmap(rows: DataFrame, bit: Column) -> np.ndarray:
    """BITS bits as bytes, those set that ``bit`` (0 to BITS - 1) gives for some row; BITS / 8 bytes reach the driver at any size."""
    numbered = rows.select((bit + 1).alias("bit"))
    maps = numbered.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(BITS // 8 + 4096, np.uint8)
    for r in maps:
        run = np.frombuffer(r["bits"], np.uint8)
        out[(r["part"] - 1) * len(run) : r["part"] * len(run)] = run
    return out


def _with_tokens(owned: DataFrame, shared: DataFrame) -> DataFrame:
    """token, rep, n, pos, grp, single: the prefixes of ``owned``, without (most of) the tokens that aren't ``shared``."""
    spark = owned.sparkSession
    packed = spark.sparkContext.broadcast(_bitmap(shared, F.pmod(F.col("token"), F.lit(BITS))))
    kinds = dict(owned.dtypes)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            prefix = frame.column(2)
            tokens, ends = prefix.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(prefix).to_numpy(zero_copy_only=False))
            first = np.concatenate([[0], ends])[:-1]
            bit = tokens.view(np.uint64) & np.uint64(BITS - 1)
            some = np.flatnonzero(packed.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            row = np.searchsorted(ends, some, "right")
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[some]), frame.column(0).take(at), frame.column(1).take(at), pa.array((some - first[row]).astype(np.int32)), frame.column(3).take(at), frame.column(4).take(at)],
                ["token", "rep", "n", "pos", "grp", "single"],
            )

    schema = f"token long, rep {kinds['rep']}, n long, pos int, grp {kinds['grp']}, single boolean"
    return owned.select("rep", "n", "prefix", "grp", "single").mapInArrow(tidy(batches), schema)


def _drop(spark: SparkSession, path: str) -> None:
    """Delete one staged table that isn't read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _tokens_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """rep, tokens of the classes in ``pairs`` (a, b), made from the texts. The bitmap passes some others, the join drops them."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    packed = spark.sparkContext.broadcast(_bitmap(wanted, _bit("rep")))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = frame.column(2).to_numpy(zero_copy_only=False)
            frame = frame.filter(pa.array((packed.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for i, j, rows, tokens in token_sets(frame.column(1)):
                n = np.bincount(rows, minlength=j - i)
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(i, j - i), list_array(tokens.view(np.int64), n)], ["rep", "tokens"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    made = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _bit("doc_id").alias("bit")).mapInArrow(tidy(batches), f"rep {kind}, tokens array<long>")
    return made.join(wanted, "rep", "left_semi").where(F.size("tokens") > 0)


def _similar(pairs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes, those with similarity >= t."""
    left = sets_of.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = sets_of.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    near = 100 * both >= PERCENT * (F.size("ta") + F.size("tb") - both)
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, n, rep; rows without a class: doc_id, n; links: a, b of classes). Links of one group may be left out where others connect it."""
    spark = docs.sparkSession

    def stage(df: DataFrame, label: str) -> DataFrame:
        return staging.stage(df, staging.new_stage(spark, label))

    narrow = docs.select("doc_id", "text")
    path = staging.new_stage(spark, "profiles")
    rows = staging.stage(profiles(narrow, token_levels(narrow)), path)
    keyed = rows.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets have equal profiles; copies are combined before the shuffle
    classes = keyed.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("bands", "prefix", "sign")))
    classes = stage(classes, "classes")
    members = stage(keyed.select("doc_id", "n", "d1", "d2").join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select("doc_id", "n", "rep"), "members")
    alone = stage(rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n"), "alone")
    _drop(spark, path)
    # rows with one id and several texts are one document
    same_id = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("a", "b")

    # groups
    bands = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    heads = bands.groupBy("band", "key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    star = bands.join(heads, ["band", "key"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    star = stage(_plausible(star, classes), "star-pairs")
    inner = stage(_similar(star, _tokens_of(narrow, star)).union(same_id), "star-links")
    groups = stage(components(inner), "groups")

    # matrix; single: the group is one class
    known = groups.withColumnRenamed("id", "rep")
    if groups.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    owned = classes.select("rep", "n", "prefix").join(known, "rep", "left").select("rep", "n", "prefix", F.coalesce("component", "rep").alias("grp"), F.col("component").isNull().alias("single"))
    tokens = owned.select("grp", F.explode("prefix").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token"), "shared")
    tokens = _with_tokens(owned, shared)
    probes = stage(tokens.join(shared, "token"), "probes")
    matrix = probes.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("pos").alias("pos"), F.first("single").alias("single"))
    fits = (F.col("q.grp") > F.col("m.grp")) & (100 * F.col("m.most") >= PERCENT * F.col("q.n")) & (PERCENT * F.col("m.least") <= 100 * F.col("q.n"))
    met = probes.alias("q").join(matrix.alias("m"), F.col("q.token") == F.col("m.token")).where(fits)
    met = met.groupBy(F.col("q.rep").alias("q"), F.col("q.n").alias("nq"), F.col("m.grp").alias("grp")).agg(
        F.count(F.lit(1)).alias("c"), F.min("q.pos").alias("first"), F.max("q.pos").alias("last"), F.max("m.pos").alias("last_m"),
        F.min("m.least").alias("least"), F.first("m.single").alias("single"),
    )
    # Both orders agree: what a class has before a shared token is in its prefix, so the tokens of q before its first
    # shared one are in no member, and for a single class those before the last shared one are known one by one.
    most_common = F.when(
        F.col("single"), F.least(F.col("c") + F.col("nq") - 1 - F.col("last"), F.col("c") + F.col("least") - 1 - F.col("last_m"))
    ).otherwise(F.col("nq") - F.col("first"))
    queries = stage(met.where((100 + PERCENT) * most_common >= PERCENT * (F.col("nq") + F.col("least"))).select("q", "nq", "grp"), "queries")
    open_groups = queries.select("grp").distinct()
    inside = classes.select("rep", "n", "sign").join(known, "rep", "left").select("rep", "n", "sign", F.coalesce("component", "rep").alias("grp"))
    inside = stage(inside.join(open_groups, "grp", "left_semi"), "inside")
    sized = inside.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    blocks = inside.join(sized, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK)))
    kind = dict(inside.dtypes)["grp"]
    unions = blocks.select("grp", "block", "n", "sign").groupBy("grp", "block").applyInArrow(_united, f"grp {kind}, block long, least long, most long, sign binary")
    asked = queries.join(classes.select(F.col("rep").alias("q"), F.col("sign").alias("own")), "q").join(unions, "grp")
    asked = asked.where((100 * F.col("most") >= PERCENT * F.col("nq")) & (PERCENT * F.col("least") <= 100 * F.col("nq")))

    def bounded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            nq, own, sign = (frame.column(c).to_pylist() for c in ("nq", "own", "sign"))
            keep = [100 * overlap_bound(n, a, b) >= PERCENT * n for n, a, b in zip(nq, own, sign)]
            yield frame.filter(pa.array(keep, pa.bool_())).select(["q", "nq", "grp", "block"])

    qualifying = asked.select("q", "nq", "grp", "block", "own", "sign").mapInArrow(tidy(bounded), f"q {kind}, nq long, grp {kind}, block long")
    # members of a qualifying block are compared by signature where the block is opened, and only those that may be similar come out
    filled = blocks.groupBy("grp", "block").agg(F.collect_list(F.struct("rep", "n", "sign")).alias("rows"))  # about BLOCK rows each
    opened = qualifying.join(filled, ["grp", "block"]).join(classes.select(F.col("rep").alias("q"), F.col("sign").alias("own")), "q")

    def opened_pairs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            a, b = [], []
            for q, nq, own, rows_ in zip(*(frame.column(c).to_pylist() for c in ("q", "nq", "own", "rows"))):
                near = [r["rep"] for r in rows_ if (100 + PERCENT) * min(overlap_bound(nq, own, r["sign"]), overlap_bound(r["n"], r["sign"], own)) >= PERCENT * (nq + r["n"])]
                a += [q] * len(near)
                b += near
            yield pa.RecordBatch.from_arrays([pa.array(a, frame.schema.field("q").type), pa.array(b, frame.schema.field("q").type)], ["a", "b"])

    opened = opened.select("q", "nq", "own", "rows").mapInArrow(tidy(opened_pairs), f"a {kind}, b {kind}")
    opened = stage(opened, "opened")
    return members, alone, inner.union(_similar(opened, _tokens_of(narrow, opened)))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A text without words, empty or null, has 0 shingles and is linked with nothing: its component is its own id. Texts
    with fewer than five words have one shingle. Rows with equal texts are linked; rows that share a doc_id
    are one document, whatever their texts. A row without doc_id takes no part (component null). No rows give none.
    """
    members, alone, linked = links(docs)
    found = staging.stage(components(linked), staging.new_stage(docs.sparkSession, "components"))
    placed = members.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")).union(alone.select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the least of its component; of rows with one id, all stay."""
    name = "_kept"
    while name in [x.lower() for x in docs.columns]:
        name += "_"
    kept = similar_documents(docs).where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[name]), "left_semi")
